"""The suggested filters and clean-ups, as transforms of a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..columns import as_list, col, is_text
from ..functions import is_email, is_phone, trim_space
from ..functions.text import SQL_UNSAFE


def _text_columns(df: DataFrame, columns) -> list[str]:
    texts = [f.name for f in df.schema.fields if is_text(f)]
    return texts if columns is None else as_list(columns)


def drop_nulls(df: DataFrame, column: str, blanks_too: bool = False) -> DataFrame:
    c = col(column)
    keep = c.isNotNull()
    return df.where(keep & (trim_space(c) != "") if blanks_too else keep)


def drop_blanks(df: DataFrame, column: str) -> DataFrame:
    return drop_nulls(df, column, blanks_too=True)


def keep_valid_emails(df: DataFrame, column: str) -> DataFrame:
    return df.where(is_email(col(column)))


def keep_valid_phones(df: DataFrame, column: str) -> DataFrame:
    return df.where(is_phone(col(column)))


def trim_texts(df: DataFrame, columns=None) -> DataFrame:
    return df.withColumns({c: trim_space(col(c)) for c in _text_columns(df, columns)})


def drop_unsafe_chars(df: DataFrame, column: str) -> DataFrame:
    """Rows whose value holds none of the unsafe characters; nulls stay."""
    return df.where(~F.coalesce(col(column).rlike(SQL_UNSAFE), F.lit(False)))


def remove_unsafe_chars(df: DataFrame, columns=None) -> DataFrame:
    return df.withColumns({
        c: F.regexp_replace(col(c), SQL_UNSAFE, "") for c in _text_columns(df, columns)
    })


def complete_rows(df: DataFrame) -> DataFrame:
    return df.na.drop("any")


def drop_columns(df: DataFrame, columns) -> DataFrame:
    return df.drop(*as_list(columns))


def standardize_type(df: DataFrame, column: str, target: str = "string") -> DataFrame:
    """Cast a mixed column to one type; what does not fit becomes null."""
    return df.withColumn(column, col(column).try_cast(target))
