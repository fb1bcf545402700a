"""Helpers around column names, column types and the long form of a table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Wide aggregates are split into groups of this many columns. A columnar source
# reads disjoint columns for each group, so the bytes read stay the same.
COLUMNS_PER_AGGREGATE = 60


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def col(name: str) -> Column:
    return F.col(quoted(name))


def as_list(value) -> list[str]:
    if value is None:
        return []
    return [value] if isinstance(value, str) else list(value)


def profiled_fields(df: DataFrame, columns=None, by: Sequence[str] = ()) -> list[T.StructField]:
    """The fields to look at, in schema order; grouping columns are left out."""
    wanted = None if columns is None else set(as_list(columns))
    if wanted is not None:
        missing = wanted - set(df.columns)
        if missing:
            raise ValueError(f"unknown columns: {sorted(missing)}")
    return [
        f for f in df.schema.fields
        if f.name not in by and (wanted is None or f.name in wanted)
    ]


def is_text(field: T.StructField) -> bool:
    return isinstance(field.dataType, (T.StringType, T.CharType, T.VarcharType))


def is_numeric(field: T.StructField) -> bool:
    return isinstance(field.dataType, T.NumericType)


def is_fractional(field: T.StructField) -> bool:
    return isinstance(field.dataType, (T.FloatType, T.DoubleType))


def is_temporal(field: T.StructField) -> bool:
    return isinstance(field.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType))


def is_nested(field: T.StructField) -> bool:
    return isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType, T.VariantType))


def present(field: T.StructField) -> Column:
    """The column with NaN read as null, as in every count of this package."""
    c = col(field.name)
    if is_fractional(field):
        return F.nanvl(c, F.lit(None).cast(field.dataType))
    return c


def as_text(field: T.StructField) -> Column:
    """Text that is equal exactly when two values are equal."""
    c = present(field)
    if is_text(field):
        return c
    if is_fractional(field):
        return (c + F.lit(0).cast(field.dataType)).cast("string")
    if isinstance(field.dataType, T.BinaryType):
        return F.base64(c)
    if is_nested(field):
        return F.when(c.isNotNull(), F.to_json(F.struct(c.alias("v")), {"ignoreNullFields": "false"}))
    return c.cast("string")


def long_form(df: DataFrame, fields, by: Sequence[str] = (), keys: Sequence[str] = (), value=as_text) -> DataFrame:
    """One row per cell: ``by..., keys..., column_name, value``; null cells left out.

    A single Expand over the scan: no shuffle, and only the named columns are read.
    """
    ids = list(dict.fromkeys([*by, *keys]))
    if not fields:
        empty = df.select(*[col(c) for c in ids], F.lit("").alias("column_name"), F.lit("").alias("value"))
        return empty.where(F.lit(False))
    # Ids are renamed, so that a column may be an id and a value at once.
    flat = df.select(
        *[col(c).alias(f"__id_{i}") for i, c in enumerate(ids)],
        *[value(f).alias(f.name) for f in fields],
    )
    melted = flat.unpivot(
        [f"__id_{i}" for i in range(len(ids))], [quoted(f.name) for f in fields], "column_name", "value"
    )
    return melted.where(F.col("value").isNotNull()).select(
        *[F.col(f"__id_{i}").alias(c) for i, c in enumerate(ids)], "column_name", "value"
    )


def no_rows(df: DataFrame, by: Sequence[str], schema: str) -> DataFrame:
    """An empty result with the grouping columns of ``df`` before those of ``schema``."""
    empty = df.sparkSession.createDataFrame([], schema)
    return df.sparkSession.createDataFrame([], T.StructType([df.schema[b] for b in by] + empty.schema.fields))


def order_key(names) -> Column:
    """One comparable value for an ordering of several columns."""
    names = as_list(names)
    if not names:
        raise ValueError("a row_key is needed to know which rows come first")
    return col(names[0]) if len(names) == 1 else F.struct(*[col(n) for n in names])


def dtype_label(field: T.StructField) -> str:
    return field.dataType.simpleString()


def percent(part, whole) -> Column:
    """``100 * part / whole``, 0 when there is nothing to divide by."""
    part, whole = (F.col(x) if isinstance(x, str) else x for x in (part, whole))
    return F.coalesce(F.try_divide(part * F.lit(100.0), whole), F.lit(0.0))


def sql_text(value: str) -> str:
    """A string literal of Spark SQL."""
    return "'" + "".join(c if c.isalnum() and c.isascii() else f"\\u{ord(c):04x}" if ord(c) < 65536 else f"\\U{ord(c):08x}" for c in value) + "'"
