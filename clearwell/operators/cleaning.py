"""Clean tables and quarantine tables.

Every column gets an expression for its clean value and one for whether the
source value is acceptable. Both outputs are projections of the same source:
no shuffle, no state, one row in and one row out.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import settings as S
from ..columns import as_list, as_text, col, is_temporal, is_text, present, profiled_fields
from ..functions import (
    is_email, normalize_boolean, normalize_email, normalize_number, parse_date, parse_timestamp, trim_space,
)
from ..functions.names import is_business_key
from ..runtime import scratch_path
from . import semantics as M
from .duplicates import distinct_rows, keep_first
from .profile import null_profile

#: Partitions whose row counts are broadcast; more are joined by shuffle.
MOST_OFFSETS = 200_000


@dataclass(frozen=True)
class _Plan:
    """How one column is cleaned; ``read`` is what takes effort, done once."""

    name: str
    read: Column
    value: Callable[[Column], Column]
    ok: Callable[[Column], Column] | None = None
    category: str | None = None
    is_date: bool = False


def _column_plan(field, kind: M.ColumnType) -> _Plan:
    """Clean value and validity of one column; blank is always valid."""
    c = col(field.name)
    if not is_text(field):
        # Already typed: nothing can fail, dates take part in range checks.
        return _Plan(field.name, present(field), lambda r: r, is_date=is_temporal(field))
    t = trim_space(c)
    blank = c.isNull() | (t == "")

    def checked(read, category, value=lambda r: r, ok=lambda r: r.isNotNull(), is_date=False):
        return _Plan(
            field.name, read, lambda r: F.when(~blank, value(r)),
            lambda r: blank | F.coalesce(ok(r), F.lit(False)), category, is_date,
        )

    if kind.semantic == M.INTEGER:
        # Whether a number is whole is read from its text, before anything is rounded.
        whole = lambda r: F.regexp_replace(r, r"\.0*$", "").try_cast("bigint")
        return checked(normalize_number(c), S.BAD_NUMBER, value=whole, ok=lambda r: r.rlike(r"^-?[0-9]*\.?0*$") & whole(r).isNotNull())
    if kind.semantic == M.FLOAT:
        precision, scale = kind.precision or 38, kind.scale if kind.scale is not None else 10
        number = lambda r: r.try_cast(f"decimal({precision},{scale})")
        return checked(
            normalize_number(c), S.BAD_NUMBER, value=number,
            ok=lambda r: number(r).isNotNull() & (M.fraction_digits(r) <= scale),  # nothing is rounded away
        )
    if kind.semantic == M.DATE:
        return checked(parse_date(c), S.BAD_DATE, is_date=True)
    if kind.semantic == M.DATETIME:
        return checked(parse_timestamp(c), S.BAD_DATE, is_date=True)
    if kind.semantic == M.BOOLEAN:
        return checked(normalize_boolean(c), S.BAD_BOOLEAN)
    if kind.semantic == M.EMAIL:
        return _Plan(
            field.name, normalize_email(c), lambda r: r, lambda r: blank | is_email(r), S.BAD_EMAIL
        )
    return _Plan(field.name, t, lambda r: r)


def _range_pair(plans: list[_Plan]) -> tuple[int, int] | None:
    by_name = {p.name.lower(): i for i, p in enumerate(plans) if p.is_date}
    for start, end in S.DATE_RANGE_PAIRS:
        if start in by_name and end in by_name:
            return by_name[start], by_name[end]
    return None


def _staged(df: DataFrame, types: list[M.ColumnType]):
    """Source, then values, then flags, as three projections.

    A value read with effort is an input column of the flags, so it is read once.
    """
    kinds = {t.name: t for t in types}
    fields = profiled_fields(df)
    plans = [_column_plan(f, kinds.get(f.name, M.ColumnType(f.name, M.TEXT))) for f in fields]
    names = [f.name for f in fields]
    read = df.select(
        F.struct(*[col(n) for n in names]).alias("__row"), *[col(n) for n in names],
        *[p.read.alias(f"__r{i}") for i, p in enumerate(plans)],
    )
    valued = read.select(
        "__row",
        *[p.value(F.col(f"__r{i}")).alias(f"__v{i}") for i, p in enumerate(plans)],
        *[p.ok(F.col(f"__r{i}")).alias(f"__k{i}") for i, p in enumerate(plans) if p.category],
    )
    ok = {i: F.col(f"__k{i}") for i, p in enumerate(plans) if p.category}
    category = {i: p.category for i, p in enumerate(plans)}
    pair = _range_pair(plans)
    if pair:
        start, end = pair
        ordered = F.coalesce(F.col(f"__v{end}") >= F.col(f"__v{start}"), F.lit(True))
        ok[end] = ok.get(end, F.lit(True)) & ordered
        category[end] = S.BAD_DATE_RANGE
    return valued, fields, ok, category


def clean_rows(df: DataFrame, types: list[M.ColumnType] | None = None) -> DataFrame:
    """Rows in which every column is acceptable, with typed and tidied values."""
    types = M.column_types(df) if types is None else types
    valued, fields, ok, _ = _staged(df, types)
    values = [F.col(f"__v{i}").alias(f.name) for i, f in enumerate(fields)]
    if not ok:
        return valued.select(*values)
    keep = reduce(lambda a, b: a & b, ok.values())
    # As a generator, not a filter: a filter would be pushed below the values
    # and read every one of them a second time.
    return valued.select(F.inline(F.when(keep, F.array(F.struct(*values)))))


def quarantine_rows(df: DataFrame, types: list[M.ColumnType] | None = None, source: str | None = None) -> DataFrame:
    """One row per failed column: why, the original value and the whole row as JSON.

    All failed columns of a row come from the same scan.
    """
    types = M.column_types(df) if types is None else types
    valued, fields, ok, category = _staged(df, types)
    failures = F.filter(
        F.array(*[
            F.struct(
                F.lit(fields[i].name).alias("column_name"), F.lit(category[i]).alias("category"),
                F.col("__row")[fields[i].name].cast("string").alias("original_value"), c.alias("ok"),
            )
            for i, c in ok.items()
        ]),
        lambda x: ~x["ok"],
    ) if ok else F.expr(
        "cast(array() as array<struct<column_name:string,category:string,original_value:string,ok:boolean>>)"
    )
    fail = reduce(lambda a, b: a | b, [~c for c in ok.values()], F.lit(False))
    # The rejected rows are few; only they are written as JSON.
    return valued.select("__row", F.inline(F.when(fail, failures))).select(
        F.current_timestamp().alias("rejected_at"), "column_name", "category", "original_value",
        F.to_json("__row", {"ignoreNullFields": "false"}).alias("row_json"),
        F.lit(source).cast("string").alias("source"),
    )


def clean_and_quarantine(
    df: DataFrame, types: list[M.ColumnType] | None = None, overrides: dict[str, str] | None = None,
    source: str | None = None, drop_duplicates: bool = False, drop_critical_nulls: bool = False, row_key=None,
) -> tuple[DataFrame, DataFrame]:
    """``(clean, quarantine)`` of a table; duplicates and sparse rows stay by default."""
    df = prepare(df, drop_duplicates, drop_critical_nulls, row_key)
    types = M.column_types(df, overrides) if types is None else types
    return clean_rows(df, types), quarantine_rows(df, types, source)


def critical_columns(df: DataFrame) -> list[str]:
    """Columns that are at least 40 percent null: one small row per column is collected."""
    nulls = null_profile(df).where(F.col("null_percent") >= S.NULL_SEVERE_PERCENT)
    return [r["column_name"] for r in nulls.select("column_name").collect()]


def drop_critical_null_rows(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    columns = critical_columns(df) if columns is None else columns
    return df.na.drop("any", subset=columns) if columns else df


def prepare(df, drop_duplicates=True, drop_critical_nulls=True, row_key=None) -> DataFrame:
    columns = critical_columns(df) if drop_critical_nulls else []
    if drop_duplicates:
        df = keep_first(df, row_key) if row_key else distinct_rows(df)
    return drop_critical_null_rows(df, columns) if columns else df


def clean(df: DataFrame, overrides: dict[str, str] | None = None, row_key=None) -> DataFrame:
    """Dedupe, drop rows null in critical columns, trim and type every column.

    Values that cannot be read become null; no row is rejected for them.
    """
    types = M.column_types(df, overrides)
    ready = prepare(df, True, True, row_key)
    valued, fields, _, _ = _staged(ready, types)
    return valued.select(*[F.col(f"__v{i}").alias(f.name) for i, f in enumerate(fields)])


def with_surrogate_key(df: DataFrame, name: str = "id", dense: bool = False) -> DataFrame:
    """Add a generated key: unique, or numbered 1..n without gaps.

    Dense numbers add the row count of the partitions before to the position
    inside the partition, so no task sees more than its own rows. Generated ids
    differ between two evaluations of a plan, so the rows are first written to
    the shared folder with their ids; counts and numbers are taken from there.
    """
    keyed = df.withColumn("__id", F.monotonically_increasing_id())
    if not dense:
        return keyed.withColumn(name, F.col("__id") + 1).drop("__id")
    bits = 33
    spark = df.sparkSession
    path = scratch_path(spark, "keyed")
    # Names a file format may refuse are replaced while the rows are outside.
    outside = [f"c{i}" for i in range(len(df.columns))]
    keyed.withColumn("__part", F.shiftright("__id", bits)).toDF(*outside, "__id", "__part").write.parquet(path)
    fixed = spark.read.parquet(path)
    counts = fixed.groupBy("__part").agg(F.count(F.lit(1)).alias("__rows"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    # One row per partition of the data.
    offsets = counts.select("__part", F.coalesce(F.sum("__rows").over(before), F.lit(0)).alias("__offset"))
    if counts.count() <= MOST_OFFSETS:
        offsets = F.broadcast(offsets)
    number = F.col("__offset") + F.col("__id") - F.shiftleft(F.col("__part"), bits) + 1
    return fixed.join(offsets, "__part").select(*outside, number.alias("__number")).toDF(*df.columns, name)


def business_keys(df: DataFrame) -> list[str]:
    return [c for c in df.columns if is_business_key(c)]


def quarantine_summary(quarantine: DataFrame) -> DataFrame:
    """Errors per column and category, most errors first."""
    return (
        quarantine.groupBy("column_name", "category").agg(F.count(F.lit(1)).alias("total_errors"))
        .orderBy(F.desc("total_errors"), "column_name", "category")
    )


def post_load_checks(clean_table: DataFrame, quarantine: DataFrame) -> DataFrame:
    """Row counts of both tables and the nulls of each clean column, as (check, subject, value)."""
    fields = profiled_fields(clean_table)
    wide = clean_table.agg(
        F.count(F.lit(1)).alias("__n"), *[F.count_if(present(f).isNull()).alias(f"__c{i}") for i, f in enumerate(fields)]
    )
    rows = [F.struct(F.lit("clean_rows").alias("check"), F.lit("table").alias("subject"), F.col("__n").alias("value"))]
    rows += [
        F.struct(F.lit("null_values").alias("check"), F.lit(f.name).alias("subject"), F.col(f"__c{i}").alias("value"))
        for i, f in enumerate(fields)
    ]
    rejected = quarantine.agg(F.count(F.lit(1)).alias("value")).select(
        F.lit("quarantine_rows").alias("check"), F.lit("table").alias("subject"), "value"
    )
    return wide.select(F.inline(F.array(*rows))).unionByName(rejected)


def repeated_keys(clean_table: DataFrame, columns=None) -> DataFrame:
    """Groups of equal values in the given (default: first three) columns."""
    columns = as_list(columns) or clean_table.columns[:3]
    return clean_table.groupBy(*[col(c) for c in columns]).agg(F.count(F.lit(1)).alias("count_duplicates")).where(
        F.col("count_duplicates") > 1
    )
