"""Table and column metrics that need one pass over the data.

Everything countable is computed by one wide aggregate: each task folds its
rows into a single buffer and only that buffer is shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import settings as S
from ..columns import (
    COLUMNS_PER_AGGREGATE, as_list, as_text, col, dtype_label, is_nested, is_numeric, is_temporal, is_text, no_rows,
    percent, present, profiled_fields, quoted, sql_text,
)
from ..functions import has_sql_unsafe_chars, name_hint_column, trim_space
from .frequency import distinct_counts
from .quantiles import exact_median

_NUMBER = "double"


def _measures(field, approx: bool, which: set[str]) -> dict[str, Column]:
    """Aggregates of one column by metric name."""
    c = present(field)
    out = {"non_null": F.count(c)}
    if "blanks" in which:
        out["blank_count"] = (
            F.count_if(trim_space(c) == "") if is_text(field) else F.lit(None).cast("bigint")
        )
    if "bytes" in which:
        out["bytes"] = F.coalesce(
            F.sum(F.octet_length(as_text(field)).cast("bigint")), F.lit(0).cast("bigint")
        )
    if "stats" in which:
        numeric = c.cast(_NUMBER) if is_numeric(field) else None
        for name, fn in (("min", F.min), ("max", F.max), ("mean", F.avg), ("std", F.stddev_samp)):
            out[name] = F.lit(None).cast(_NUMBER) if numeric is None else fn(numeric)
    if "signs" in which:
        numeric = c.cast(_NUMBER) if is_numeric(field) else None
        out["negative_count"] = F.lit(None).cast("bigint") if numeric is None else F.count_if(numeric < 0)
        out["zero_count"] = F.lit(None).cast("bigint") if numeric is None else F.count_if(numeric == 0)
    if "unsafe" in which:
        # Numbers, dates and booleans are written without any of these characters.
        plain = is_numeric(field) or is_temporal(field) or isinstance(field.dataType, T.BooleanType)
        out["unsafe_count"] = F.count_if(F.lit(False) if plain else has_sql_unsafe_chars(as_text(field)))
    if approx:
        # A 16,384-bucket sketch: about 0.8 percent standard error, one binary buffer.
        # It is fed hashes, so that no value has to be turned into text.
        hashed = F.when(c.isNotNull(), F.xxhash64(as_text(field) if is_nested(field) else c))
        out["unique_count"] = F.hll_sketch_estimate(F.hll_sketch_agg(hashed, 14))
        out["median"] = (
            F.kll_sketch_get_quantile_double(F.kll_sketch_agg_double(c.cast(_NUMBER), 800), F.lit(0.5))
            if is_numeric(field) else F.lit(None).cast(_NUMBER)
        )
    return out


def _column_scan(df: DataFrame, fields, by: Sequence[str], which: set[str], approx=False) -> DataFrame:
    """``by..., position, column_name, dtype, rows, <metrics>``, one row per column.

    With ``"table"`` the row of position 0 also carries the table's null cells
    and complete rows; the scans of further columns need not read all of them.
    """
    parts = []
    table = {}
    if "table" in which:
        nulls = _null_cells(profiled_fields(df, None, by))
        table = {"null_cells": F.coalesce(F.sum(nulls), F.lit(0)).cast("bigint"), "complete_rows": F.count_if(nulls == 0)}
    place = {f.name: i for i, f in enumerate(profiled_fields(df, None, by))}
    placed = [(place[f.name], f) for f in fields]
    for start in range(0, len(placed), COLUMNS_PER_AGGREGATE):
        chunk = placed[start:start + COLUMNS_PER_AGGREGATE]
        measures = {i: _measures(f, approx, which) for i, f in chunk}
        wide = df.groupBy(*[col(b) for b in by]).agg(
            F.count(F.lit(1)).alias("__rows"),
            *[m.alias(f"__{name}") for name, m in table.items() if not start],
            *[m.alias(f"__{i}_{name}") for i, ms in measures.items() for name, m in ms.items()],
        )
        rows = ", ".join(
            f"named_struct('position', {i}, 'column_name', {sql_text(f.name)}, 'dtype', {sql_text(dtype_label(f))}, "
            + "'rows', __rows, " + "".join(f"'{name}', {'CAST(NULL AS BIGINT)' if start else f'__{name}'}, " for name in table)
            + ", ".join(f"'{name}', __{i}_{name}" for name in measures[i]) + ")"
            for i, f in chunk
        )
        parts.append(wide.select(*[col(b) for b in by], F.expr(f"inline(array({rows}))")))
    return reduce(DataFrame.unionByName, parts)


def _null_cells(fields) -> Column:
    """How many cells of a row are null."""
    return reduce(lambda a, b: a + b, [present(f).isNull().cast("int") for f in fields], F.lit(0))


def _nulls(scan: DataFrame) -> DataFrame:
    share = percent(F.col("rows") - F.col("non_null"), "rows")
    return (
        scan.withColumn("null_count", F.col("rows") - F.col("non_null"))
        .withColumn("null_percent", share)
        .withColumn("utilization_percent", F.when(F.col("rows") > 0, 100.0 - share).otherwise(0.0))
    )


def null_profile(df: DataFrame, columns=None, by=()) -> DataFrame:
    """Null count, null percent and utilisation of every column, with both verdicts."""
    by = as_list(by)
    scan = _nulls(_column_scan(df, profiled_fields(df, columns, by), by, set()))
    return scan.select(
        *[col(b) for b in by], "position", "column_name", "dtype", "rows", "non_null",
        "null_count", "null_percent", "utilization_percent",
        null_status("null_percent").alias("status"),
        utilization_status("utilization_percent").alias("utilization_status"),
    )


def null_status(c) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return (
        F.when(c >= S.NULL_CRITICAL_PERCENT, S.CRITICAL)
        .when(c >= S.NULL_SEVERE_PERCENT, S.SEVERE)
        .otherwise(S.OK)
    )


def utilization_status(c) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return (
        F.when(c < S.UTILISATION_CRITICAL_PERCENT, S.CRITICAL)
        .when(c < S.UTILISATION_LOW_PERCENT, S.LOW)
        .otherwise(S.ACCEPTABLE)
    )


def problem_columns(nulls: DataFrame) -> DataFrame:
    """Columns at or above the null threshold, from :func:`null_profile`."""
    return nulls.where(F.col("null_percent") >= S.NULL_SEVERE_PERCENT)


def null_report(nulls: DataFrame) -> DataFrame:
    """Columns with nulls, most nulls first."""
    return nulls.where(F.col("null_count") > 0).orderBy(F.desc("null_count"), "column_name")


def blank_strings(df: DataFrame, columns=None, by=()) -> DataFrame:
    """Text columns holding empty or white-space-only values; nulls do not count."""
    by = as_list(by)
    fields = [f for f in profiled_fields(df, columns, by) if is_text(f)]
    if not fields:
        schema = "position int, column_name string, rows bigint, blank_count bigint, blank_percent double"
        return no_rows(df, by, schema)
    return (
        _column_scan(df, fields, by, {"blanks"})
        .where(F.col("blank_count") > 0)
        .select(
            *[col(b) for b in by], "position", "column_name", "rows", "blank_count",
            percent("blank_count", "rows").alias("blank_percent"),
        )
    )


def column_bytes(df: DataFrame, columns=None, by=()) -> DataFrame:
    """Bytes of the values of each column written as text."""
    by = as_list(by)
    return _column_scan(df, profiled_fields(df, columns, by), by, {"bytes"}).select(
        *[col(b) for b in by], "position", "column_name", "dtype", "bytes"
    )


def numeric_stats(df: DataFrame, columns=None, by=(), approx: bool = False) -> DataFrame:
    """min, max, mean, median and sample standard deviation of numeric columns."""
    by = as_list(by)
    fields = [f for f in profiled_fields(df, columns, by) if is_numeric(f)]
    scan = _column_scan(df, fields, by, {"stats"}, approx)
    if not approx:
        scan = _attach(scan, exact_median(df, [f.name for f in fields], by), by)
    return scan.select(
        *[col(b) for b in by], "position", "column_name", "non_null", "min", "max", "mean", "median", "std",
        F.lit(approx).alias("is_approximate"),
    )


def _attach(left: DataFrame, right: DataFrame, by: Sequence[str]) -> DataFrame:
    """Join two metric tables on (by, column_name), grouping nulls included."""
    names = [*by, "column_name"]
    renamed = right.select(
        *[col(n).alias(f"__k{i}") for i, n in enumerate(names)],
        *[col(c) for c in right.columns if c not in names],
    )
    if not by:
        # One row per column of the schema, so the size is known to be small.
        renamed = F.broadcast(renamed)
    condition = reduce(
        lambda a, b: a & b,
        [left[quoted(n)].eqNullSafe(renamed[f"__k{i}"]) for i, n in enumerate(names)],
    )
    return left.join(renamed, condition, "left").drop(*[f"__k{i}" for i in range(len(names))])


def column_profile(df: DataFrame, columns=None, by=(), approx: bool = False, distinct: bool = True,
                   sizes: bool = False) -> DataFrame:
    """The full metric table: one row per column.

    ``approx`` swaps the exact distinct counts and medians for sketches inside
    the same aggregate, so the whole profile is a single pass.
    ``distinct=False`` leaves both out. ``sizes`` adds the bytes of each column,
    which takes turning every value into text.
    """
    by = as_list(by)
    fields = profiled_fields(df, columns, by)
    which = {"blanks", "stats"} | ({"bytes"} if sizes else set())
    scan = _nulls(_column_scan(df, fields, by, which, approx and distinct))
    if distinct and not approx:
        scan = _attach(scan, distinct_counts(df, [f.name for f in fields], by), by)
        numeric = [f.name for f in fields if is_numeric(f)]
        if numeric:
            scan = _attach(scan, exact_median(df, numeric, by), by)
        else:
            scan = scan.withColumn("median", F.lit(None).cast(_NUMBER))
        scan = scan.withColumn("unique_count", F.coalesce("unique_count", F.lit(0).cast("bigint")))
    if not distinct:
        scan = scan.withColumn("unique_count", F.lit(None).cast("bigint")).withColumn(
            "median", F.lit(None).cast(_NUMBER)
        )
    return profile_rows(scan, by, approx, sizes)


def profile_rows(scan: DataFrame, by: Sequence[str], approx: bool = False, sizes: bool = False) -> DataFrame:
    """The metric table from a scan that has its distinct counts and medians."""
    null_as_value = (F.col("null_count") > 0).cast("int")
    cardinality = F.when(F.col("rows") > 0, (F.col("unique_count") + null_as_value) / F.col("rows"))
    cardinality = F.least(cardinality, F.lit(1.0)) if approx else cardinality
    return scan.select(
        *[col(b) for b in by], "position", "column_name", "dtype",
        name_hint_column("column_name").alias("hint"),
        "rows", "non_null", "null_count", "null_percent", "utilization_percent",
        "blank_count",
        F.when(F.col("blank_count").isNotNull(), percent("blank_count", "rows")).alias("blank_percent"),
        "unique_count",
        F.when(F.col("unique_count").isNotNull(), F.coalesce(cardinality, F.lit(0.0))).alias("cardinality_ratio"),
        "min", "max", "mean", "median", "std", *(["bytes"] if sizes else []),
        F.lit(approx).alias("is_approximate"),
    )


def high_cardinality(columns: DataFrame, threshold: float = S.HIGH_CARDINALITY) -> DataFrame:
    """Columns whose share of distinct values reaches the threshold, highest first."""
    return columns.where(F.col("cardinality_ratio") >= threshold).orderBy(
        F.desc("cardinality_ratio"), "column_name"
    )


def table_info(df: DataFrame, by=()) -> DataFrame:
    """Rows, columns, cells, and the names and types of the columns."""
    by = as_list(by)
    fields = profiled_fields(df, None, by)
    return df.groupBy(*[col(b) for b in by]).agg(F.count(F.lit(1)).alias("rows")).select(
        *[col(b) for b in by], "rows",
        F.lit(len(fields)).cast("bigint").alias("columns"),
        (F.col("rows") * len(fields)).alias("cells"),
        F.lit(", ".join(f.name for f in fields)).alias("column_names"),
        F.lit(", ".join(dtype_label(f) for f in fields)).alias("dtypes"),
    )


def row_completeness(df: DataFrame, columns=None, by=()) -> DataFrame:
    """Null cells and complete rows of the table, in one pass."""
    by = as_list(by)
    fields = profiled_fields(df, columns, by)
    agg = (
        df.select(*[col(b) for b in by], _null_cells(fields).alias("__nulls"))
        .groupBy(*[col(b) for b in by])
        .agg(
            F.count(F.lit(1)).alias("rows"),
            F.coalesce(F.sum("__nulls"), F.lit(0)).cast("bigint").alias("null_cells"),
            F.count_if(F.col("__nulls") == 0).alias("complete_rows"),
        )
    )
    return completeness_rows(agg, len(fields), by)


def completeness_rows(agg: DataFrame, columns: int, by: Sequence[str]) -> DataFrame:
    """The completeness table from ``rows, null_cells, complete_rows``."""
    cells = F.col("rows") * columns
    return agg.select(
        *[col(b) for b in by], "rows",
        F.lit(columns).cast("bigint").alias("columns"),
        cells.alias("cells"),
        "null_cells",
        percent(F.col("null_cells"), cells).alias("null_percent"),
        "complete_rows",
        percent("complete_rows", "rows").alias("complete_percent"),
        (F.col("rows") - F.col("complete_rows")).alias("rows_with_nulls"),
    )
