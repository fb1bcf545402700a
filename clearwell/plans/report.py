"""The sections of a report, each a small DataFrame."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import settings as S
from ..columns import col
from ..operators.profile import null_status, utilization_status
from .analysis import Analysis
from .findings import CATEGORIES


def or_no_findings(df: DataFrame, column: str, sources: DataFrame | None = None, by=()) -> DataFrame:
    """The section, with a row saying that nothing was found: one for each source without rows, or one for the table."""
    by = list(by)
    if by:
        names = [f"__s{i}" for i in range(len(by))]
        found = df.select(*[col(b).alias(n) for b, n in zip(by, names)]).distinct()
        empty = sources.select(*[col(b) for b in by]).distinct().join(found, same_keys(by, names), "left_anti")
    else:
        empty = df.agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") == 0)
    row = empty.select(*[
        col(c) if c in by else (F.lit(S.NO_FINDINGS) if c == column else F.lit(None)).cast(df.schema[c].dataType).alias(c)
        for c in df.columns
    ])
    return df.unionByName(row)


def same_keys(by, names):
    """Null-safe equality of grouping columns and their copies under other names."""
    return reduce(lambda a, b: a & b, [col(b).eqNullSafe(F.col(n)) for b, n in zip(by, names)])


def _with_severity(table: DataFrame, severity: DataFrame, by) -> DataFrame:
    """Issue counts beside each source; a source without issues has zeros, a null source is one like any other."""
    counts = [c for c in severity.columns if c not in by]
    names = [f"__s{i}" for i in range(len(by))]
    right = severity.select(*[col(b).alias(n) for b, n in zip(by, names)], *[F.col(c) for c in counts])
    joined = table.join(right, same_keys(by, names), "left").drop(*names)
    return joined.withColumns({c: F.coalesce(F.col(c), F.lit(0)) for c in counts})


def _round(name: str):
    return F.round(name, 2).alias(name)


def report_tables(a: Analysis, samples: DataFrame | None = None) -> dict[str, DataFrame]:
    """Section name -> rows. Percentages are rounded to two places here only."""
    m, by = a.metrics, list(a.metrics.by)
    columns = m.columns
    advice = {c: a.recommendations.where(F.col("category") == c).drop("category") for c in CATEGORIES}
    summary = _with_severity(m.table, a.severity, by) if by else m.table.crossJoin(F.broadcast(a.severity))
    noted = lambda df, column: or_no_findings(df, column, m.table, by)
    tables = {
        "summary": summary.withColumns({c: F.round(c, 2) for c in ("null_percent", "complete_percent", "duplicate_percent")}),
        "general_info": columns.groupBy(*by).agg(
            F.max("rows").alias("rows"), F.count(F.lit(1)).alias("columns"),
            F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "column_name"))),
                                     lambda x: x["column_name"]), ", ").alias("column_names"),
        ),
        "nulls": noted(
            columns.where(F.col("null_count") > 0).select(
                *by, "column_name", "null_count", _round("null_percent"), _round("utilization_percent"),
                null_status("null_percent").alias("status")), "status"),
        "rows_and_utilization": columns.select(
            *by, "column_name", _round("utilization_percent"), utilization_status("utilization_percent").alias("status")),
        "row_completeness": m.table.select(*by, "rows", "complete_rows", _round("complete_percent"), "rows_with_nulls"),
        "duplicates": m.table.select(*by, "rows", "duplicate_rows", _round("duplicate_percent")),
        "column_profile": columns.select(
            *by, "column_name", "dtype", "hint", "non_null", "null_count", _round("null_percent"), "unique_count",
            F.round(F.col("cardinality_ratio") * 100, 2).alias("cardinality_percent"), "min", "max", "mean", "median", "std"),
        "validations": noted(
            m.contents.select(*by, "validator", "column_name", "valid_count", "invalid_count", _round("invalid_percent"),
                              F.when(F.col("is_problematic"), "PROBLEMÁTICO").otherwise("OK").alias("status")), "status"),
        "cleaning": noted(advice["cleaning"], "detail"),
        "database_rules": noted(advice["database_rules"], "detail"),
        "normalization": noted(advice["normalization"], "detail"),
        "quality": noted(advice["quality"], "detail"),
        "filters": noted(a.filters, "filter_sql"),
        "issues": noted(a.issues, "detail"),
    }
    if samples is not None:
        tables["samples"] = samples
    return tables
