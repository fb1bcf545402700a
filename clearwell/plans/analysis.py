"""The whole analysis of one table or of many."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..columns import col
from ..operators.validation import validation_summary
from ..runtime import settle, shared_folder
from .findings import (
    Metrics, issues, recommendations, severity_counts, suggested_filters,
)
from .shared import shared_scans


def table_metrics(df: DataFrame, by=()) -> DataFrame:
    """Rows, null cells, complete rows and duplicate rows of a table."""
    return shared_scans(df, by, full=False).table()


def collect_metrics(df: DataFrame, by=(), approx: bool = False, settled: bool = True) -> Metrics:
    """All metric tables, from two passes over the table and those of the medians.

    The passes run at once and leave a few rows for each column in the
    checkpoint folder; ``settled=False`` keeps them lazy, and every table that is
    read runs its pass again.
    """
    scans = shared_scans(df, by, approx=approx)
    return (scans.settled() if settled else scans).metrics()


def issue_metrics(df: DataFrame, by=(), settled: bool = True) -> Metrics:
    """The metric tables behind :func:`issues`.

    Issues need neither distinct counts nor medians, which saves a shuffle of
    all values and the scans of the medians.
    """
    scans = shared_scans(df, by, full=False)
    return (scans.settled() if settled else scans).metrics()


@dataclass
class Analysis:
    """Metric tables and everything derived from them."""

    metrics: Metrics
    issues: DataFrame
    severity: DataFrame
    recommendations: DataFrame
    filters: DataFrame
    summary: DataFrame


def analyze(df: DataFrame, by=(), approx: bool = False, settled: bool = True) -> Analysis:
    """Profile, validate, classify and advise.

    The table is read twice, whatever the number of metric tables, and by the steps of the exact medians (``approx`` has none). What the passes leave
    is small and read by many reports, so it is written to the checkpoint folder
    once; the table itself is never cached.
    """
    return analysis_of(collect_metrics(df, by, approx, settled))


def analysis_of(m: Metrics) -> Analysis:
    """Everything that follows from metric tables."""
    found = issues(m)
    return Analysis(
        metrics=m, issues=found, severity=severity_counts(found, m.by),
        recommendations=recommendations(m), filters=suggested_filters(m),
        summary=validation_summary(m.contents, m.numeric, m.text, m.by),
    )


SUMMARY_COLUMNS = (
    "source_name string, status string, error string, sheet_name string, analysis_mode string, "
    "approximate_statistics boolean, rows bigint, columns bigint, total_null_cells bigint, "
    "null_percent_overall double, duplicate_rows bigint, duplicate_percent double, "
    "critical_issues bigint, severe_issues bigint, warning_issues bigint"
)


def batch_row(df: DataFrame, name: str, mode: str = "direct", sheet: str = "") -> DataFrame:
    """The summary row of one source."""
    m = issue_metrics(df)
    counts = severity_counts(issues(m))
    return m.table.crossJoin(F.broadcast(counts)).select(  # one row each
        F.lit(name).alias("source_name"), F.lit("ok").alias("status"), F.lit("").alias("error"),
        F.lit(sheet).alias("sheet_name"), F.lit(mode).alias("analysis_mode"),
        F.lit(False).alias("approximate_statistics"), "rows", "columns",
        F.col("null_cells").alias("total_null_cells"), F.col("null_percent").alias("null_percent_overall"),
        "duplicate_rows", "duplicate_percent",
        F.col("critical").alias("critical_issues"), F.col("severe").alias("severe_issues"),
        F.col("warnings").alias("warning_issues"),
    )


def error_row(spark: SparkSession, name: str, error: str, sheet: str = "") -> DataFrame:
    row = (name, "error", error, sheet, "", False, 0, 0, 0, 0.0, 0, 0.0, 0, 0, 0)
    return spark.createDataFrame([row], SUMMARY_COLUMNS)


def summarize_batch(spark: SparkSession, sources: dict, parallel: int = 4) -> DataFrame:
    """One row per source; a source that cannot be read becomes an error row.

    ``sources``: name -> DataFrame, or a function of the session that returns one.
    Each source is a job of its own, so a file that breaks in the middle spoils
    only its row; ``parallel`` jobs run side by side. For many sources of one
    layout :func:`summarize_grouped` is a single job.
    """

    def row(item) -> DataFrame:
        name, source = item
        try:
            df = source(spark) if callable(source) else source
            return settle(batch_row(df, name))
        except Exception as error:  # noqa: BLE001 - one bad source must not stop the others
            return error_row(spark, name, str(error).split("\n")[0])

    if not sources:
        raise ValueError("no sources")
    shared_folder(spark)
    with ThreadPoolExecutor(parallel) as pool:
        return reduce(DataFrame.unionByName, pool.map(row, sources.items()))


def summarize_grouped(df: DataFrame, by: str = "source_name") -> DataFrame:
    """Summary rows of many sources of one layout, in one job grouped by source."""
    return _summary_rows(issue_metrics(df, by), by)


def _summary_rows(m: Metrics, by: str) -> DataFrame:
    counts = severity_counts(issues(m), by).withColumnRenamed(by, "__by")
    joined = m.table.join(counts, col(by).eqNullSafe(F.col("__by")), "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("bigint"))
    return joined.select(
        col(by).alias("source_name"), F.lit("ok").alias("status"), F.lit("").alias("error"),
        F.lit("").alias("sheet_name"), F.lit("grouped").alias("analysis_mode"),
        F.lit(False).alias("approximate_statistics"), "rows", "columns",
        F.col("null_cells").alias("total_null_cells"), F.col("null_percent").alias("null_percent_overall"),
        "duplicate_rows", "duplicate_percent", zero("critical").alias("critical_issues"),
        zero("severe").alias("severe_issues"), zero("warnings").alias("warning_issues"),
    )


@dataclass
class BatchAnalysis:
    """The analyses of many sources, and a summary row for each source, failed ones included.

    ``analysis`` holds every metric table, issue, recommendation and filter with
    the source's name in ``source_name``; it is None where no source could be read.
    """

    analysis: Analysis | None
    summary: DataFrame


def analyze_many(spark: SparkSession, sources: dict, approx: bool = False, parallel: int = 4) -> BatchAnalysis:
    """Analyse every source; one that fails becomes an error row and spoils no other.

    ``sources``: name (None is a name like any other) -> DataFrame, or a function
    of the session that returns one. Sources of equal columns and types share
    their passes: one union, grouped by source. Where such a group fails, it is
    halved until the failing sources stand alone, so a bad file among n costs
    some ``log2(n)`` passes more. Groups run side by side.
    """
    if not sources:
        raise ValueError("no sources")
    by = "source_name"
    frames: dict = {}
    failed: dict = {}
    for name, source in sources.items():
        try:
            frames[name] = source(spark) if callable(source) else source
            if by in frames[name].columns:
                raise ValueError(f"the column name {by} is taken")
        except Exception as error:  # noqa: BLE001 - one bad source must not stop the others
            frames.pop(name, None)
            failed[name] = error
    layouts: dict[tuple, list] = {}
    for name, df in frames.items():
        layouts.setdefault(tuple((f.name, f.dataType.simpleString()) for f in df.schema.fields), []).append(name)

    def label(df: DataFrame, name) -> DataFrame:
        return df.withColumn(by, F.lit(name).cast("string"))

    def grouped(names: list) -> Metrics:
        m = collect_metrics(reduce(DataFrame.unionByName, [label(frames[n], n) for n in names]), by, approx)
        # A source without rows has no group: its tables are those of an empty table.
        there = {r[0] for r in m.table.select(by).collect()}  # one row a source
        empty = [collect_metrics(frames[n], (), approx).map(lambda t, n=n: label(t, n)) for n in names if n not in there]
        return _merged([m, *empty], by)

    def run(names: list) -> list[Metrics]:
        try:
            return [grouped(names)]
        except Exception as error:  # noqa: BLE001
            if len(names) == 1:
                failed[names[0]] = error
                return []
            half = len(names) // 2
            return run(names[:half]) + run(names[half:])

    shared_folder(spark)
    with ThreadPoolExecutor(parallel) as pool:
        found = [m for part in pool.map(run, layouts.values()) for m in part]
    rows = [error_row(spark, name, str(error).split("\n")[0]) for name, error in failed.items()]
    if not found:
        return BatchAnalysis(None, reduce(DataFrame.unionByName, rows))
    m = _merged(found, by)
    summary = _summary_rows(m, by).withColumn("approximate_statistics", F.lit(approx))
    return BatchAnalysis(analysis_of(m), reduce(DataFrame.unionByName, [summary, *rows]))


def _merged(parts: list[Metrics], by: str) -> Metrics:
    """The metric tables of several groups of sources, one under the other."""
    names = ("table", "columns", "types", "contents", "numeric", "text", "unsafe")
    tables = {n: reduce(DataFrame.unionByName, [getattr(p, n) for p in parts]) for n in names}
    return Metrics(**tables, by=(by,))


def batch_metrics(summary: DataFrame) -> DataFrame:
    """Totals over the batch, from :func:`summarize_batch`."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint")
    return summary.agg(
        F.count(F.lit(1)).alias("sources"),
        total("rows").alias("total_rows"),
        total("total_null_cells").alias("total_null_cells"),
        total("duplicate_rows").alias("total_duplicates"),
        F.count_if(F.col("critical_issues") > 0).alias("sources_with_critical"),
        F.count_if(F.col("severe_issues") > 0).alias("sources_with_severe"),
    )
