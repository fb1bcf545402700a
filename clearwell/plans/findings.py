"""Issues, recommendations and suggested filters.

All three read the metric tables, which have one row per source and column.
Each metric row is turned into its findings by one ``inline``: no table is read
twice and nothing is collected, so a catalog of many tables is one job.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import settings as S
from ..columns import as_list, col
from ..columns import quoted as quoted_name
from ..functions.text import EMAIL, PHONE, PHONE_CHARS, PHONE_DECORATION, SQL_UNSAFE


@dataclass
class Metrics:
    """The metric tables of one or many sources (``by`` names the source columns)."""

    table: DataFrame
    columns: DataFrame
    types: DataFrame
    contents: DataFrame
    numeric: DataFrame | None = None
    text: DataFrame | None = None
    unsafe: DataFrame | None = None
    by: tuple[str, ...] = ()

    def map(self, change) -> Metrics:
        names = ("table", "columns", "types", "contents", "numeric", "text", "unsafe")
        tables = {n: getattr(self, n) for n in names}
        return Metrics(**{n: t if t is None else change(t) for n, t in tables.items()}, by=self.by)


def _rows(df: DataFrame, by, options: list[tuple[Column, dict[str, Column]]]) -> DataFrame:
    """For every row the structs whose condition holds."""
    structs = [
        F.struct(F.coalesce(cond, F.lit(False)).alias("__on"), *[v.alias(k) for k, v in fields.items()])
        for cond, fields in options
    ]
    return df.select(*[col(b) for b in by], F.inline(F.filter(F.array(*structs), lambda x: x["__on"]))).drop("__on")


def _union(parts) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _text(value) -> Column:
    return value if isinstance(value, Column) else F.lit(value).cast("string")


# --- issues ---------------------------------------------------------------------

def _issue(level, kind, column, score, detail) -> dict[str, Column]:
    return {
        "level": _text(level), "type": _text(kind), "column_name": _text(column),
        "score": F.lit(score) if not isinstance(score, Column) else score, "detail": _text(detail),
    }


def issues(m: Metrics) -> DataFrame:
    """``level, type, column_name, score, detail`` with level critical, severe or warnings."""
    by = list(m.by)
    c = F.col
    name = c("column_name")
    parts = [
        _rows(m.columns, by, [
            (c("null_percent") >= S.NULL_CRITICAL_PERCENT,
             _issue("critical", "NULOS_CRÍTICOS", name, 10, F.format_string("%.1f%% nulos", "null_percent"))),
            (c("null_percent").between(S.NULL_SEVERE_PERCENT, S.NULL_CRITICAL_PERCENT) & (c("null_percent") < S.NULL_CRITICAL_PERCENT),
             _issue("severe", "NULOS_GRAVES", name, 7, F.format_string("%.1f%% nulos", "null_percent"))),
            (c("blank_count") > 0,
             _issue(F.when(c("blank_percent") > 30, "severe").otherwise("warnings"), "CADENAS_VACÍAS", name,
                    F.when(c("blank_percent") > 30, 5).otherwise(2),
                    F.format_string("%d cadenas vacías (%.1f%%)", "blank_count", "blank_percent"))),
        ]),
        _rows(m.table, by, [
            (c("duplicate_rows") > 0,
             _issue(
                 F.when(c("duplicate_percent") > 20, "critical").when(c("duplicate_percent") > 5, "severe").otherwise("warnings"),
                 "DUPLICADOS", S.WHOLE_ROWS,
                 F.when(c("duplicate_percent") > 20, 8).when(c("duplicate_percent") > 5, 6).otherwise(3),
                 F.format_string("%d filas duplicadas (%.1f%%)", "duplicate_rows", "duplicate_percent"))),
        ]),
        _rows(m.types, by, [
            (F.lit(True),
             _issue(F.when(c("is_problematic"), "severe").otherwise("warnings"), "TIPOS_MIXTOS", name,
                    F.when(c("is_problematic"), 6).otherwise(2), c("detected_types"))),
        ]),
        _rows(m.contents, by, [
            (c("is_problematic") & (c("validator") == v),
             _issue(
                 F.when(c("invalid_percent") > limit, "severe").otherwise("warnings"), kind, name,
                 F.when(c("invalid_percent") > limit, score).otherwise(2),
                 F.format_string("%d inválidos (%.1f%%)", "invalid_count", "invalid_percent")))
            for v, kind, limit, score in (
                ("email", "EMAILS_INVÁLIDOS", 30, 5), ("phone", "TELÉFONOS_INVÁLIDOS", 30, 5),
                ("date", "FECHAS_INVÁLIDAS", 20, 7), ("url", "URLS_INVÁLIDAS", 100, 2),
            )
        ]),
    ]
    return _union(parts)


def severity_counts(found: DataFrame, by=()) -> DataFrame:
    """Number of issues per level."""
    return found.groupBy(*[col(b) for b in as_list(by)]).agg(*[
        F.count_if(F.col("level") == level).alias(level) for level in ("critical", "severe", "warnings")
    ])


def problem_overview(m: Metrics) -> DataFrame:
    """Columns with many nulls, mixed types or very many values: ``column_name, issue, severity, detail``."""
    by = list(m.by)
    c = F.col

    def row(issue, severity, detail):
        return {"column_name": c("column_name"), "issue": _text(issue), "severity": _text(severity), "detail": _text(detail)}

    return _union([
        _rows(m.columns, by, [
            (c("null_percent") >= S.NULL_SEVERE_PERCENT,
             row("Demasiados valores nulos", F.when(c("null_percent") >= S.NULL_CRITICAL_PERCENT, S.CRITICAL).otherwise(S.SEVERE),
                 F.format_string("%.1f%% nulos", "null_percent"))),
            (c("cardinality_ratio") >= S.HIGH_CARDINALITY,
             row("Demasiados valores únicos", S.NOTICE, F.format_string("%.1f%% valores únicos", c("cardinality_ratio") * 100))),
        ]),
        _rows(m.types, by, [
            (F.lit(True), row("Mezcla de tipos de datos", F.when(c("is_problematic"), S.SEVERE).otherwise(S.NOTICE), c("detected_types"))),
        ]),
    ])


# --- recommendations --------------------------------------------------------------

CATEGORIES = ("cleaning", "database_rules", "normalization", "quality")


def _advice(category, action, column, severity, detail) -> dict[str, Column]:
    return {
        "category": _text(category), "action": _text(action), "column_name": _text(column),
        "severity": _text(severity), "detail": _text(detail),
    }


def recommendations(m: Metrics) -> DataFrame:
    """``category, action, column_name, severity, detail`` in four categories."""
    by = list(m.by)
    c = F.col
    name = c("column_name")
    nulls = F.format_string("%.1f%% nulos", "null_percent")
    unique = F.format_string("%.1f%% valores únicos", c("cardinality_ratio") * 100)
    blanks = F.format_string("%d cadenas vacías", "blank_count")
    negatives = F.format_string("%d valores negativos", "negative_count")
    invalid = F.format_string("%d inválidos", "invalid_count")
    return _union([
        _rows(m.columns, by, [
            (c("null_percent") >= S.NULL_CRITICAL_PERCENT, _advice("cleaning", "DROP_COLUMN", name, S.CRITICAL, nulls)),
            ((c("null_percent") >= S.NULL_SEVERE_PERCENT) & (c("null_percent") < S.NULL_CRITICAL_PERCENT),
             _advice("cleaning", "REVIEW_COLUMN", name, S.SEVERE, nulls)),
            (c("blank_count") > 0, _advice("cleaning", "CLEAN_WHITESPACE", name, S.NOTICE, blanks)),
            ((c("null_count") == 0) & (c("rows") > 0), _advice("database_rules", "NOT NULL", name, None, "sin nulos")),
            ((c("cardinality_ratio") >= S.UNIQUE_CARDINALITY) & (c("non_null") > 0),
             _advice("database_rules", "UNIQUE", name, None, unique)),
            (c("blank_count") > 0, _advice("normalization", "WHITESPACE_TRIM", name, None, blanks)),
            (c("hint").isin("Email", "URL"), _advice("normalization", "LOWERCASE", name, None, c("hint"))),
            (c("cardinality_ratio") >= S.HIGH_CARDINALITY, _advice("quality", "HIGH_CARDINALITY", name, S.NOTICE, unique)),
            (name.startswith("Column_") | (name == "Unnamed"),
             _advice("quality", "MISSING_COLUMN_NAME", name, S.NOTICE, "sin nombre descriptivo")),
        ]),
        _rows(m.table, by, [
            (c("duplicate_rows") > 0,
             _advice("cleaning", "REMOVE_DUPLICATES", S.WHOLE_ROWS, S.SEVERE,
                     F.format_string("%d filas duplicadas (%.1f%%)", "duplicate_rows", "duplicate_percent"))),
            (c("null_percent") > 30,
             _advice("quality", "OVERALL_QUALITY", None, S.SEVERE, F.format_string("%.1f%% nulos", "null_percent"))),
        ]),
        _rows(m.types, by, [
            (c("is_problematic"), _advice("cleaning", "STANDARDIZE_TYPE", name, S.SEVERE, c("detected_types"))),
        ]),
        _rows(m.numeric, by, [
            (c("is_problematic") & (c("negative_count") > 0),
             _advice("database_rules", "CHECK (NO NEGATIVOS)", name, None, negatives)),
            (c("negative_count") > 0, _advice("normalization", "RANGE_NORMALIZATION", name, None, negatives)),
        ]),
        _rows(m.contents, by, [
            (c("is_problematic") & c("validator").isin("email", "phone"),
             _advice("database_rules", "VALIDATION", name, None, F.concat(c("validator"), F.lit(": "), invalid))),
            ((c("validator") == "date") & (c("formats") > 1),
             _advice("normalization", "DATE_STANDARDIZATION", name, None, F.format_string("%d formatos", "formats"))),
        ]),
    ])


def recommendation_summary(advice: DataFrame, by=()) -> DataFrame:
    """Counts by severity, the total and the number of categories in use."""
    s = F.col("severity")
    return advice.groupBy(*[col(b) for b in as_list(by)]).agg(
        F.count_if(s == S.CRITICAL).alias("critical_issues"),
        F.count_if(s == S.SEVERE).alias("serious_issues"),
        F.count_if(s == S.NOTICE).alias("warnings"),
        F.count(F.lit(1)).alias("total_recommendations"),
        F.array_join(F.array_sort(F.collect_set("category")), ", ").alias("categories"),
    )


# --- suggested filters ---------------------------------------------------------------

def _filter(category, kind, column, severity, affected, predicate) -> dict[str, Column]:
    return {
        "category": _text(category), "type": _text(kind), "column_name": _text(column), "severity": _text(severity),
        "affected_percent": affected.cast("double"), "filter_sql": _text(predicate),
    }


_SPACE = "".join(f"\\u{ord(x):04x}" for x in S.WHITESPACE)


def _trimmed(q: Column) -> Column:
    return F.concat(F.lit("btrim("), q, F.lit(f", '{_SPACE}')"))


def _email_text(q: Column) -> Column:
    return F.concat(_trimmed(q), F.lit(" LIKE '%@%' AND "), _trimmed(q), F.lit(f" RLIKE r'{EMAIL}'"))


def _phone_text(q: Column) -> Column:
    plain = F.concat(F.lit("translate("), q, F.lit(f", '{_SPACE}{PHONE_DECORATION}', '')"))
    return F.concat(q, F.lit(f" RLIKE r'{PHONE_CHARS}' AND "), plain, F.lit(f" RLIKE r'{PHONE}'"))


def suggested_filters(m: Metrics, row_key: str | None = None) -> DataFrame:
    """``category, type, column_name, severity, affected_percent, filter_sql``.

    ``filter_sql`` is Spark SQL: a predicate for ``df.where``, or a statement
    over ``tabla`` where a predicate cannot say it. The predicates are made of
    the patterns that the operators themselves use. ``row_key`` names the column
    that says which of several equal rows comes first; without one any does.
    """
    by = list(m.by)
    c = F.col
    name = c("column_name")
    q = F.concat(F.lit("`"), F.replace(name, F.lit("`"), F.lit("``")), F.lit("`"))
    serious = lambda cond: F.when(cond, S.SEVERE).otherwise(S.NOTICE)
    # One entry per column of the source, in schema order.
    ordered = F.array_sort(F.collect_list(F.struct("position", q.alias("q"), "null_percent")))
    listed = m.columns.groupBy(*[col(b) for b in by]).agg(ordered.alias("cols"))
    heavy = F.filter("cols", lambda x: x["null_percent"] >= S.NULL_SEVERE_PERCENT)
    quoted = lambda cols: F.array_join(F.transform(cols, lambda x: x["q"]), ", ")
    per_source = listed.select(
        *[col(b).alias(f"__b{i}") for i, b in enumerate(by)],
        quoted(F.col("cols")).alias("all_columns"),
        F.get("cols", 0)["q"].alias("first_column"),
        F.array_join(F.transform("cols", lambda x: F.concat(x["q"], F.lit(" IS NOT NULL"))), " AND ").alias("complete"),
        quoted(heavy).alias("heavy_columns"),
    )
    if by:
        same = reduce(lambda a, b: a & b, [col(b).eqNullSafe(c(f"__b{i}")) for i, b in enumerate(by)])
        tables = m.table.join(per_source, same, "left")
    else:
        tables = m.table.crossJoin(F.broadcast(per_source))  # one row each
    first_rows = F.concat(
        F.lit("SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY "), c("all_columns"),
        F.lit(" ORDER BY "), F.lit(quoted_name(row_key)) if row_key else c("first_column"),
        F.lit(") AS rn FROM tabla) WHERE rn = 1"),
    )
    return _union([
        _rows(m.columns, by, [
            (c("null_percent") > 0,
             _filter("null_filters", "NULL_ELIMINATION", name,
                     F.when(c("null_percent") >= S.NULL_CRITICAL_PERCENT, S.CRITICAL)
                     .when(c("null_percent") >= S.NULL_SEVERE_PERCENT, S.SEVERE).otherwise(S.NOTICE),
                     c("null_percent"), F.concat(q, F.lit(" IS NOT NULL")))),
            (c("blank_count") > 0,
             _filter("cleanup_filters", "WHITESPACE_CLEANUP", name, S.NOTICE, c("blank_percent"),
                     F.concat(_trimmed(q), F.lit(" <> ''")))),
        ]),
        _rows(tables, by, [
            (c("duplicate_rows") > 0,
             _filter("duplicates_filters", "REMOVE_DUPLICATES", None, serious(c("duplicate_percent") > 5),
                     c("duplicate_percent"), "SELECT DISTINCT * FROM tabla")),
            (c("duplicate_rows") > 0,
             _filter("duplicates_filters", "REMOVE_DUPLICATES_ADVANCED", None, S.SEVERE, c("duplicate_percent"),
                     first_rows)),
            (F.lit(True),
             _filter("data_quality_filters", "COMPLETE_ROWS", None, serious(c("complete_percent") < 50),
                     F.lit(100.0) - c("complete_percent"), c("complete"))),
            (c("heavy_columns") != "",
             _filter("data_quality_filters", "EXCLUDE_PROBLEM_COLUMNS", None, S.NOTICE, F.lit(None),
                     F.concat(F.lit("SELECT * EXCEPT ("), c("heavy_columns"), F.lit(") FROM tabla")))),
        ]),
        _rows(m.types, by, [
            (c("is_problematic"),
             _filter("type_standardization", "TYPE_STANDARDIZATION", name, S.SEVERE, F.lit(None),
                     F.concat(F.lit("CAST("), q, F.lit(" AS STRING)")))),
        ]),
        _rows(m.contents, by, [
            ((c("validator") == v) & (c("invalid_count") > 0),
             _filter("validation_filters", kind, name, serious(c("invalid_percent") > 10), c("invalid_percent"),
                     test(q)))
            for v, kind, test in (("email", "EMAIL_VALIDATION", _email_text), ("phone", "PHONE_VALIDATION", _phone_text))
        ]),
        _rows(m.unsafe, by, [
            (c("unsafe_percent") > S.SPECIAL_CHARS_PERCENT,
             _filter("cleanup_filters", "SPECIAL_CHARS_CLEANUP", name, S.NOTICE, c("unsafe_percent"),
                     F.concat(F.lit("NOT coalesce("), q, F.lit(f" RLIKE r'{SQL_UNSAFE}', false)")))),
        ]),
    ])


def top_suggestions(filters: DataFrame, by=()) -> DataFrame:
    """The worst suggestion of each category; ties go by type, then column."""
    by = as_list(by)
    rank = F.when(F.col("severity") == S.CRITICAL, 0).when(F.col("severity") == S.SEVERE, 1).otherwise(2)
    window = Window.partitionBy(*[col(b) for b in by], "category").orderBy(rank, "type", "column_name")
    return filters.withColumn("__n", F.row_number().over(window)).where(F.col("__n") == 1).drop("__n")
