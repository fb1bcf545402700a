"""Issues, recommendations, suggested filters, batches and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from clearwell.operators import duplicates as D
from clearwell.operators import filters as L
from clearwell.operators.profile import null_profile
from clearwell.plans import analysis as A
from clearwell.plans import expectations as X
from clearwell.plans import findings as N
from clearwell.plans.report import report_tables

from .registry import (
    SCHEMAS, big, query, r6, source, sql_content, sql_email, sql_parse, sql_phone, sql_trim, sql_url, sql_value_type, union_columns,
    with_source,
)

_UNSAFE = "[<>{}\"|\\\\^`~]"


def _metric_ctes(name: str) -> str:
    """The metric tables of a view as DuckDB common table expressions."""
    cols = SCHEMAS[name]
    n = len(cols)
    texts = [c for c, k in cols if k == "t"]
    columns = union_columns(name, """
SELECT '{c}' AS column_name, count(*) AS rows, count({c}) AS non_null, count(*) - count({c}) AS null_count,
       100.0 * (count(*) - count({c})) / count(*) AS null_percent, (count(DISTINCT {c}) + (count(*) > count({c}))::INT) / count(*) AS ratio,
       count(*) FILTER (trim(CAST({c} AS VARCHAR)) = '') AS blank_count, 100.0 * count(*) FILTER (trim(CAST({c} AS VARCHAR)) = '') / count(*) AS blank_percent,
       100.0 * count(*) FILTER (regexp_matches(CAST({c} AS VARCHAR), '""" + _UNSAFE.replace("{", "{{").replace("}", "}}") + """')) / count(*) AS unsafe_percent FROM v""")
    types = "\nUNION ALL\n".join(
        f"SELECT '{c}' AS column_name, count(DISTINCT {sql_value_type(c)}) AS types FROM v WHERE {c} IS NOT NULL" for c in texts)
    checks = {
        "email": ("email", sql_email), "telefono": ("phone", sql_phone), "website": ("url", sql_url),
        "fecha_inicio": ("date", sql_parse), "fecha_fin": ("date", sql_parse),
    }
    contents = "\nUNION ALL\n".join(
        f"SELECT '{checks[c][0]}' AS validator, '{c}' AS column_name, count(*) FILTER (NOT ok) AS invalid, "
        f"100.0 * count(*) FILTER (NOT ok) / count(*) AS invalid_percent FROM "
        f"(SELECT {checks[c][1](c)}{' IS NOT NULL' if checks[c][0] == 'date' else ''} AS ok FROM v WHERE {c} IS NOT NULL)"
        for c in texts if c in checks)
    # A column also counts when its values look like it; digits of ISO dates read as phones.
    by_content = "\nUNION ALL\n".join(
        f"SELECT '{kind}' AS validator, '{c}' AS column_name, count(*) FILTER (t <> '{kind}') AS invalid, "
        f"100.0 * count(*) FILTER (t <> '{kind}') / count(*) AS invalid_percent FROM (SELECT {sql_content(c)} AS t FROM v WHERE {c} IS NOT NULL) "
        f"HAVING count(*) FILTER (t = '{kind}') >= 0.7 * count(*) AND count(*) > 0"
        for c in texts for kind in ("email", "phone", "url") if checks.get(c, ("",))[0] != kind)
    contents = "\nUNION ALL\n".join(x for x in (contents, by_content) if x) or "SELECT '' AS validator, '' AS column_name, 0 AS invalid, 0.0 AS invalid_percent WHERE false"
    numeric = "\nUNION ALL\n".join(
        f"SELECT '{c}' AS column_name, count(*) FILTER ({c} < 0) AS negatives FROM v" for c, k in cols if k == "n")
    names = ", ".join(c for c, _ in cols)
    return f"""
, cm AS ({columns}),
ty AS ({types}),
co AS ({contents}),
nu AS ({numeric}),
du AS (SELECT sum(n) AS rows, sum(n - 1) AS dups, 100.0 * sum(n - 1) / sum(n) AS dup_percent FROM (SELECT count(*) AS n FROM v GROUP BY {names})),
ta AS (SELECT 100.0 * sum(k) / (count(*) * {n}) AS null_percent, 100.0 * count(*) FILTER (k = 0) / count(*) AS complete_percent
       FROM (SELECT {' + '.join(f'({c} IS NULL)::INT' for c, _ in cols)} AS k FROM v))"""


def _with_metrics(name: str, body: str) -> str:
    return with_source(name, _metric_ctes(name).strip() + body)


def _issues(name: str) -> str:
    # In dirty_orders both date columns are problematic only where a date is
    # invalid, mixed or ambiguous: the start has all three, the end none.
    date = "(validator = 'date' AND (invalid > 0 OR column_name = 'fecha_inicio'))"
    return _with_metrics(name, f"""
SELECT 'critical' AS level, 'NULOS_CRÍTICOS' AS type, column_name, 10 AS score FROM cm WHERE null_percent >= 80
UNION ALL SELECT 'severe', 'NULOS_GRAVES', column_name, 7 FROM cm WHERE null_percent >= 40 AND null_percent < 80
UNION ALL SELECT CASE WHEN blank_percent > 30 THEN 'severe' ELSE 'warnings' END, 'CADENAS_VACÍAS', column_name, CASE WHEN blank_percent > 30 THEN 5 ELSE 2 END FROM cm WHERE blank_count > 0
UNION ALL SELECT CASE WHEN dup_percent > 20 THEN 'critical' WHEN dup_percent > 5 THEN 'severe' ELSE 'warnings' END, 'DUPLICADOS', 'FILAS_COMPLETAS',
  CASE WHEN dup_percent > 20 THEN 8 WHEN dup_percent > 5 THEN 6 ELSE 3 END FROM du WHERE dups > 0
UNION ALL SELECT CASE WHEN types > 2 THEN 'severe' ELSE 'warnings' END, 'TIPOS_MIXTOS', column_name, CASE WHEN types > 2 THEN 6 ELSE 2 END FROM ty WHERE types > 1
UNION ALL SELECT CASE WHEN invalid_percent > 30 THEN 'severe' ELSE 'warnings' END, CASE validator WHEN 'email' THEN 'EMAILS_INVÁLIDOS' ELSE 'TELÉFONOS_INVÁLIDOS' END,
  column_name, CASE WHEN invalid_percent > 30 THEN 5 ELSE 2 END FROM co WHERE validator IN ('email', 'phone') AND invalid > 0
UNION ALL SELECT 'warnings', 'URLS_INVÁLIDAS', column_name, 2 FROM co WHERE validator = 'url' AND invalid > 0
UNION ALL SELECT CASE WHEN invalid_percent > 20 THEN 'severe' ELSE 'warnings' END, 'FECHAS_INVÁLIDAS', column_name, CASE WHEN invalid_percent > 20 THEN 7 ELSE 2 END
  FROM co WHERE {date}""")


_VIEWS = ("dirty_customer", "dirty_orders", "dirty_contacts", "dirty_nulls")

for _name in _VIEWS:
    def _run(spark, d, _name=_name):
        return N.issues(A.issue_metrics(source(spark, d, _name))).drop("detail")
    query(_issues(_name), f"issues_{_name}")(_run)


@query("SELECT CAST(count(*) FILTER (level = 'critical') AS BIGINT) AS critical, CAST(count(*) FILTER (level = 'severe') AS BIGINT) AS severe, "
       "CAST(count(*) FILTER (level = 'warnings') AS BIGINT) AS warnings FROM (" + _issues("dirty_customer") + ")")
def severity_counts(spark, d):
    return N.severity_counts(N.issues(A.issue_metrics(source(spark, d, "dirty_customer"))))


def _advice(name: str) -> str:
    hinted = ", ".join(f"'{c}'" for c, _ in SCHEMAS[name] if any(w in c for w in ("email", "correo", "mail", "url", "web", "link")))
    hint_sql = f"UNION ALL SELECT 'normalization', 'LOWERCASE', column_name, NULL FROM cm WHERE column_name IN ({hinted})" if hinted else ""
    return _with_metrics(name, f"""
SELECT 'cleaning' AS category, 'DROP_COLUMN' AS action, column_name, 'CRÍTICO' AS severity FROM cm WHERE null_percent >= 80
UNION ALL SELECT 'cleaning', 'REVIEW_COLUMN', column_name, 'GRAVE' FROM cm WHERE null_percent >= 40 AND null_percent < 80
UNION ALL SELECT 'cleaning', 'CLEAN_WHITESPACE', column_name, 'AVISO' FROM cm WHERE blank_count > 0
UNION ALL SELECT 'cleaning', 'REMOVE_DUPLICATES', 'FILAS_COMPLETAS', 'GRAVE' FROM du WHERE dups > 0
UNION ALL SELECT 'cleaning', 'STANDARDIZE_TYPE', column_name, 'GRAVE' FROM ty WHERE types > 2
UNION ALL SELECT 'database_rules', 'NOT NULL', column_name, NULL FROM cm WHERE null_count = 0
UNION ALL SELECT 'database_rules', 'UNIQUE', column_name, NULL FROM cm WHERE ratio >= 0.95 AND non_null > 0
UNION ALL SELECT 'database_rules', 'CHECK (NO NEGATIVOS)', column_name, NULL FROM nu WHERE negatives > 0 AND contains(column_name, 'edad')
UNION ALL SELECT 'database_rules', 'VALIDATION', column_name, NULL FROM co WHERE validator IN ('email', 'phone') AND invalid > 0
UNION ALL SELECT 'normalization', 'WHITESPACE_TRIM', column_name, NULL FROM cm WHERE blank_count > 0 {hint_sql}
UNION ALL SELECT 'normalization', 'RANGE_NORMALIZATION', column_name, NULL FROM nu WHERE negatives > 0
UNION ALL SELECT 'normalization', 'DATE_STANDARDIZATION', column_name, NULL FROM co WHERE validator = 'date' AND column_name = 'fecha_inicio'
UNION ALL SELECT 'quality', 'HIGH_CARDINALITY', column_name, 'AVISO' FROM cm WHERE ratio >= 0.8
UNION ALL SELECT 'quality', 'OVERALL_QUALITY', NULL, 'GRAVE' FROM ta WHERE null_percent > 30""")


for _name in (*_VIEWS, "dirty_people"):
    def _run(spark, d, _name=_name):
        return N.recommendations(A.collect_metrics(source(spark, d, _name))).drop("detail")
    query(_advice(_name), f"recommendations_{_name}")(_run)


@query("SELECT CAST(count(*) FILTER (severity = 'CRÍTICO') AS BIGINT) AS critical_issues, CAST(count(*) FILTER (severity = 'GRAVE') AS BIGINT) AS serious_issues, "
       "CAST(count(*) FILTER (severity = 'AVISO') AS BIGINT) AS warnings, count(*) AS total_recommendations, "
       "string_agg(DISTINCT category, ', ' ORDER BY category) AS categories FROM (" + _advice("dirty_nulls") + ")")
def recommendation_summary(spark, d):
    return N.recommendation_summary(N.recommendations(A.collect_metrics(source(spark, d, "dirty_nulls"))))


def _filters(name: str) -> str:
    return _with_metrics(name, """
SELECT 'null_filters' AS category, 'NULL_ELIMINATION' AS type, column_name, CASE WHEN null_percent >= 80 THEN 'CRÍTICO' WHEN null_percent >= 40 THEN 'GRAVE' ELSE 'AVISO' END AS severity,
       round(null_percent, 6) AS affected_percent FROM cm WHERE null_percent > 0
UNION ALL SELECT 'cleanup_filters', 'WHITESPACE_CLEANUP', column_name, 'AVISO', round(blank_percent, 6) FROM cm WHERE blank_count > 0
UNION ALL SELECT 'cleanup_filters', 'SPECIAL_CHARS_CLEANUP', column_name, 'AVISO', round(unsafe_percent, 6) FROM cm WHERE unsafe_percent > 0.5
UNION ALL SELECT 'duplicates_filters', 'REMOVE_DUPLICATES', NULL, CASE WHEN dup_percent > 5 THEN 'GRAVE' ELSE 'AVISO' END, round(dup_percent, 6) FROM du WHERE dups > 0
UNION ALL SELECT 'duplicates_filters', 'REMOVE_DUPLICATES_ADVANCED', NULL, 'GRAVE', round(dup_percent, 6) FROM du WHERE dups > 0
UNION ALL SELECT 'type_standardization', 'TYPE_STANDARDIZATION', column_name, 'GRAVE', NULL FROM ty WHERE types > 2
UNION ALL SELECT 'validation_filters', CASE validator WHEN 'email' THEN 'EMAIL_VALIDATION' ELSE 'PHONE_VALIDATION' END, column_name,
       CASE WHEN invalid_percent > 10 THEN 'GRAVE' ELSE 'AVISO' END, round(invalid_percent, 6) FROM co WHERE validator IN ('email', 'phone') AND invalid > 0
UNION ALL SELECT 'data_quality_filters', 'COMPLETE_ROWS', NULL, CASE WHEN complete_percent < 50 THEN 'GRAVE' ELSE 'AVISO' END, round(100 - complete_percent, 6) FROM ta
UNION ALL SELECT 'data_quality_filters', 'EXCLUDE_PROBLEM_COLUMNS', NULL, 'AVISO', NULL FROM cm WHERE null_percent >= 40 HAVING count(*) > 0""")


for _name in _VIEWS:
    def _run(spark, d, _name=_name):
        return r6(N.suggested_filters(A.collect_metrics(source(spark, d, _name))), "affected_percent").drop("filter_sql")
    query(_filters(_name), f"suggested_filters_{_name}")(_run)


@query("SELECT category, type, column_name, severity FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY "
       "CASE severity WHEN 'CRÍTICO' THEN 0 WHEN 'GRAVE' THEN 1 ELSE 2 END, type, column_name NULLS FIRST) AS n FROM (" + _filters("dirty_nulls") + ")) WHERE n = 1")
def top_suggestions(spark, d):
    found = N.suggested_filters(A.collect_metrics(source(spark, d, "dirty_nulls")))
    return N.top_suggestions(found).select("category", "type", "column_name", "severity")


# --- the filters applied ---------------------------------------------------------------------

def _applied(name, body, key, run):
    query(with_source(name, body), key)(run)


_C = "dirty_customer"
_applied(_C, "SELECT * FROM v WHERE nombre IS NOT NULL", "filter_not_null", lambda s, d: L.drop_nulls(source(s, d, _C), "nombre"))
_applied(_C, f"SELECT * FROM v WHERE nombre IS NOT NULL AND {sql_trim('nombre')} <> ''", "filter_not_blank", lambda s, d: L.drop_blanks(source(s, d, _C), "nombre"))
_applied(_C, f"SELECT * FROM v WHERE {sql_email('email')}", "filter_valid_email", lambda s, d: L.keep_valid_emails(source(s, d, _C), "email"))
_applied("dirty_contacts", f"SELECT * FROM v WHERE {sql_phone('telefono')}", "filter_valid_phone", lambda s, d: L.keep_valid_phones(source(s, d, "dirty_contacts"), "telefono"))
_applied(_C, f"SELECT id, {sql_trim('nombre')} AS nombre, {sql_trim('email')} AS email, {sql_trim('importe')} AS importe FROM v", "trim_texts", lambda s, d: L.trim_texts(source(s, d, _C)))
_applied("documents", f"SELECT doc_id FROM v WHERE NOT regexp_matches(text, '{_UNSAFE}')", "filter_unsafe_chars", lambda s, d: L.drop_unsafe_chars(source(s, d, "documents"), "text").select("doc_id"))
_applied("pages", f"SELECT page_id, md5(regexp_replace(html, '{_UNSAFE}', '', 'g')) AS html_md5 FROM v", "remove_unsafe_chars",
         lambda s, d: L.remove_unsafe_chars(source(s, d, "pages"), "html").selectExpr("page_id", "md5(html) AS html_md5"))
_applied("dirty_nulls", "SELECT * FROM v WHERE n0 IS NOT NULL AND n30 IS NOT NULL AND n45 IS NOT NULL AND n85 IS NOT NULL AND n100 IS NOT NULL AND n40 IS NOT NULL AND n80 IS NOT NULL",
         "filter_complete_rows", lambda s, d: L.complete_rows(source(s, d, "dirty_nulls")))
_applied("dirty_customer", "SELECT * FROM v WHERE nombre IS NOT NULL AND email IS NOT NULL", "filter_complete_rows_customer", lambda s, d: L.complete_rows(source(s, d, _C)))
_applied("dirty_orders", "SELECT DISTINCT * FROM v", "filter_distinct", lambda s, d: D.distinct_rows(source(s, d, "dirty_orders")))
_applied(_C, "SELECT id, nombre, email, importe, try_cast(importe AS DOUBLE) AS number FROM v", "standardize_type",
         lambda s, d: L.standardize_type(source(s, d, _C).selectExpr("*", "importe AS number"), "number", "double"))


@query(with_source("dirty_nulls", "SELECT id, n0, n30 FROM v"))
def drop_problem_columns(spark, d):
    df = source(spark, d, "dirty_nulls")
    bad = null_profile(df).where("null_percent >= 40").select("column_name").collect()  # one row per column
    return L.drop_columns(df, [r[0] for r in bad])


# --- batches and reports ------------------------------------------------------------------------
_BATCH = ("region", "nation", "customer", "supplier", "part", "orders", "labels", "dirty_customer", "dirty_nulls")


def _batch_sql(name):
    cols = [c for c, _ in SCHEMAS[name]]
    nulls = " + ".join(f"(count(*) - count({c}))" for c in cols)
    body = with_source(name, f"""
SELECT '{name}' AS source_name, 'ok' AS status, count(*) AS rows, {big(len(cols))} AS columns, {big(nulls)} AS total_null_cells,
       round(100.0 * ({nulls}) / (count(*) * {len(cols)}), 6) AS null_percent_overall,
       (SELECT {big('sum(n - 1)')} FROM (SELECT count(*) AS n FROM v GROUP BY {', '.join(cols)})) AS duplicate_rows FROM v""")
    return f"SELECT * FROM ({body})"


_BATCH_SQL = "\nUNION ALL\n".join(_batch_sql(n) for n in _BATCH)


@query(_BATCH_SQL)
def batch_summary(spark, d):
    out = A.summarize_batch(spark, {n: (lambda s, n=n: source(s, d, n)) for n in _BATCH})
    return r6(out, "null_percent_overall").select(
        "source_name", "status", "rows", "columns", "total_null_cells", "null_percent_overall", "duplicate_rows")


@query("SELECT count(*) + 1 AS sources, CAST(sum(rows) AS BIGINT) AS total_rows, CAST(sum(total_null_cells) AS BIGINT) AS total_null_cells, "
       "CAST(sum(duplicate_rows) AS BIGINT) AS total_duplicates FROM (" + "\nUNION ALL\n".join(_batch_sql(n) for n in ("nation", "customer", "dirty_nulls")) + ")")
def batch_metrics(spark, d):
    sources = {n: (lambda s, n=n: source(s, d, n)) for n in ("nation", "customer", "dirty_nulls", "missing_table")}
    return A.batch_metrics(A.summarize_batch(spark, sources)).drop("sources_with_critical", "sources_with_severe")


@query("""SELECT c_mktsegment AS source_name, count(*) AS rows, CAST(4 AS BIGINT) AS columns, CAST(0 AS BIGINT) AS total_null_cells,
CAST(count(*) - count(DISTINCT (c_custkey, c_name, c_nationkey, c_acctbal)) AS BIGINT) AS duplicate_rows, CAST(0 AS BIGINT) AS critical_issues FROM customer GROUP BY 1""")
def batch_summary_grouped(spark, d):
    return A.summarize_grouped(source(spark, d, "customer"), "c_mktsegment").select(
        "source_name", "rows", "columns", "total_null_cells", "duplicate_rows", "critical_issues")


@query(with_source("dirty_nulls", "SELECT column_name, null_count, round(null_percent, 2) AS null_percent, round(100 - null_percent, 2) AS utilization_percent, "
       "CASE WHEN null_percent >= 80 THEN 'CRÍTICO' WHEN null_percent >= 40 THEN 'GRAVE' ELSE 'OK' END AS status FROM (" + union_columns("dirty_nulls", """
SELECT '{c}' AS column_name, count(*) - count({c}) AS null_count, 100.0 * (count(*) - count({c})) / count(*) AS null_percent FROM v""") + ") WHERE null_count > 0"))
def report_nulls(spark, d):
    return report_tables(A.analyze(source(spark, d, "dirty_nulls"), settled=False))["nulls"]


@query("SELECT CAST(NULL AS VARCHAR) AS column_name, CAST(NULL AS BIGINT) AS null_count, CAST(NULL AS DOUBLE) AS null_percent, "
       "CAST(NULL AS DOUBLE) AS utilization_percent, 'Sin incidencias detectadas' AS status FROM customer "
       "HAVING count(*) = count(c_custkey) AND count(*) = count(c_name) AND count(*) = count(c_acctbal)")
def report_no_findings(spark, d):
    return report_tables(A.analyze(source(spark, d, "customer"), settled=False))["nulls"]


@query(with_source("dirty_orders", "SELECT sum(n) AS rows, sum(n - 1) AS duplicate_rows, round(100.0 * sum(n - 1) / sum(n), 2) AS duplicate_percent "
       "FROM (SELECT count(*) AS n FROM v GROUP BY ALL)").replace("GROUP BY ALL", "GROUP BY id, fecha_inicio, fecha_fin, activo, total").replace("sum(n) AS rows", "CAST(sum(n) AS BIGINT) AS rows").replace("sum(n - 1) AS duplicate_rows", "CAST(sum(n - 1) AS BIGINT) AS duplicate_rows"))
def report_duplicates(spark, d):
    return report_tables(A.analyze(source(spark, d, "dirty_orders"), settled=False))["duplicates"]


# --- many sources, whole results --------------------------------------------------------------

def _summary_sql(name, mode="direct"):
    return f"""
SELECT b.source_name, b.status, '' AS error, '' AS sheet_name, '{mode}' AS analysis_mode, false AS approximate_statistics, b.rows, b.columns, b.total_null_cells,
       b.null_percent_overall, b.duplicate_rows, round(100.0 * b.duplicate_rows / b.rows, 6) AS duplicate_percent,
       i.critical_issues, i.severe_issues, i.warning_issues
FROM ({_batch_sql(name)}) AS b, (SELECT CAST(count(*) FILTER (level = 'critical') AS BIGINT) AS critical_issues,
     CAST(count(*) FILTER (level = 'severe') AS BIGINT) AS severe_issues, CAST(count(*) FILTER (level = 'warnings') AS BIGINT) AS warning_issues FROM ({_issues(name)})) AS i"""


_BROKEN = ("SELECT 'broken' AS source_name, 'error' AS status, 'no such file' AS error, '' AS sheet_name, '' AS analysis_mode, false AS approximate_statistics, "
           "CAST(0 AS BIGINT) AS rows, CAST(0 AS BIGINT) AS columns, CAST(0 AS BIGINT) AS total_null_cells, CAST(0 AS DOUBLE) AS null_percent_overall, "
           "CAST(0 AS BIGINT) AS duplicate_rows, CAST(0 AS DOUBLE) AS duplicate_percent, CAST(0 AS BIGINT) AS critical_issues, CAST(0 AS BIGINT) AS severe_issues, "
           "CAST(0 AS BIGINT) AS warning_issues FROM part HAVING count(*) > 0")


def _sources(spark, d, names=_VIEWS):
    def broken(_):
        raise OSError("no such file")

    middle = len(names) // 2
    items = [(n, lambda s, n=n: source(s, d, n)) for n in names]
    return dict([*items[:middle], ("broken", broken), *items[middle:]])


def _exact(df):
    return r6(df, "null_percent_overall", "duplicate_percent")


@query("\nUNION ALL\n".join([*(f"SELECT * FROM ({_summary_sql(n)})" for n in _VIEWS), _BROKEN]))
def batch_summary_all_columns(spark, d):
    """All columns of the summary, with a source in the middle that cannot be read."""
    return _exact(A.summarize_batch(spark, _sources(spark, d)))


@query("\nUNION ALL\n".join([*(f"SELECT * FROM ({_summary_sql(n, 'grouped')})" for n in _VIEWS), _BROKEN]))
def analyze_many_summary(spark, d):
    return _exact(A.analyze_many(spark, _sources(spark, d)).summary)


@query("\nUNION ALL\n".join(f"SELECT '{n}' AS source_name, category, action, column_name, severity FROM ({_advice(n)})" for n in _VIEWS))
def analyze_many_recommendations(spark, d):
    """The recommendations of every source, from passes that sources of one layout share."""
    return A.analyze_many(spark, _sources(spark, d)).analysis.recommendations.drop("detail")


# --- expectations that the data meets -----------------------------------------------------------

@query(with_source("dirty_customer", "SELECT CAST(sum((non_null = rows)::INT + (uniques = non_null AND non_null > 0)::INT) AS BIGINT) AS expectations, CAST(0 AS BIGINT) AS failed FROM ("
       + union_columns("dirty_customer", "SELECT count(*) AS rows, count({c}) AS non_null, count(DISTINCT {c}) AS uniques FROM v") + ")"))
def default_expectations_hold(spark, d):
    """The expectations that a table meets today, fed back as a configuration: none fails."""
    m = A.collect_metrics(source(spark, d, "dirty_customer"))
    checked = X.check_expectations(m, X.as_config(X.default_expectations(m)))
    return checked.agg(F.count(F.lit(1)).alias("expectations"), F.count_if(~F.col("passed")).alias("failed"))


# --- values of report sections --------------------------------------------------------------------

@query(with_source("dirty_nulls", "SELECT column_name, utilization_percent, CASE WHEN utilization_percent < 50 THEN 'CRÍTICO' WHEN utilization_percent < 80 THEN 'BAJO' ELSE 'ACEPTABLE' END AS status FROM ("
       + union_columns("dirty_nulls", "SELECT '{c}' AS column_name, round(100.0 * count({c}) / count(*), 2) AS utilization_percent FROM v") + ")"))
def report_utilization(spark, d):
    return report_tables(A.analyze(source(spark, d, "dirty_nulls"), settled=False))["rows_and_utilization"]


_NULLS_IN_ROW = " + ".join(f"({c} IS NULL)::INT" for c, _ in SCHEMAS["dirty_nulls"])


@query(with_source("dirty_nulls", f"SELECT count(*) AS rows, {big('count(*) FILTER (k = 0)')} AS complete_rows, round(100.0 * count(*) FILTER (k = 0) / count(*), 2) AS complete_percent, "
       f"{big('count(*) FILTER (k > 0)')} AS rows_with_nulls FROM (SELECT {_NULLS_IN_ROW} AS k FROM v)"))
def report_completeness(spark, d):
    return report_tables(A.analyze(source(spark, d, "dirty_nulls"), settled=False))["row_completeness"]


@query(with_source("dirty_nulls", f"SELECT count(*) AS rows, {big(len(SCHEMAS['dirty_nulls']))} AS columns, '{', '.join(c for c, _ in SCHEMAS['dirty_nulls'])}' AS column_names FROM v"))
def report_general_info(spark, d):
    return report_tables(A.analyze(source(spark, d, "dirty_nulls"), settled=False))["general_info"]


@query(with_source("dirty_nulls", union_columns("dirty_nulls", """
SELECT '{c}' AS column_name, count({c}) AS non_null, count(*) - count({c}) AS null_count, round(100.0 * (count(*) - count({c})) / count(*), 2) AS null_percent,
       count(DISTINCT {c}) AS unique_count, round(100.0 * (count(DISTINCT {c}) + (count(*) > count({c}))::INT) / count(*), 2) AS cardinality_percent FROM v""")))
def report_column_profile(spark, d):
    found = report_tables(A.analyze(source(spark, d, "dirty_nulls"), settled=False))["column_profile"]
    return found.select("column_name", "non_null", "null_count", "null_percent", "unique_count", "cardinality_percent")


@query("SELECT 'issues' AS section, level AS a, type AS b, column_name FROM (" + _issues("dirty_customer") + ") UNION ALL SELECT category, action, severity, column_name FROM ("
       + _advice("dirty_customer") + ") UNION ALL SELECT 'filters', category, type, column_name FROM (" + _filters("dirty_customer") + ")")
def report_findings(spark, d):
    """The sections of findings, row by row; a section without findings says so in one row of nulls, which is left out here."""
    found = report_tables(A.analyze(source(spark, d, "dirty_customer")))
    rows = found["issues"].select(F.lit("issues").alias("section"), F.col("level").alias("a"), F.col("type").alias("b"), "column_name")
    for category in N.CATEGORIES:
        rows = rows.union(found[category].select(F.lit(category), "action", "severity", "column_name"))
    rows = rows.union(found["filters"].select(F.lit("filters"), "category", "type", "column_name"))
    return rows.where("a IS NOT NULL")
