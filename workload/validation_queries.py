"""Value predicates and the validation jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from clearwell import functions as X
from clearwell.columns import long_form, profiled_fields
from clearwell.operators import rules as U
from clearwell.operators import validation as V
from clearwell.plans.analysis import collect_metrics
from clearwell.plans.expectations import check_expectations

from .registry import (
    SCHEMAS, WS, big, query, r6, source, sql_content, sql_date, sql_email, sql_format, sql_number, sql_parse,
    sql_phone, sql_trim, sql_url, with_source,
)


def _text_union(name, template):
    return "\nUNION ALL\n".join(template(c) for c, k in SCHEMAS[name] if k == "t")


# --- predicates over every text value of a table ---------------------------------------

def _predicates(name):
    def one(c):
        return f"""
SELECT '{c}' AS column_name,
       {big(f'count(*) FILTER ({sql_email(c)})')} AS emails, {big(f'count(*) FILTER ({sql_phone(c)})')} AS phones,
       {big(f'count(*) FILTER ({sql_url(c)})')} AS urls, {big(f'count(*) FILTER ({sql_date(c)})')} AS dates,
       {big(f"count(*) FILTER (regexp_matches({sql_trim(c)}, '^[+-]?[0-9]+$'))")} AS integers,
       {big(f'count(*) FILTER ({sql_number(c)})')} AS numbers
FROM v WHERE {c} IS NOT NULL GROUP BY 1"""
    return with_source(name, _text_union(name, one))


for _name in ("dirty_customer", "dirty_contacts", "dirty_orders", "pages"):
    def _run(spark, d, _name=_name):
        df = source(spark, d, _name)
        cells = long_form(df, [f for f in profiled_fields(df) if f.dataType.simpleString() == "string"])
        tests = {"emails": X.is_email, "phones": X.is_phone, "urls": X.is_url, "dates": X.is_date,
                 "integers": X.is_integer, "numbers": X.is_number}
        return cells.groupBy("column_name").agg(*[F.count_if(t("value")).alias(n) for n, t in tests.items()])
    query(_predicates(_name), f"predicates_{_name}")(_run)


_SPECIAL = "[^\\p{L}\\p{N}_\\s\\p{Z}.,-]"


@query(with_source("documents", f"""
SELECT doc_id, regexp_matches(text, '{_SPECIAL}') AS special, text <> {sql_trim('text')} AS edges,
       regexp_matches(text, '[<>{{}}"|\\\\^`~]') AS sql_unsafe,
       {big("length(regexp_replace(text, '[\\p{L}\\p{N} ]+', '', 'g'))")} AS special_count,
       md5(regexp_replace({sql_trim('text')}, '[{WS}]+', ' ', 'g')) AS collapsed_md5,
       CASE WHEN length(text) > 50 THEN substr(text, 1, 50) || '...' ELSE text END AS shortened
FROM v"""))
def text_expressions(spark, d):
    t = "text"
    return source(spark, d, "documents").select(
        "doc_id", X.has_special_chars(t).alias("special"), X.has_edge_spaces(t).alias("edges"),
        X.has_sql_unsafe_chars(t).alias("sql_unsafe"), X.special_char_count(t).cast("bigint").alias("special_count"),
        F.md5(X.collapse_spaces(t)).alias("collapsed_md5"), X.truncate(t, 50).alias("shortened"))


@query("""SELECT l_linenumber, CAST(count(*) FILTER (l_quantity BETWEEN 5 AND 25) AS BIGINT) AS in_range,
CAST(count(*) FILTER (l_discount <= 0.05) AS BIGINT) AS low_discount FROM lineitem GROUP BY l_linenumber""")
def in_range(spark, d):
    return source(spark, d, "lineitem").groupBy("l_linenumber").agg(
        F.count_if(X.in_range("l_quantity", 5, 25)).alias("in_range"),
        F.count_if(X.in_range("l_discount", high=0.05)).alias("low_discount"))


# --- content types ---------------------------------------------------------------------

def _content(name):
    def one(c):
        return f"SELECT '{c}' AS column_name, {sql_content(c)} AS t FROM v WHERE {c} IS NOT NULL"
    kinds = ("email", "phone", "url", "date", "numeric", "other")
    counts = ", ".join(f"{big(f'count(*) FILTER (t = {chr(39)}{k}{chr(39)})')} AS n_{k}" for k in kinds)
    winner = "CASE " + " ".join(f"WHEN n_{k} >= 0.7 * total_values THEN '{k}'" for k in kinds) + " END"
    return with_source(name, f"""
SELECT *, {winner} AS content_type FROM (
SELECT column_name, count(*) AS total_values, {counts} FROM ({_text_union(name, one)}) GROUP BY column_name)""")


for _name in ("dirty_customer", "dirty_contacts", "dirty_orders", "documents"):
    def _run(spark, d, _name=_name):
        return V.detect_content_types(source(spark, d, _name))
    query(_content(_name), f"content_types_{_name}")(_run)


# --- validators ------------------------------------------------------------------------

def _validated(name, column, test, by_content):
    return with_source(name, f"""
SELECT '{{v}}' AS validator, '{column}' AS column_name, {big('count(*) FILTER (ok)')} AS valid_count,
       {big('count(*) FILTER (NOT ok)')} AS invalid_count, round(100.0 * count(*) FILTER (NOT ok) / count(*), 6) AS invalid_percent,
       count(*) FILTER (NOT ok) > 0 AS is_problematic, {by_content} AS detected_by_content
FROM (SELECT {test} AS ok FROM v WHERE {column} IS NOT NULL)""")


@query(_validated("dirty_customer", "email", sql_email("email"), "count(*) FILTER (ok) >= 0.7 * count(*)").replace("{v}", "email"))
def validate_email(spark, d):
    return r6(V.validate_email(source(spark, d, "dirty_customer")), "invalid_percent")


@query(_validated("dirty_contacts", "telefono", sql_phone("telefono"), "count(*) FILTER (ok) >= 0.7 * count(*)").replace("{v}", "phone"))
def validate_phone(spark, d):
    return r6(V.validate_phone(source(spark, d, "dirty_contacts")), "invalid_percent")


@query(_validated("dirty_contacts", "website", sql_url("website"), "count(*) FILTER (ok) >= 0.7 * count(*)").replace("{v}", "url"))
def validate_url(spark, d):
    return r6(V.validate_url(source(spark, d, "dirty_contacts")), "invalid_percent")


@query(_validated("pages", "url", sql_url("url"), "count(*) FILTER (ok) >= 0.7 * count(*)").replace("{v}", "url"))
def validate_url_pages(spark, d):
    return r6(V.validate_url(source(spark, d, "pages")), "invalid_percent")


_AMBIGUOUS = (
    "(regexp_matches({c}, '[-/]') AND coalesce(try_cast(regexp_split_to_array(trim({c}), '[-/]')[1] AS INTEGER) <= 12, false)"
    " AND coalesce(try_cast(regexp_split_to_array(trim({c}), '[-/]')[2] AS INTEGER) <= 12, false))"
)


def _dates(c):
    return f"""
SELECT '{c}' AS column_name, {sql_parse(c)} IS NOT NULL AS ok, coalesce({sql_format(c)}, '<formato_no_estándar>') AS format,
       {_AMBIGUOUS.format(c=c)} AS ambiguous, {sql_content(c)} AS content FROM v WHERE {c} IS NOT NULL"""


_DATE_CELLS = _dates("fecha_inicio") + "\nUNION ALL\n" + _dates("fecha_fin")


@query(with_source("dirty_orders", f"""
, cells AS ({_DATE_CELLS}),
f AS (SELECT column_name, format, count(*) AS n FROM cells WHERE ok GROUP BY column_name, format),
g AS (SELECT column_name, count(*) AS formats, max(n) AS best FROM f GROUP BY column_name),
b AS (SELECT f.column_name, min(list_position(['%Y-%m-%d', '%d/%m/%Y', '%m/%d/%Y', '%d-%m-%Y', '%Y/%m/%d', '%d.%m.%Y', '%Y%m%d'], format)) AS p
      FROM f JOIN g ON f.column_name = g.column_name AND f.n = g.best GROUP BY f.column_name)
SELECT 'date' AS validator, c.column_name, {big('count(*) FILTER (ok)')} AS valid_count, {big('count(*) FILTER (NOT ok)')} AS invalid_count,
       round(100.0 * count(*) FILTER (NOT ok) / count(*), 6) AS invalid_percent, true AS is_problematic,
       count(*) FILTER (content = 'date') >= 0.7 * count(*) AS detected_by_content,
       CAST(any_value(formats) AS INTEGER) AS formats,
       any_value(['%Y-%m-%d', '%d/%m/%Y', '%m/%d/%Y', '%d-%m-%Y', '%Y/%m/%d', '%d.%m.%Y', '%Y%m%d'][p]) AS most_common_format,
       round(any_value(best) / count(*) FILTER (ok), 6) AS format_consistency,
       {big('count(*) FILTER (ambiguous)')} AS ambiguous_count
FROM cells c JOIN g ON c.column_name = g.column_name JOIN b ON c.column_name = b.column_name GROUP BY c.column_name
HAVING count(*) FILTER (NOT ok) > 0 OR any_value(best) < 0.95 * count(*) FILTER (ok) OR count(*) FILTER (ambiguous) > 0
UNION ALL
SELECT 'date', c.column_name, {big('count(*)')}, 0, 0, false, count(*) FILTER (content = 'date') >= 0.7 * count(*), CAST(any_value(formats) AS INTEGER),
       '%Y-%m-%d', 1.0, 0
FROM cells c JOIN g ON c.column_name = g.column_name GROUP BY c.column_name
HAVING count(*) FILTER (NOT ok) = 0 AND any_value(best) >= 0.95 * count(*) AND count(*) FILTER (ambiguous) = 0""").replace(")\n\n,", "),\n"))
def validate_date(spark, d):
    return r6(V.validate_date(source(spark, d, "dirty_orders")), "invalid_percent", "format_consistency")


@query(with_source("dirty_orders", f"SELECT column_name, format, count(*) AS cnt FROM ({_DATE_CELLS}) WHERE ok GROUP BY column_name, format"))
def date_formats(spark, d):
    return V.date_formats(source(spark, d, "dirty_orders"))


@query("SELECT 'o_orderdate' AS column_name, '<formato_no_estándar>' AS format, count(*) AS cnt FROM orders")
def date_formats_native(spark, d):
    return V.date_formats(source(spark, d, "orders"))


@query(with_source("dirty_orders", "\nUNION ALL\n".join(
    f"SELECT id, '{c}' AS column_name, {c} AS value FROM v WHERE {c} IS NOT NULL AND {_AMBIGUOUS.format(c=c)}" for c in ("fecha_inicio", "fecha_fin"))))
def ambiguous_dates(spark, d):
    return V.ambiguous_dates(source(spark, d, "dirty_orders"), "id")


@query(with_source("dirty_customer", f"""
SELECT 'email' AS column_name, n, id, value FROM (SELECT row_number() OVER (ORDER BY id) AS n, id, substr(email, 1, 50) AS value
FROM v WHERE email IS NOT NULL AND NOT {sql_email('email')}) WHERE n <= 5"""))
def invalid_email_examples(spark, d):
    return V.invalid_examples(source(spark, d, "dirty_customer"), "email", "id", "email")


def _examples(view: str, column: str, valid: str) -> str:
    return with_source(view, f"""
SELECT '{column}' AS column_name, n, id, value FROM (SELECT row_number() OVER (ORDER BY id) AS n, id, substr({column}, 1, 50) AS value
FROM v WHERE {column} IS NOT NULL AND NOT coalesce({valid}, false)) WHERE n <= 5""")


@query(_examples("dirty_contacts", "telefono", sql_phone("telefono")))
def invalid_phone_examples(spark, d):
    return V.invalid_examples(source(spark, d, "dirty_contacts"), "phone", "id", "telefono")


@query(_examples("dirty_contacts", "website", sql_url("website")))
def invalid_url_examples(spark, d):
    return V.invalid_examples(source(spark, d, "dirty_contacts"), "url", "id", "website")


@query(_examples("dirty_orders", "fecha_inicio", sql_parse("fecha_inicio") + " IS NOT NULL"))
def invalid_date_examples(spark, d):
    return V.invalid_examples(source(spark, d, "dirty_orders"), "date", "id", "fecha_inicio")


@query(f"""
SELECT 'text' AS column_name, n, doc_id, value FROM (SELECT row_number() OVER (ORDER BY doc_id) AS n, doc_id, substr(text, 1, 50) AS value
FROM documents WHERE regexp_matches(text, '{_SPECIAL}')) WHERE n <= 3""")
def special_char_examples(spark, d):
    return V.invalid_examples(source(spark, d, "documents"), "special_chars", "doc_id", "text", k=3)


def _numeric(name):
    parts = [f"""
SELECT '{c}' AS column_name, round(CAST(min({c}) AS DOUBLE), 6) AS min, round(CAST(max({c}) AS DOUBLE), 6) AS max, {big(f'count(*) FILTER ({c} < 0)')} AS negative_count,
       {big(f'count(*) FILTER ({c} = 0)')} AS zero_count, {f'count(*) FILTER ({c} < 0) > 0' if 'edad' in c else 'false'} AS is_problematic FROM v"""
             for c, k in SCHEMAS[name] if k == "n"]
    return with_source(name, "\nUNION ALL\n".join(parts))


for _name in ("dirty_people", "lineitem"):
    def _run(spark, d, _name=_name):
        return r6(V.validate_numeric(source(spark, d, _name)), "min", "max")
    query(_numeric(_name), f"validate_numeric_{_name}")(_run)


@query(with_source("dirty_people", """SELECT 'edad' AS column_name, n, id, CAST(edad AS DOUBLE) AS value
FROM (SELECT *, row_number() OVER (ORDER BY id) AS n FROM v WHERE edad < 0) WHERE n <= 5"""))
def negative_examples(spark, d):
    return V.negative_examples(source(spark, d, "dirty_people"), "id", "edad")


def _texts(name):
    def one(c):
        return f"""
SELECT '{c}' AS column_name, {big(f"count(*) FILTER (regexp_matches({c}, '{_SPECIAL}'))")} AS special_chars_count,
       {big(f'count(*) FILTER ({c} <> {sql_trim(c)})')} AS edge_spaces_count, {big(f'count(*) FILTER (length({c}) > 500)')} AS long_values_count,
       count(*) FILTER (regexp_matches({c}, '{_SPECIAL}') OR {c} <> {sql_trim(c)}) > 0 AS is_problematic
FROM v WHERE {c} IS NOT NULL GROUP BY 1"""
    return with_source(name, _text_union(name, one))


for _name in ("dirty_customer", "documents", "pages", "conversations"):
    def _run(spark, d, _name=_name):
        return V.validate_text(source(spark, d, _name))
    query(_texts(_name), f"validate_text_{_name}")(_run)


@query(with_source("pages", "\nUNION ALL\n".join(f"""
SELECT '{c}' AS column_name, {big(f"count(*) FILTER (regexp_matches(CAST({c} AS VARCHAR), '[<>{{}}" + '"' + "|\\\\^`~]'))")} AS unsafe_count,
       round(100.0 * count(*) FILTER (regexp_matches(CAST({c} AS VARCHAR), '[<>{{}}"|\\\\^`~]')) / count(*), 6) AS unsafe_percent FROM v"""
    for c, _ in SCHEMAS["pages"])))
def unsafe_chars(spark, d):
    return r6(V.unsafe_chars(source(spark, d, "pages")), "unsafe_percent")


@query(with_source("dirty_customer", f"""
SELECT 'email' AS validator, {big(f'(count(*) FILTER (NOT {sql_email("email")}) > 0)::INT')} AS issues, 'email' AS columns_with_issues FROM v
UNION ALL SELECT 'numeric', 0, '' FROM v HAVING count(*) > 0
UNION ALL SELECT 'text', 3, 'email, importe, nombre' FROM v HAVING count(*) FILTER (regexp_matches(nombre, '{_SPECIAL}')) > 0
  AND count(*) FILTER (regexp_matches(importe, '{_SPECIAL}')) > 0 AND count(*) FILTER (regexp_matches(email, '{_SPECIAL}')) > 0"""))
def validation_summary(spark, d):
    df = source(spark, d, "dirty_customer")
    return V.validation_summary(V.validate_contents(df), V.validate_numeric(df), V.validate_text(df))


# --- domain rules ------------------------------------------------------------------------
_RULES = [
    ("healthcare", "age", "age", "numeric", "age < 0 OR age > 120"),
    ("hr", "age", "age", "numeric", "age < 18 OR age > 75"),
    ("hr", "salary", "salary", "numeric", "salary < 500 OR salary > 10000000"),
    ("hr", "employee_id", "employee_id", "text", "NOT regexp_matches(employee_id, '^[A-Z]{2}[0-9]{6}$')"),
    ("hr", "department", "department", "category",
     "department IS NULL OR department NOT IN ('IT', 'HR', 'Finance', 'Sales', 'Operations', 'Marketing')"),
    ("government", "age", "age", "numeric", "age < 0 OR age > 120"),
    ("government", "zip_code", "zip_code", "text", "NOT regexp_matches(zip_code, '^[0-9]{5}$')"),
]


@query(with_source("dirty_people", "\nUNION ALL\n".join(f"""
SELECT '{dom}' AS domain, '{rule}' AS rule, '{c}' AS column_name, '{kind}' AS rule_type, count(*) AS rows,
       {big(f'count(*) FILTER ({bad})')} AS violations, round(100.0 * count(*) FILTER ({bad}) / count(*), 6) AS violation_percent FROM v"""
    for dom, rule, c, kind, bad in _RULES)))
def domain_rules(spark, d):
    return r6(U.check_rules(source(spark, d, "dirty_people"), U.domain_rules()), "violation_percent").drop("rule_detail")


@query(with_source("dirty_people", "\nUNION ALL\n".join(f"""
SELECT '{dom}' AS domain, '{rule}' AS rule, '{c}' AS column_name, id, value, n FROM (
SELECT id, CAST({c} AS VARCHAR) AS value, row_number() OVER (ORDER BY id) AS n FROM v WHERE {bad}) WHERE n <= 10"""
    for dom, rule, c, kind, bad in _RULES if dom == "hr" and rule != "salary")))
def domain_rule_examples(spark, d):
    rules = [r for r in U.domain_rules("hr") if r.name != "salary"]
    return U.rule_examples(source(spark, d, "dirty_people"), rules, "id")


@query("""SELECT 'p_retailprice' AS column_name, count(*) AS rows, CAST(count(*) FILTER (p_retailprice < 0) AS BIGINT) AS violations FROM part""")
def domain_rules_price(spark, d):
    return U.check_rules(source(spark, d, "part"), U.domain_rules("ecommerce")).select("column_name", "rows", "violations")


@query("""SELECT 'l_partkey' AS column_name, count(*) AS rows,
CAST(count(*) FILTER (NOT EXISTS (SELECT 1 FROM part WHERE p_partkey = l_partkey AND p_retailprice > 1000)) AS BIGINT) AS violations FROM lineitem""")
def allowed_values_table(spark, d):
    allowed = source(spark, d, "part").where("p_retailprice > 1000").select("p_partkey")
    return U.check_allowed(source(spark, d, "lineitem"), "l_partkey", allowed).drop("violation_percent")


_EXPECTED = {
    "columns": {
        "id": {"nullable": False, "unique": True},
        "nombre": {"nullable": False},
        "email": {"validations": ["email"]},
    },
    "validation_rules": {"min_rows": 10, "max_null_percent": 30, "email_valid": True},
}


@query(with_source("dirty_customer", f"""
SELECT 'column' AS scope, 'id' AS column_name, 'nullable' AS expectation, 'False' AS expected, CAST(count(*) - count(id) AS DOUBLE) AS observed, count(*) = count(id) AS passed FROM v
UNION ALL SELECT 'column', 'id', 'unique', 'True', count(DISTINCT id), count(DISTINCT id) = count(id) FROM v
UNION ALL SELECT 'column', 'nombre', 'nullable', 'False', count(*) - count(nombre), count(*) = count(nombre) FROM v
UNION ALL SELECT 'column', 'email', 'valid_email', 'True', count(*) FILTER (NOT {sql_email('email')}), count(*) FILTER (NOT {sql_email('email')}) = 0 FROM v
UNION ALL SELECT 'table', 'email', 'email_valid', 'True', count(*) FILTER (NOT {sql_email('email')}), count(*) FILTER (NOT {sql_email('email')}) = 0 FROM v
UNION ALL SELECT 'table', NULL, 'min_rows', '10', count(*), count(*) >= 10 FROM v
UNION ALL SELECT 'table', NULL, 'max_null_percent', '30', round(100.0 * sum((nombre IS NULL)::INT + (email IS NULL)::INT) / (4 * count(*)), 6),
       sum((nombre IS NULL)::INT + (email IS NULL)::INT) <= 0.3 * 4 * count(*) FROM v"""))
def expectations(spark, d):
    return r6(check_expectations(collect_metrics(source(spark, d, "dirty_customer")), _EXPECTED), "observed")
