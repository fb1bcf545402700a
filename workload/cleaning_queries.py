"""Semantic types, normalisation, clean and quarantine outputs."""

from __future__ import annotations

from pyspark.sql import functions as F

from clearwell import functions as X
from clearwell.operators import cleaning as C
from clearwell.operators import duplicates as D
from clearwell.operators import semantics as M

from .registry import big, query, source, sql_boolean, sql_canonical, sql_email, sql_parse, sql_trim, with_source


# --- normalised values, row by row -----------------------------------------------------------

@query(with_source("dirty_customer", f"SELECT id, {sql_canonical('importe')} AS canonical, try_cast({sql_canonical('importe')} AS DOUBLE) AS number FROM v"))
def normalize_number(spark, d):
    return source(spark, d, "dirty_customer").select(
        "id", X.normalize_number("importe").alias("canonical"), X.to_number("importe").alias("number"))


@query(with_source("dirty_orders", f"SELECT id, fecha_inicio, {sql_parse('fecha_inicio')} AS inicio, {sql_parse('fecha_fin')} AS fin FROM v"))
def parse_date(spark, d):
    return source(spark, d, "dirty_orders").select(
        "id", "fecha_inicio", X.parse_date("fecha_inicio").alias("inicio"), X.parse_date("fecha_fin").alias("fin"))



@query("SELECT o_orderkey, CAST(o_orderdate AS DATE) AS spanish, CAST(o_orderdate AS DATE) AS english, CAST(o_orderdate AS DATE) AS short FROM orders")
def parse_written_dates(spark, d):
    """Dates written out from the order date read back as that date."""
    day = F.dayofmonth("o_orderdate").cast("string")
    year = F.year("o_orderdate").cast("string")
    names = [
        "enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre",
        "January February March April May June July August September October November December",
        "ene feb mar abr may jun jul ago sep oct nov dic",
    ]
    es, en, short = (F.element_at(F.split(F.lit(n), " "), F.month("o_orderdate")) for n in names)
    return source(spark, d, "orders").select(
        "o_orderkey",
        X.parse_date(F.concat(day, F.lit(" de "), es, F.lit(" de "), year)).alias("spanish"),
        X.parse_date(F.concat(en, F.lit(" "), day, F.lit(", "), year)).alias("english"),
        X.parse_date(F.concat(day, F.lit("-"), short, F.lit("-"), year)).alias("short"))


@query(with_source("dirty_orders", f"SELECT id, activo, {sql_boolean('activo')} AS flag FROM v"))
def normalize_boolean(spark, d):
    return source(spark, d, "dirty_orders").select("id", "activo", X.normalize_boolean("activo").alias("flag"))


@query(with_source("dirty_customer", f"SELECT id, lower({sql_trim('email')}) AS email, {sql_email('email')} AS ok FROM v"))
def normalize_email(spark, d):
    return source(spark, d, "dirty_customer").select("id", X.normalize_email("email").alias("email"), X.is_email("email").alias("ok"))


# --- types -------------------------------------------------------------------------------------
_N = sql_canonical("importe")


@query(with_source("dirty_customer", f"""
, n AS (SELECT count(*) FILTER ({sql_trim('importe')} <> '') AS total, count({_N}) AS numbers,
        count(*) FILTER (try_cast({_N} AS DOUBLE) = floor(try_cast({_N} AS DOUBLE))) AS whole FROM v)
SELECT 'id' AS column_name, 'Text' AS semantic_type FROM n UNION ALL SELECT 'email', 'Email' FROM n UNION ALL SELECT 'nombre', 'Text' FROM n
UNION ALL SELECT 'importe', CASE WHEN numbers >= 0.5 * total THEN CASE WHEN whole = numbers THEN 'Integer' ELSE 'Float' END ELSE 'Text' END FROM n"""))
def semantic_types(spark, d):
    return M.semantic_types(source(spark, d, "dirty_customer")).select("column_name", "semantic_type")


@query(with_source("dirty_orders", f"""
, b AS (SELECT count(*) AS total, count({sql_boolean('activo')}) AS flags FROM v WHERE activo IS NOT NULL)
SELECT 'id' AS column_name, 'Text' AS semantic_type FROM b UNION ALL SELECT 'fecha_inicio', 'Date' FROM b UNION ALL SELECT 'fecha_fin', 'Date' FROM b
UNION ALL SELECT 'total', 'Float' FROM b UNION ALL SELECT 'activo', CASE WHEN flags >= 0.9 * total THEN 'Boolean' ELSE 'Text' END FROM b"""))
def semantic_types_orders(spark, d):
    return M.semantic_types(source(spark, d, "dirty_orders")).select("column_name", "semantic_type")


@query(with_source("dirty_customer", f"""
, n AS (SELECT {_N} AS s FROM v),
m AS (SELECT greatest(max(length(regexp_replace(split_part(s, '.', 1), '^-?0*', ''))), 1) AS w,
      max(length(regexp_replace(split_part(s, '.', 2), '0+$', ''))) AS f FROM n WHERE s IS NOT NULL)
SELECT 'importe' AS column_name, CAST(greatest(w + greatest(f, 2), 10) AS INTEGER) AS precision, CAST(least(greatest(f, 2), 10) AS INTEGER) AS scale FROM m"""))
def decimal_types(spark, d):
    return M.decimal_types(source(spark, d, "dirty_customer"), "importe")


@query(with_source("dirty_orders", "\nUNION ALL\n".join(f"""
SELECT '{c}' AS column_name, CASE WHEN a >= b THEN '%Y-%m-%d' ELSE '%d/%m/%Y' END AS date_format, greatest(a, b) AS parsed_values FROM (
SELECT count(*) FILTER (regexp_matches({c}, '^[0-9]{{4}}-') AND try_strptime({c}, '%Y-%m-%d') IS NOT NULL) AS a,
       count(*) FILTER (contains({c}, '/') AND try_strptime({c}, '%d/%m/%Y') IS NOT NULL) AS b FROM v)""" for c in ("fecha_inicio", "fecha_fin"))))
def dominant_date_format(spark, d):
    return M.dominant_date_format(source(spark, d, "dirty_orders"), ["fecha_inicio", "fecha_fin"])


# --- clean and quarantine -------------------------------------------------------------------------
_ORDER_TYPES = {"fecha_inicio": M.DATE, "fecha_fin": M.DATE, "activo": M.BOOLEAN}


def _order_types(df):
    return [M.ColumnType(c, _ORDER_TYPES.get(c, M.TEXT)) for c in df.columns]


_S, _E = sql_parse("fecha_inicio"), sql_parse("fecha_fin")
_START_OK = f"(fecha_inicio IS NULL OR {_S} IS NOT NULL)"
_END_OK = f"((fecha_fin IS NULL OR {_E} IS NOT NULL) AND coalesce({_E} >= {_S}, true))"
_FLAG_OK = f"(activo IS NULL OR {sql_boolean('activo')} IS NOT NULL)"


@query(with_source("dirty_orders", f"""
SELECT id, {_S} AS fecha_inicio, {_E} AS fecha_fin, {sql_boolean('activo')} AS activo, total FROM v WHERE {_START_OK} AND {_END_OK} AND {_FLAG_OK}"""))
def clean_rows(spark, d):
    df = source(spark, d, "dirty_orders")
    return C.clean_rows(df, _order_types(df))


_QUARANTINE = f"""
SELECT id, 'fecha_inicio' AS column_name, 'BAD_DATE' AS category, fecha_inicio AS original_value FROM v WHERE NOT {_START_OK}
UNION ALL SELECT id, 'fecha_fin', 'BAD_DATE_RANGE', fecha_fin FROM v WHERE NOT {_END_OK}
UNION ALL SELECT id, 'activo', 'BAD_BOOLEAN', activo FROM v WHERE NOT {_FLAG_OK}"""


@query(with_source("dirty_orders", f"SELECT column_name, category, original_value, id FROM ({_QUARANTINE})"))
def quarantine_rows(spark, d):
    df = source(spark, d, "dirty_orders")
    return C.quarantine_rows(df, _order_types(df)).select(
        "column_name", "category", "original_value", F.get_json_object("row_json", "$.id").cast("bigint").alias("id"))


@query(with_source("dirty_customer", f"""
SELECT 'email' AS column_name, 'BAD_EMAIL' AS category, email AS original_value,
       to_json(struct_pack(id := id, nombre := nombre, email := email, importe := importe)) AS row_json FROM v WHERE email IS NOT NULL AND NOT {sql_email('email')}
UNION ALL SELECT 'importe', 'BAD_NUMBER', importe, to_json(struct_pack(id := id, nombre := nombre, email := email, importe := importe))
FROM v WHERE importe IS NOT NULL AND try_cast({_N} AS DOUBLE) IS NULL""").replace("to_json(struct_pack", "CAST(to_json(struct_pack").replace("importe := importe))", "importe := importe)) AS VARCHAR)"))
def quarantine_customer(spark, d):
    """Types found from the data; the whole row travels as JSON with its nulls."""
    return C.quarantine_rows(source(spark, d, "dirty_customer")).drop("rejected_at", "source")


@query(with_source("dirty_customer", f"""
SELECT id, {sql_trim('nombre')} AS nombre, lower({sql_trim('email')}) AS email, CAST({_N} AS DECIMAL(12, 2)) AS importe FROM v
WHERE (email IS NULL OR {sql_email('email')}) AND (importe IS NULL OR try_cast({_N} AS DOUBLE) IS NOT NULL)"""))
def clean_customer(spark, d):
    df = source(spark, d, "dirty_customer")
    types = [M.ColumnType("nombre", M.TEXT), M.ColumnType("email", M.EMAIL), M.ColumnType("importe", M.FLOAT, 12, 2)]
    return C.clean_rows(df, types)


@query(with_source("dirty_orders", f"SELECT column_name, category, count(*) AS total_errors FROM ({_QUARANTINE}) GROUP BY 1, 2"))
def quarantine_summary(spark, d):
    df = source(spark, d, "dirty_orders")
    return C.quarantine_summary(C.quarantine_rows(df, _order_types(df)))


@query(with_source("dirty_orders", f"SELECT id, fecha_inicio, fecha_fin FROM v WHERE coalesce({_E} < {_S}, false)"))
def date_range_check(spark, d):
    df = source(spark, d, "dirty_orders").select("id", "fecha_inicio", "fecha_fin")
    bad = C.quarantine_rows(df, _order_types(df)).where(F.col("category") == "BAD_DATE_RANGE")
    return bad.select(*[F.get_json_object("row_json", f"$.{c}").alias(c) for c in df.columns]).withColumn("id", F.col("id").cast("bigint"))


@query(with_source("dirty_orders", f"""
, c AS (SELECT id, {_S} AS fecha_inicio, {_E} AS fecha_fin, {sql_boolean('activo')} AS activo, total FROM v WHERE {_START_OK} AND {_END_OK} AND {_FLAG_OK})
SELECT 'clean_rows' AS "check", 'table' AS subject, count(*) AS value FROM c
UNION ALL SELECT 'quarantine_rows', 'table', count(*) FROM ({_QUARANTINE})
UNION ALL SELECT 'null_values', 'id', count(*) - count(id) FROM c UNION ALL SELECT 'null_values', 'fecha_inicio', count(*) - count(fecha_inicio) FROM c
UNION ALL SELECT 'null_values', 'fecha_fin', count(*) - count(fecha_fin) FROM c UNION ALL SELECT 'null_values', 'activo', count(*) - count(activo) FROM c
UNION ALL SELECT 'null_values', 'total', count(*) - count(total) FROM c"""))
def post_load_checks(spark, d):
    df = source(spark, d, "dirty_orders")
    return C.post_load_checks(C.clean_rows(df, _order_types(df)), C.quarantine_rows(df, _order_types(df)))


@query(with_source("dirty_orders", "SELECT id, fecha_inicio, fecha_fin, count(*) AS count_duplicates FROM v GROUP BY 1, 2, 3 HAVING count(*) > 1"))
def repeated_keys(spark, d):
    return C.repeated_keys(source(spark, d, "dirty_orders"))


@query("SELECT doc_id, md5(text) AS text_md5 FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS rn FROM documents) WHERE rn = 1")
def keep_first(spark, d):
    first = D.keep_first(source(spark, d, "documents").select("doc_id", "text"), "doc_id")
    return first.select("doc_id", F.md5("text").alias("text_md5"))


@query("SELECT doc_id, lang, n_chars FROM (SELECT *, row_number() OVER (PARTITION BY lang, source ORDER BY doc_id) AS rn FROM documents) WHERE rn = 1")
def keep_first_by_columns(spark, d):
    return D.keep_first(source(spark, d, "documents"), "doc_id", ["lang", "source"]).select("doc_id", "lang", "n_chars")


@query("SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT min(doc_id) FROM documents GROUP BY text, lang)")
def keep_min_id(spark, d):
    return D.keep_min_id(source(spark, d, "documents"), "doc_id", ["text", "lang"]).select("doc_id", "lang")


@query(with_source("dirty_nulls", "SELECT id FROM v WHERE n45 IS NOT NULL AND n40 IS NOT NULL AND n80 IS NOT NULL AND n85 IS NOT NULL AND n100 IS NOT NULL"))
def drop_critical_nulls(spark, d):
    return C.drop_critical_null_rows(source(spark, d, "dirty_nulls")).select("id")


@query(with_source("dirty_nulls", "SELECT id, n45 FROM v WHERE n45 IS NOT NULL AND n40 IS NOT NULL"))
def drop_critical_nulls_kept(spark, d):
    """Two columns at and above the threshold; what is left is not empty."""
    return C.drop_critical_null_rows(source(spark, d, "dirty_nulls").select("id", "n0", "n30", "n45", "n40")).select("id", "n45")


@query(with_source("dirty_orders", f"""
SELECT DISTINCT id, {_S} AS fecha_inicio, {_E} AS fecha_fin, {sql_boolean('activo')} AS activo, total FROM v"""))
def clean(spark, d):
    return C.clean(source(spark, d, "dirty_orders"), overrides={"activo": M.BOOLEAN})


@query("SELECT count(*) AS rows, count(*) AS keys, CAST(1 AS BIGINT) AS first, count(*) AS last FROM lineitem")
def surrogate_key(spark, d):
    """Dense numbers over a shuffled table of many partitions, read back with one column only."""
    keyed = C.with_surrogate_key(source(spark, d, "lineitem").repartition(64, "l_partkey"), "k", dense=True)
    return keyed.agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("k").alias("keys"), F.min("k").alias("first"), F.max("k").alias("last"))


_FRACTIONS = """WITH v AS (SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN '1.00000000001' ELSE CAST(o_orderkey AS VARCHAR) END AS entero,
  CAST(o_orderkey AS VARCHAR) || '.' || lpad(CAST(o_custkey * 10 + 1 AS VARCHAR), 12, '0') AS importe FROM orders)
"""


def _fractions(spark, d):
    df = source(spark, d, "orders").select(
        "o_orderkey",
        F.when(F.col("o_orderkey") % 7 == 0, "1.00000000001").otherwise(F.col("o_orderkey").cast("string")).alias("entero"),
        F.concat(F.col("o_orderkey").cast("string"), F.lit("."), F.lpad((F.col("o_custkey") * 10 + 1).cast("string"), 12, "0")).alias("importe"),
    )
    return df, M.column_types(df, {"entero": M.INTEGER, "importe": M.FLOAT})


@query(_FRACTIONS + "SELECT o_orderkey, entero, importe FROM v WHERE o_orderkey % 7 <> 0")
def clean_fractions(spark, d):
    """Twelve decimals stay as they are."""
    df, types = _fractions(spark, d)
    return C.clean_rows(df, types).select("o_orderkey", F.col("entero").cast("string").alias("entero"), F.col("importe").cast("string").alias("importe"))


@query(_FRACTIONS + "SELECT 'entero' AS column_name, entero AS original_value, count(*) AS rows FROM v WHERE o_orderkey % 7 = 0 GROUP BY entero")
def quarantine_fractions(spark, d):
    """A number that is almost whole is not rounded to one."""
    df, types = _fractions(spark, d)
    return C.quarantine_rows(df, types).groupBy("column_name", "original_value").agg(F.count(F.lit(1)).alias("rows"))
