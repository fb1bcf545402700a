"""Inputs with known defects, derived from the whole driver tables.

The tables themselves hold no nulls, blanks or duplicates. Each view is one SQL
text that reads the same in Spark and in DuckDB and keeps every row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_K = "CAST(c_custkey AS STRING)"
_O = "o_orderkey"
_DATE_PARTS = {
    "y": "CAST(extract(year FROM o_orderdate) AS STRING)",
    "m": "lpad(CAST(extract(month FROM o_orderdate) AS STRING), 2, '0')",
    "d": "lpad(CAST(extract(day FROM o_orderdate) AS STRING), 2, '0')",
}

_ORDERS = f"""
SELECT {_O} AS id,
       CASE WHEN {_O} % 31 = 0 THEN '31/02/2024'
            WHEN {_O} % 29 = 0 THEN NULL
            WHEN {_O} % 4 = 0 THEN concat({{y}}, '-', {{m}}, '-', {{d}})
            WHEN {_O} % 4 = 1 THEN concat({{d}}, '/', {{m}}, '/', {{y}})
            WHEN {_O} % 4 = 2 THEN concat({{d}}, '.', {{m}}, '.', {{y}})
            ELSE concat({{y}}, {{m}}, {{d}}) END AS fecha_inicio,
       CASE WHEN {_O} % 23 = 0 THEN '1900-01-01' ELSE '2100-12-31' END AS fecha_fin,
       CASE {_O} % 6 WHEN 0 THEN 'Si' WHEN 1 THEN 'verdadero' WHEN 2 THEN 'N' WHEN 3 THEN '0'
            WHEN 4 THEN 'quizas' ELSE NULL END AS activo,
       o_totalprice AS total
FROM orders
""".format(**_DATE_PARTS)

VIEWS = {
    "dirty_customer": f"""
SELECT c_custkey AS id,
       CASE WHEN c_custkey % 11 = 0 THEN NULL WHEN c_custkey % 13 = 0 THEN '   '
            WHEN c_custkey % 7 = 0 THEN concat('  ', c_name, ' ') ELSE c_name END AS nombre,
       CASE WHEN c_custkey % 5 = 0 THEN NULL WHEN c_custkey % 9 = 0 THEN concat('bad..', {_K}, '@x.com')
            WHEN c_custkey % 17 = 0 THEN concat('USER', {_K}, '@TEST.COM')
            ELSE concat('user', {_K}, '@example.com') END AS email,
       CASE c_custkey % 4 WHEN 0 THEN concat('$', {_K}, ',234.50') WHEN 1 THEN concat('(', {_K}, ')')
            WHEN 2 THEN 'n/d' ELSE {_K} END AS importe
FROM customer""",
    # Exact duplicates: a tenth of the rows is there twice.
    "dirty_orders": f"""
SELECT * FROM ({_ORDERS}) a
UNION ALL
SELECT * FROM ({_ORDERS}) b WHERE id % 10 = 0""",
    "dirty_contacts": f"""
SELECT c_custkey AS id,
       CASE c_custkey % 6 WHEN 0 THEN concat('+346', lpad({_K}, 8, '0'))
            WHEN 1 THEN concat('(555) ', lpad({_K}, 7, '0')) WHEN 2 THEN concat('555.', lpad({_K}, 7, '0'))
            WHEN 3 THEN '123' WHEN 4 THEN 'not-a-phone' ELSE NULL END AS telefono,
       CASE c_custkey % 4 WHEN 0 THEN concat('https://example.com/', {_K}) WHEN 1 THEN concat('www.example.com/', {_K})
            WHEN 2 THEN 'ftp://example.com' ELSE concat('http://sub.example.org/?q=', {_K}) END AS website
FROM customer""",
    "dirty_nulls": """
SELECT p_partkey AS id,
       p_name AS n0,
       CASE WHEN p_partkey % 10 < 3 THEN NULL ELSE p_brand END AS n30,
       CASE WHEN p_partkey % 20 < 9 THEN NULL ELSE p_type END AS n45,
       CASE WHEN p_partkey % 20 < 17 THEN NULL ELSE p_size END AS n85,
       CAST(NULL AS STRING) AS n100,
       CASE WHEN p_partkey % 10 < 4 THEN NULL ELSE p_retailprice END AS n40,
       CASE WHEN p_partkey % 10 < 8 THEN NULL ELSE p_name END AS n80
FROM part""",
    "dirty_people": f"""
SELECT c_custkey AS id,
       CAST(c_custkey % 140 AS INTEGER) - 5 AS age,
       CAST(c_custkey % 90 AS INTEGER) - 3 AS edad,
       c_acctbal * 10 AS salary,
       CASE c_custkey % 8 WHEN 0 THEN 'IT' WHEN 1 THEN 'HR' WHEN 2 THEN 'Finance' WHEN 3 THEN 'Sales'
            WHEN 4 THEN 'Operations' WHEN 5 THEN 'Marketing' WHEN 6 THEN 'Otros' ELSE NULL END AS department,
       CASE WHEN c_custkey % 3 = 0 THEN concat('AB', lpad({_K}, 6, '0')) WHEN c_custkey % 3 = 1 THEN {_K}
            ELSE NULL END AS employee_id,
       CASE WHEN c_custkey % 4 = 0 THEN 'sin cp' ELSE lpad({_K}, 5, '0') END AS zip_code
FROM customer""",
}

_TABLES = ("customer", "orders", "part")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    sql = VIEWS[name]
    used = [t for t in _TABLES if f"FROM {t}" in sql]
    for t in used:
        sql = sql.replace(f"FROM {t}", "FROM {" + t + "}")
    return spark.sql(sql, **{t: table(spark, sf_dir, t) for t in used})


def sql_with(name: str, body: str) -> str:
    """DuckDB text: the view as a common table expression named ``v``."""
    return f"WITH v AS ({VIEWS[name]})\n{body}"
