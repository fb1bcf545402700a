"""The registered queries and, beside each, its DuckDB counterpart.

Every query reads whole tables. The oracle text is written from the meaning of
the operator, not from its Spark plan. ``R6`` rounding removes last-bit
differences of floating point sums.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .views import VIEWS, sql_with, table, view

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

# Columns of the driver tables, as (name, kind) with kind n(umber), t(ext), o(ther).
SCHEMAS = {
    "region": [("r_regionkey", "n"), ("r_name", "t")],
    "nation": [("n_nationkey", "n"), ("n_name", "t"), ("n_regionkey", "n")],
    "customer": [("c_custkey", "n"), ("c_name", "t"), ("c_nationkey", "n"), ("c_acctbal", "n"), ("c_mktsegment", "t")],
    "supplier": [("s_suppkey", "n"), ("s_name", "t"), ("s_nationkey", "n"), ("s_acctbal", "n")],
    "part": [("p_partkey", "n"), ("p_name", "t"), ("p_brand", "t"), ("p_type", "t"), ("p_size", "n"), ("p_retailprice", "n")],
    "orders": [("o_orderkey", "n"), ("o_custkey", "n"), ("o_orderstatus", "t"), ("o_totalprice", "n"),
               ("o_orderdate", "o"), ("o_orderpriority", "t")],
    "lineitem": [("l_orderkey", "n"), ("l_partkey", "n"), ("l_suppkey", "n"), ("l_linenumber", "n"), ("l_quantity", "n"),
                 ("l_extendedprice", "n"), ("l_discount", "n"), ("l_tax", "n"), ("l_returnflag", "t"),
                 ("l_linestatus", "t"), ("l_shipdate", "o")],
    "events": [("event_id", "n"), ("ts", "o"), ("user_id", "n"), ("event_type", "t"), ("value", "n"), ("props", "t")],
    "documents": [("doc_id", "n"), ("text", "t"), ("lang", "t"), ("source", "t"), ("n_chars", "n")],
    "pages": [("page_id", "n"), ("url", "t"), ("html", "t")],
    "benchmark": [("item_id", "n"), ("text", "t")],
    "labels": [("doc_id", "n"), ("quality", "n"), ("toxic", "n")],
    "conversations": [("conv_id", "n"), ("turn", "n"), ("role", "t"), ("text", "t")],
    "dirty_customer": [("id", "n"), ("nombre", "t"), ("email", "t"), ("importe", "t")],
    "dirty_orders": [("id", "n"), ("fecha_inicio", "t"), ("fecha_fin", "t"), ("activo", "t"), ("total", "n")],
    "dirty_contacts": [("id", "n"), ("telefono", "t"), ("website", "t")],
    "dirty_nulls": [("id", "n"), ("n0", "t"), ("n30", "t"), ("n45", "t"), ("n85", "n"), ("n100", "t"), ("n40", "n"), ("n80", "t")],
    "dirty_people": [("id", "n"), ("age", "n"), ("edad", "n"), ("salary", "n"), ("department", "t"),
                     ("employee_id", "t"), ("zip_code", "t")],
}


def query(oracle: str | None = None, name: str | None = None):
    def add(fn: Query) -> Query:
        key = name or fn.__name__
        assert key not in QUERIES, key
        QUERIES[key] = fn
        if oracle is not None:
            ORACLES[key] = oracle
        return fn
    return add


def source(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return view(spark, sf_dir, name) if name in VIEWS else table(spark, sf_dir, name)


def with_source(name: str, body: str) -> str:
    """Oracle text over a view or table, which the body calls ``v``."""
    return sql_with(name, body) if name in VIEWS else f"WITH v AS (SELECT * FROM {name})\n{body}"


def r6(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


def union_columns(name: str, template: str, kinds: str = "nto") -> str:
    """One SELECT per column of a table, with ``{c}`` and ``{i}`` filled in."""
    parts = [
        template.format(c=c, i=i) for i, (c, k) in enumerate(SCHEMAS[name]) if k in kinds
    ]
    return "\nUNION ALL\n".join(parts)


# --- DuckDB pieces ------------------------------------------------------------------
WS = r"\s\p{Z}"


def sql_trim(c: str) -> str:
    return f"regexp_replace({c}, '^[{WS}]+|[{WS}]+$', '', 'g')"


def sql_email(c: str) -> str:
    t = f"lower({sql_trim(c)})"
    return (
        f"(regexp_matches({t}, '^[a-z0-9._%+-]+@[a-z0-9.-]+\\.[a-z]{{2,}}$')"
        f" AND NOT regexp_matches({t}, '\\.\\.|^\\.|\\.@|@\\.'))"
    )


def sql_phone(c: str) -> str:
    return f"regexp_matches(regexp_replace({c}, '[{WS}()+.-]', '', 'g'), '^\\p{{Nd}}{{7,}}$')"


def sql_url(c: str) -> str:
    return f"regexp_matches({sql_trim(c)}, '^https?://[^{WS}/$.?#].[^{WS}]*$')"


def sql_date(c: str) -> str:
    t = sql_trim(c)
    tries = ", ".join(
        f"try_strptime({t}, '{f}')" for f in ("%Y-%m-%d", "%d/%m/%Y", "%m/%d/%Y", "%d-%m-%Y", "%m-%d-%Y", "%Y/%m/%d")
    )
    return f"(regexp_matches({t}, '^[0-9]{{1,4}}[-/][0-9]{{1,2}}[-/][0-9]{{1,4}}$') AND coalesce({tries}) IS NOT NULL)"


def sql_number(c: str) -> str:
    return (
        f"regexp_matches({sql_trim(c)}, "
        f"'^[+-]?([0-9]+(\\.[0-9]*)?|\\.[0-9]+)([eE][+-]?[0-9]+)?$|^[+-]?(?i:inf|infinity|nan)$')"
    )


def sql_value_type(c: str) -> str:
    t = sql_trim(c)
    return (
        f"CASE WHEN {c} IS NULL OR {c} = '' THEN 'Nulo' WHEN regexp_matches({t}, '^-?[0-9]+$') THEN 'Entero' "
        f"WHEN regexp_matches({t}, '^-?[0-9]+\\.?[0-9]*$|^[0-9]*\\.?[0-9]+$') THEN 'Flotante' "
        f"WHEN {sql_email(c)} THEN 'Email' WHEN {sql_phone(c)} THEN 'Teléfono' WHEN {sql_url(c)} THEN 'URL' "
        f"WHEN {sql_date(c)} THEN 'Fecha' ELSE 'Texto' END"
    )


def sql_content(c: str) -> str:
    return (
        f"CASE WHEN {sql_email(c)} THEN 'email' WHEN {sql_phone(c)} THEN 'phone' WHEN {sql_url(c)} THEN 'url' "
        f"WHEN {sql_date(c)} THEN 'date' WHEN {sql_number(c)} THEN 'numeric' ELSE 'other' END"
    )


# Numbers held as text: decoration off, then the decimal point found.
def sql_canonical(c: str) -> str:
    t = sql_trim(c)
    d = f"regexp_replace({t}, '[^0-9,.-]', '', 'g')"
    plain = (
        f"CASE WHEN contains({d}, ',') AND contains({d}, '.') AND regexp_matches({d}, ',[^.]*$') "
        f"THEN replace(replace({d}, '.', ''), ',', '.') "
        f"WHEN contains({d}, ',') AND contains({d}, '.') THEN replace({d}, ',', '') "
        f"WHEN regexp_matches({d}, ',[0-9]{{1,2}}$') THEN replace({d}, ',', '.') ELSE replace({d}, ',', '') END"
    )
    signed = f"CASE WHEN starts_with({t}, '(') AND ends_with({t}, ')') THEN '-' || ({plain}) ELSE ({plain}) END"
    shape = "^\\(?[+-]?(\\$|€|£|¥|[A-Za-z]{3})?[ ]*[0-9][0-9., ]*\\)?$"
    return f"CASE WHEN regexp_matches({t}, '{shape}') THEN {signed} END"


def sql_parse(c: str) -> str:
    """The four layouts found in ``dirty_orders`` plus the ISO end dates."""
    t = sql_trim(c)
    return (
        f"CASE WHEN regexp_matches({t}, '^[0-9]{{4}}-[0-9]{{1,2}}-[0-9]{{1,2}}$') THEN CAST(try_strptime({t}, '%Y-%m-%d') AS DATE) "
        f"WHEN regexp_matches({t}, '^[0-9]{{8}}$') THEN CAST(try_strptime({t}, '%Y%m%d') AS DATE) "
        f"WHEN contains({t}, '/') THEN CAST(coalesce(try_strptime({t}, '%d/%m/%Y'), try_strptime({t}, '%m/%d/%Y')) AS DATE) "
        f"WHEN contains({t}, '.') THEN CAST(coalesce(try_strptime({t}, '%d.%m.%Y'), try_strptime({t}, '%m.%d.%Y')) AS DATE) END"
    )


def sql_format(c: str) -> str:
    t = sql_trim(c)
    return (
        f"CASE WHEN regexp_matches({t}, '^[0-9]{{4}}-[0-9]{{1,2}}-[0-9]{{1,2}}$') AND try_strptime({t}, '%Y-%m-%d') IS NOT NULL THEN '%Y-%m-%d' "
        f"WHEN contains({t}, '/') AND try_strptime({t}, '%d/%m/%Y') IS NOT NULL THEN '%d/%m/%Y' "
        f"WHEN contains({t}, '/') AND try_strptime({t}, '%m/%d/%Y') IS NOT NULL THEN '%m/%d/%Y' "
        f"WHEN contains({t}, '.') AND try_strptime({t}, '%d.%m.%Y') IS NOT NULL THEN '%d.%m.%Y' "
        f"WHEN regexp_matches({t}, '^[0-9]{{8}}$') AND try_strptime({t}, '%Y%m%d') IS NOT NULL THEN '%Y%m%d' END"
    )


def sql_boolean(c: str) -> str:
    w = f"translate(lower({sql_trim(c)}), 'áéíóú', 'aeiou')"
    return (
        f"CASE WHEN {w} IN ('true', '1', 'yes', 'si', 'verdadero', 'y', 't') THEN true "
        f"WHEN {w} IN ('false', '0', 'no', 'falso', 'n', 'f') THEN false END"
    )


BIG = "CAST({} AS BIGINT)"


def big(expr: str) -> str:
    return f"CAST({expr} AS BIGINT)"
