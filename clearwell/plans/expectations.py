"""What the user expects of a table, checked against its metrics.

The configuration names, per column, ``nullable``, ``unique`` and
``validations``, and for the table ``min_rows``, ``max_null_percent`` and the
``*_valid`` switches.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..columns import col
from .findings import Metrics, _rows

_SWITCHES = {"email_valid": "email", "phone_valid": "phone", "date_valid": "date", "url_valid": "url"}


def _rule(scope, column, expectation, expected, observed, passed):
    return {
        "scope": F.lit(scope), "column_name": column, "expectation": F.lit(expectation),
        "expected": F.lit(str(expected)), "observed": observed.cast("double"), "passed": passed,
    }


def check_expectations(m: Metrics, config: dict) -> DataFrame:
    """``scope, column_name, expectation, expected, observed, passed``."""
    by = list(m.by)
    c = F.col
    name = c("column_name")
    per_column, per_content, per_table = [], [], []
    for column, want in (config.get("columns") or {}).items():
        here = name == column
        if want.get("nullable") is False:
            per_column.append((here, _rule("column", name, "nullable", False, c("null_count"), c("null_count") == 0)))
        if want.get("unique") is True:
            per_column.append((here, _rule("column", name, "unique", True, c("unique_count"),
                                           c("unique_count") == c("non_null"))))
        for validation in want.get("validations") or []:
            if validation in _SWITCHES.values():
                per_content.append((here & (c("validator") == validation), _rule(
                    "column", name, f"valid_{validation}", True, c("invalid_count"), c("invalid_count") == 0)))
            elif validation == "numeric":
                per_column.append((here, _rule("column", name, "valid_numeric", True, c("non_null"),
                                               c("mean").isNotNull() | (c("non_null") == 0))))
    table = config.get("validation_rules") or {}
    none = F.lit(None).cast("string")
    if "min_rows" in table:
        per_table.append((F.lit(True), _rule("table", none, "min_rows", table["min_rows"], c("rows"),
                                             c("rows") >= table["min_rows"])))
    if "max_null_percent" in table:
        per_table.append((F.lit(True), _rule("table", none, "max_null_percent", table["max_null_percent"],
                                             c("null_percent"), c("null_percent") <= table["max_null_percent"])))
    for switch, validator in _SWITCHES.items():
        if table.get(switch):
            per_content.append((c("validator") == validator, _rule(
                "table", name, switch, True, c("invalid_count"), c("invalid_count") == 0)))
    parts = [
        _rows(source, by, options)
        for source, options in ((m.columns, per_column), (m.contents, per_content), (m.table, per_table))
        if options
    ]
    if not parts:
        raise ValueError("the configuration holds no expectation")
    return reduce(DataFrame.unionByName, parts)


def default_expectations(m: Metrics) -> DataFrame:
    """Per column the expectations its data meets today: a starting configuration."""
    return m.columns.select(
        *[col(b) for b in m.by], "column_name",
        (F.col("null_count") > 0).alias("nullable"),
        ((F.col("unique_count") == F.col("non_null")) & (F.col("non_null") > 0)).alias("unique"),
    )


def as_config(expectations: DataFrame) -> dict:
    """The rows of :func:`default_expectations`, one for each column, as the configuration of :func:`check_expectations`."""
    return {"columns": {r["column_name"]: {"nullable": r["nullable"], "unique": r["unique"]} for r in expectations.collect()}}
