"""Registered queries against their SQL counterparts, on the smallest tables."""

import glob
import math
from pathlib import Path

import pytest

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
SAMPLE = [
    "null_profile", "duplicate_rows", "column_profile_dirty_customer", "top_values_documents", "validate_email", "date_formats",
    "domain_rules", "issues_dirty_nulls", "clean_rows", "quarantine_rows", "malformed_rows", "batch_metrics", "streaming_duplicates",
]

pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="driver tables not present")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for f in glob.glob(f"{FOLDER}/*.parquet"):
        con.execute(f"CREATE VIEW {Path(f).stem} AS SELECT * FROM '{f}'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9)
    return v


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() == 4


@pytest.mark.parametrize("name", SAMPLE)
def test_matches_sql(spark, duck, name):
    df = entry.queries()[name](spark, FOLDER)
    found = duck.sql(entry.oracle_sql()[name])
    columns = sorted(df.columns)
    assert columns == sorted(found.columns)
    ours = sorted(([plain(r[c]) for c in columns] for r in df.collect()), key=repr)
    at = [found.columns.index(c) for c in columns]
    theirs = sorted(([plain(r[i]) for i in at] for r in found.fetchall()), key=repr)
    assert ours == theirs
