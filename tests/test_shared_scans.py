"""The shared passes give what the single operators give, and read the table three times."""

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from clearwell.operators import duplicates as D
from clearwell.operators import frequency as Q
from clearwell.operators import profile as P
from clearwell.operators import validation as V
from clearwell.plans import analysis as A
from clearwell.plans.shared import shared_scans

SCHEMA = "src string, id bigint, email string, `a``b` string, edad int, x double, y float, d date, t timestamp, dec decimal(10,2), ok boolean, arr array<int>, fecha string, empty string"


def _rows():
    rows = []
    for i in range(120):
        rows.append((
            ["a", "b", None][i % 3], i % 70, f"u{i % 9}@x.com" if i % 4 else "bad", [None, " ", "x" * 200, "<b>", "12", "1.5"][i % 6], i % 11 - 2,
            [0.0, -0.0, float("nan"), None, 2.5][i % 5], [1.5, None, float("nan")][i % 3], dt.date(2024, 1, 1 + i % 20) if i % 7 else None,
            dt.datetime(2024, 1, 1, i % 24), Decimal(i % 5), [True, False, None][i % 3], [i % 2], ["03/04/2024", "2024-01-20", "no"][i % 3], None,
        ))
    return rows + rows[:9]


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(_rows(), SCHEMA)


def _same(left, right):
    assert left.columns == right.columns
    norm = lambda r: tuple(round(v, 9) if isinstance(v, float) else v for v in r)
    assert sorted(map(norm, left.collect()), key=str) == sorted(map(norm, right.collect()), key=str)


@pytest.mark.parametrize("by", [(), ("src",)])
def test_shared_metrics_equal_the_single_operators(table, by):
    m = A.collect_metrics(table, by)
    _same(m.columns, P.column_profile(table, by=by))
    _same(m.types, Q.mixed_types(Q.type_counts(table, by=by), by))
    _same(m.contents, V.validate_contents(table, by=by))
    _same(m.numeric, V.validate_numeric(table, by=by))
    _same(m.text, V.validate_text(table, by=by))
    _same(m.unsafe, V.unsafe_chars(table, by=by))
    double = D.duplicate_rows(table, by=by)
    _same(m.table.select(*double.columns), double)
    complete = P.row_completeness(table, by=by)
    _same(m.table.select(*complete.columns), complete)


def test_issue_metrics_are_the_same_without_what_issues_do_not_need(table):
    full, few = A.collect_metrics(table), A.issue_metrics(table)
    _same(few.table, full.table)
    _same(few.types, full.types)
    _same(few.columns.drop("unique_count", "median", "cardinality_ratio"), full.columns.drop("unique_count", "median", "cardinality_ratio"))
    assert few.numeric is None


def test_approximate_metrics_need_no_medians(table):
    scans = shared_scans(table, approx=True)
    assert scans.medians is None
    got = {r["column_name"]: r for r in scans.metrics().columns.collect()}
    want = {r["column_name"]: r for r in P.column_profile(table).collect()}
    for name, row in want.items():
        assert got[name]["is_approximate"] and abs(got[name]["unique_count"] - row["unique_count"]) <= 1
    assert scans.metrics().table.first()["duplicate_rows"] == D.duplicate_rows(table).first()["duplicate_rows"]


def _scans(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.count("FileScan")


def test_an_analysis_reads_its_table_three_times(spark, table, tmp_path):
    path = str(tmp_path / "t")
    table.write.parquet(path)
    scans = shared_scans(spark.read.parquet(path), approx=True)
    assert [_scans(x) for x in (scans.wide, scans.classified, scans.grouped)] == [1, 1, 1]
    ran = []
    settled = scans.settled(lambda df: ran.append(df) or spark.createDataFrame(df.collect(), df.schema))
    assert len(ran) == 3
    m = settled.metrics()
    a = A.analysis_of(m)
    for df in (m.table, m.columns, m.types, m.contents, m.numeric, m.text, m.unsafe, a.issues, a.recommendations, a.filters, a.summary):
        assert _scans(df) == 0


def test_an_empty_table_and_one_without_text(spark, table):
    empty = table.limit(0)
    m = A.collect_metrics(empty)
    assert m.table.first()["rows"] == 0 and m.columns.count() == len(table.columns) and m.types.count() == 0
    assert A.collect_metrics(empty, "src").table.count() == 0
    numbers = A.analyze(spark.range(5).selectExpr("id", "id % 2 AS g"))
    assert numbers.metrics.table.first()["duplicate_rows"] == 0 and numbers.metrics.contents.count() == 0
    with pytest.raises(ValueError):
        shared_scans(spark.range(3), by="id")


# --- many sources ---------------------------------------------------------------------
def test_many_sources_with_a_broken_file_in_the_middle(spark, table, tmp_path):
    paths = {}
    for i in range(5):
        paths[i] = tmp_path / f"p{i}"
        table.where(F.col("id") % 5 == i).coalesce(1).write.parquet(str(paths[i]))
    broken = next(paths[2].glob("*.parquet"))
    data = broken.read_bytes()
    sources = {("s" + str(i) if i != 3 else None): spark.read.schema(table.schema).parquet(str(p)) for i, p in paths.items()}
    broken.write_bytes(data[:200] + bytes(len(data) - 200))
    broken.with_name(f".{broken.name}.crc").unlink(missing_ok=True)
    sources |= {"other": spark.range(4).toDF("n"), "none": table.limit(0), "bad": lambda _: 1 / 0, "taken": spark.range(2).toDF("source_name")}
    found = A.analyze_many(spark, sources)
    summary = {r["source_name"]: r for r in found.summary.collect()}
    assert set(summary) == {"s0", "s1", "s2", None, "s4", "other", "none", "bad", "taken"}
    assert {n for n, r in summary.items() if r["status"] == "error"} == {"s2", "bad", "taken"}
    assert summary["bad"]["error"] == "division by zero" and summary["none"]["rows"] == 0 and summary["other"]["rows"] == 4
    m = found.analysis.metrics
    for name, i in (("s0", 0), (None, 3), ("s4", 4)):
        own = spark.read.parquet(str(paths[i]))
        here = F.col("source_name").eqNullSafe(F.lit(name))
        one = A.collect_metrics(own)
        for part in ("table", "columns", "types", "contents", "numeric", "text", "unsafe"):
            want = getattr(one, part)
            _same(getattr(m, part).where(here).select(want.columns), want)
        assert found.analysis.issues.where(here).count() == A.analyze(own).issues.count()


def test_many_sources_all_broken(spark):
    found = A.analyze_many(spark, {"x": lambda _: 1 / 0})
    assert found.analysis is None and found.summary.first()["status"] == "error"
    with pytest.raises(ValueError):
        A.analyze_many(spark, {})


def test_wide_tables_take_a_wide_scan_for_each_group_of_columns(spark, tmp_path):
    df = spark.range(40).select(*[F.when(F.col("id") % (i + 2) != 0, F.col("id")).alias(f"c{i}") for i in range(70)])
    path = str(tmp_path / "wide")
    df.write.parquet(path)
    read = spark.read.parquet(path)
    scans = shared_scans(read, approx=True)
    leaves = scans.wide._jdf.queryExecution().sparkPlan().collectLeaves()
    widths = [leaves.apply(i).output().size() for i in range(leaves.size())]
    assert widths == [70, 10]
    m = scans.metrics()
    _same(m.table.drop("duplicate_rows", "duplicate_percent"), P.row_completeness(read))
    assert m.columns.count() == 70 and m.unsafe.count() == 70


# --- texts are looked at once a distinct value ------------------------------------------
def test_settled_passes_classify_without_a_scan_of_their_own(spark, table, tmp_path):
    path = str(tmp_path / "t")
    table.write.parquet(path)
    ran = []
    shared_scans(spark.read.parquet(path)).settled(lambda df: ran.append(_scans(df)) or spark.createDataFrame(df.collect(), df.schema))
    assert sorted(ran) == [0, 1, 1]


@pytest.mark.parametrize("by", [(), ("g",)])
def test_contents_summed_from_groups_equal_those_of_the_scan(spark, by):
    rows = [(
        "ab"[i % 2], dt.date(2024, 1, 1 + i % 3) if i % 5 else None, dt.datetime(2024, 1, 1, i % 24, 0, i % 2), 20240100 + i % 40 if i % 4 else None, 5551230 + i % 3,
        [f"u{i % 3}@{'x' * 70}.com", "ab@c.de", " " + "y " * 40, "03/04/2024", "31-12-2023", "", "<%>", "2024-01-20" + " " * 70, None, "ñ" * 250][i % 10], [" sha256:1", None, "x.y"][i % 3],
        Decimal(i % 3) if i % 2 else None, f"{i % 2 or ''} ",
    ) for i in range(97)]
    df = spark.createDataFrame(rows, "g string, fecha_alta date, hora timestamp, fecha_n int, telefono bigint, email string, web string, date_dec decimal(10,0), `a``b` string")
    for full in (True, False):
        lazy = shared_scans(df, by, full=full)
        settled = lazy.settled()
        _same(settled.classified.select(lazy.classified.columns), lazy.classified)
        _same(settled.contents(), V.validate_contents(df, by=by))
        _same(settled.types(), Q.mixed_types(Q.type_counts(df, by=by), by))
        assert settled.table().agg(F.sum("duplicate_rows")).first() == D.duplicate_rows(df, by=by).agg(F.sum("duplicate_rows")).first()
    _same(A.collect_metrics(df, by).text, V.validate_text(df, by=by))
