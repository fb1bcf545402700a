import pytest
from pyspark.sql import functions as F

from clearwell.operators import filters as L
from clearwell.operators import profile as P
from clearwell.operators import validation as V
from clearwell.plans import analysis as A
from clearwell.plans import findings as N
from clearwell.plans.expectations import check_expectations, default_expectations
from clearwell.plans.report import report_tables
from clearwell.sources.sinks import write_report


@pytest.fixture(scope="module")
def table(spark):
    rows = [(i, None if i % 5 else "v", "  " if i % 2 else "x", f"u{i}@x.com" if i % 2 else "bad", -1 if i == 3 else i, "03/04/2024" if i % 2 else "2024-01-20")
            for i in range(18)]
    rows += rows[:2]
    return spark.createDataFrame(rows, "id int, casi string, blanco string, email string, edad int, fecha string")


@pytest.fixture(scope="module")
def analysis(table):
    return A.analyze(table)


def test_issues(analysis):
    got = {(r["type"], r["column_name"]): (r["level"], r["score"]) for r in analysis.issues.collect()}
    assert got["NULOS_GRAVES", "casi"] == ("severe", 7)
    assert got["CADENAS_VACÍAS", "blanco"] == ("severe", 5)
    assert got["DUPLICADOS", "FILAS_COMPLETAS"] == ("severe", 6)
    assert got["EMAILS_INVÁLIDOS", "email"] == ("severe", 5)
    assert got["FECHAS_INVÁLIDAS", "fecha"] == ("warnings", 2)
    assert sum(analysis.severity.first()) == len(got)


def test_thresholds(spark):
    for nulls, kind in ((8, "NULOS_CRÍTICOS"), (4, "NULOS_GRAVES"), (3, None)):
        df = spark.createDataFrame([(i, None if i < nulls else 1) for i in range(10)], "i int, v int")
        found = [r["type"] for r in N.issues(A.issue_metrics(df)).collect()]
        assert found == ([kind] if kind else [])


def test_recommendations(analysis):
    got = {(r["category"], r["action"], r["column_name"]) for r in analysis.recommendations.collect()}
    assert ("cleaning", "REVIEW_COLUMN", "casi") in got and ("cleaning", "REMOVE_DUPLICATES", "FILAS_COMPLETAS") in got
    assert ("database_rules", "CHECK (NO NEGATIVOS)", "edad") in got and ("database_rules", "NOT NULL", "id") in got
    assert ("normalization", "DATE_STANDARDIZATION", "fecha") in got and ("normalization", "LOWERCASE", "email") in got
    summary = N.recommendation_summary(analysis.recommendations).first()
    assert summary["total_recommendations"] == len(got)


def test_filters_can_be_applied(analysis, table):
    rows = analysis.filters.collect()
    for r in rows:
        if r["category"] in ("null_filters", "cleanup_filters", "validation_filters"):
            assert table.where(r["filter_sql"]).count() < table.count()
    table.withColumn("rownum", F.lit(1)).createOrReplaceTempView("tabla")
    for r in rows:
        if r["filter_sql"].startswith("SELECT"):
            analysis.issues.sparkSession.sql(r["filter_sql"]).count()
    top = N.top_suggestions(analysis.filters).collect()
    assert len({r["category"] for r in top}) == len(top)


def test_grouped_metrics_match_single_ones(spark, table):
    both = table.withColumn("source_name", F.lit("a")).union(table.where("id > 3").withColumn("source_name", F.lit("b")))
    got = {r["source_name"]: r for r in A.summarize_grouped(both).collect()}
    for name, df in (("a", table), ("b", table.where("id > 3"))):
        one = A.batch_row(df, name).first()
        for c in ("rows", "columns", "total_null_cells", "duplicate_rows", "critical_issues", "severe_issues", "warning_issues"):
            assert got[name][c] == one[c], (name, c)


def test_batch_isolates_failures(spark, table):
    def broken(_):
        raise RuntimeError("no such file")

    summary = A.summarize_batch(spark, {"good": table, "bad": broken})
    got = {r["source_name"]: r for r in summary.collect()}
    assert got["bad"]["status"] == "error" and got["bad"]["error"] == "no such file" and got["good"]["rows"] == 20
    assert A.batch_metrics(summary).first()["total_rows"] == 20


def test_expectations(analysis):
    config = {
        "columns": {"id": {"nullable": False, "unique": True}, "casi": {"nullable": False}, "email": {"validations": ["email"]}},
        "validation_rules": {"min_rows": 10, "max_null_percent": 30, "date_valid": True},
    }
    got = {(r["column_name"], r["expectation"]): r["passed"] for r in check_expectations(analysis.metrics, config).collect()}
    assert got == {("id", "nullable"): True, ("id", "unique"): False, ("casi", "nullable"): False, ("email", "valid_email"): False,
                   (None, "min_rows"): True, (None, "max_null_percent"): True, ("fecha", "date_valid"): True}
    with pytest.raises(ValueError):
        check_expectations(analysis.metrics, {})
    assert default_expectations(analysis.metrics).count() == 6


def test_report(spark, analysis, tmp_path):
    tables = report_tables(analysis)
    for run in ("r1", "r2", "r1"):
        write_report({"nulls": tables["nulls"]}, str(tmp_path), run)
    saved = spark.read.parquet(str(tmp_path / "nulls"))
    assert saved.count() == 2 * tables["nulls"].count()
    clean = report_tables(A.analyze(spark.range(3).toDF("n"), settled=False))
    assert clean["nulls"].first()["status"] == "Sin incidencias detectadas"


def test_suggested_predicates_keep_what_the_transforms_keep(spark):
    rows = [("a@b.co", "+34 600 123 456", "x"), ("bad@", "abc1234567", " "), (" A@B.CO\t", "9" * 20_000, "<b>"), ("a..b@c.de", None, "\u00a0"), (None, "12", None)] * 2
    df = spark.createDataFrame(rows, "email string, telefono string, `a``b` string")
    filters = {(r["type"], r["column_name"]): r["filter_sql"] for r in A.analyze(df).filters.collect()}
    kept = lambda kind, column: sorted(map(tuple, df.where(filters[kind, column]).collect()), key=str)
    same = lambda out: sorted(map(tuple, out.collect()), key=str)
    assert kept("EMAIL_VALIDATION", "email") == same(L.keep_valid_emails(df, "email"))
    assert kept("PHONE_VALIDATION", "telefono") == same(L.keep_valid_phones(df, "telefono"))
    assert kept("WHITESPACE_CLEANUP", "a`b") == same(L.drop_blanks(df, "a`b"))
    assert kept("SPECIAL_CHARS_CLEANUP", "a`b") == same(L.drop_unsafe_chars(df, "a`b"))
    assert kept("NULL_ELIMINATION", "a`b") == same(L.drop_nulls(df, "a`b"))
    df.createOrReplaceTempView("tabla")
    first = spark.sql(filters["REMOVE_DUPLICATES_ADVANCED", None]).drop("rn")
    assert same(first) == same(df.distinct())


def test_grouped_analysis_without_numbers_and_with_a_null_source(spark):
    df = spark.createDataFrame([("s", "a", None), (None, "b", " "), (None, "b", "x"), ("t", "c", "d")], "source_name string, v string, w string")
    a = A.analyze(df, by="source_name")
    tables = report_tables(a)
    summary = {r["source_name"]: (r["critical"], r["severe"], r["warnings"]) for r in tables["summary"].collect()}
    assert set(summary) == {"s", "t", None} and None not in {x for v in summary.values() for x in v}
    assert summary["t"] == (0, 0, 0) and sum(summary[None]) > 0
    nothing = {r["source_name"] for r in tables["issues"].where("detail = 'Sin incidencias detectadas'").collect()}
    assert "t" in nothing and None not in nothing
    assert P.blank_strings(spark.range(3).selectExpr("id", "id % 2 AS g"), by="g").columns[0] == "g"
    assert V.validate_numeric(df, by="source_name").columns[0] == "source_name"
