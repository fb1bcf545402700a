import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from clearwell.operators import duplicates as D
from clearwell.operators import frequency as Q
from clearwell.operators import profile as P
from clearwell.operators import quantiles
from clearwell.operators.quantiles import exact_median
from conftest import by_name


def test_nulls(spark):
    df = spark.createDataFrame([(1.0, "a", None), (None, "b", 2.0), (float("nan"), "c", 3.0)], "a double, b string, c double")
    got = by_name(P.null_profile(df))
    assert got["a"]["null_count"] == 2 and got["a"]["null_percent"] == pytest.approx(200 / 3)
    assert got["a"]["status"] == "GRAVE" and got["a"]["utilization_status"] == "CRÍTICO"
    assert got["b"]["status"] == "OK" and got["b"]["utilization_status"] == "ACEPTABLE"
    table = P.row_completeness(df).first()
    assert (table["null_cells"], table["complete_rows"], table["cells"]) == (3, 0, 9)


def test_blanks_ignore_nulls(spark):
    df = spark.createDataFrame([("  ",), ("\t\n",), (None,), ("x",)], "a string")
    assert P.blank_strings(df).first()["blank_count"] == 2


def test_empty_table(spark):
    df = spark.createDataFrame([], "a int, b string")
    got = by_name(P.column_profile(df))
    assert got["a"]["rows"] == 0 and got["a"]["null_percent"] == 0 and got["a"]["cardinality_ratio"] == 0
    assert got["a"]["unique_count"] == 0 and got["a"]["median"] is None
    assert D.duplicate_rows(df).first()["duplicate_percent"] == 0
    assert P.row_completeness(df).first()["complete_percent"] == 0


def test_distinct_and_cardinality(spark):
    df = spark.createDataFrame([(v,) for v in (1, 2, 2, 3, 3, 3)], "col bigint")
    row = P.column_profile(df).first()
    assert row["unique_count"] == 3 and row["cardinality_ratio"] == 0.5
    with_null = spark.createDataFrame([(1.0,), (float("nan"),), (None,), (-0.0,), (0.0,)], "x double")
    row = P.column_profile(with_null).first()
    assert row["unique_count"] == 2 and row["cardinality_ratio"] == pytest.approx(3 / 5)


@pytest.mark.parametrize("values", [
    [5.0], [1.0, 2.0], [3.0, 3.0, 3.0], [0.0, -1.5, 1e300, -1e300, 1e-300], [float("inf"), 1.0, float("-inf")],
    [i / 7 for i in range(1000)], [0.1] * 500 + [0.2] * 500,
])
def test_median(spark, values):
    rows = [(v,) for v in random.Random(1).sample(values, len(values))]
    got = exact_median(spark.createDataFrame(rows, "v double")).first()["median"]
    assert got == pytest.approx(statistics.median(values))


def test_median_random_and_grouped(spark):
    rng = random.Random(7)
    rows = [(rng.choice("ab"), rng.lognormvariate(0, 5) * rng.choice((1, -1)), rng.randrange(10)) for _ in range(2001)]
    df = spark.createDataFrame(rows, "g string, x double, n int").repartition(7)
    got = {(r["g"], r["column_name"]): r["median"] for r in exact_median(df, by="g").collect()}
    for g in "ab":
        assert got[g, "x"] == pytest.approx(statistics.median(r[1] for r in rows if r[0] == g))
        assert got[g, "n"] == statistics.median(r[2] for r in rows if r[0] == g)


def test_top_values_and_long_texts(spark):
    long = "z" * 500
    df = spark.createDataFrame([(long,)] * 3 + [("a",)] * 2 + [("b",)] * 2 + [(None,)] * 9, "t string")
    got = [(r["rank"], r["value"], r["cnt"]) for r in Q.top_values(df).orderBy("rank").collect()]
    assert got == [(1, long, 3), (2, "a", 2), (3, "b", 2)]


def test_mixed_types(spark):
    df = spark.createDataFrame([("1",), ("2",), ("3.0",), (None,), ("five",)], "mixed string")
    row = Q.mixed_types(Q.type_counts(df)).first()
    assert row["types"] == 3 and row["is_problematic"] and row["detected_types"] == "Entero=2, Flotante=1, Texto=1"


def test_type_counts_of_the_first_values(spark):
    df = spark.createDataFrame([(i, "1") for i in range(5)] + [(9, "x"), (10, "y")], "i int, v string")
    got = by_name(Q.type_counts(df, "v", max_distinct=2, row_key="i"), "value_type")
    assert got["Entero"]["distinct_values"] == 1 and got["Texto"]["distinct_values"] == 1


def test_duplicates(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (1, "a"), (3, None), (3, None)], "a bigint, b string")
    row = D.duplicate_rows(df).first()
    assert row["duplicate_rows"] == 2 and row["duplicate_percent"] == 40
    got = by_name(Q.duplicates_per_column(df))
    assert got["a"]["duplicate_values"] == 2 and got["b"]["duplicate_values"] == 2
    unique = spark.createDataFrame([(1, None)], "a int, b int")
    assert Q.duplicates_per_column(unique).count() == 0


def test_duplicate_rows_with_awkward_types(spark):
    df = spark.sql("""SELECT * FROM VALUES (map('a', 1), array(1, 2), double('NaN'), binary('x')),
                      (map('a', 1), array(1, 2), double('NaN'), binary('x')) AS t(m, a, d, b)""")
    assert D.duplicate_rows(df).first()["duplicate_rows"] == 1


def test_duplicate_examples_are_the_first(spark):
    rows = [(i, "hot") for i in range(100, 130)] + [(1, "x"), (50, "x"), (2, "y"), (3, "z"), (4, "z")]
    got = D.duplicate_examples(spark.createDataFrame(rows, "k int, v string"), "k", ["v"]).collect()
    assert [r["k"] for r in got] == [1, 3, 4, 50, 100]


def test_hot_group_is_kept_first(spark):
    df = spark.range(0, 30000).selectExpr("id", "if(id % 3 = 0, 'hot', cast(id as string)) AS v")
    kept = D.keep_first(df, "id")
    assert kept.count() == 20001 and kept.where("v = 'hot'").first()["id"] == 0
    by_v = D.keep_first(df.withColumn("w", F.col("id") + 1), "id", "v")
    assert by_v.columns == ["id", "v", "w"] and by_v.where("v = 'hot'").first()["w"] == 1
    assert D.keep_min_id(df, "id").count() == 20001


def test_duplicate_columns(spark):
    df = spark.createDataFrame([(1, 1, 2, 1.0), (2, 2, 1, 2.0), (None, None, 5, 3.0)], "a bigint, b bigint, c bigint, d double")
    assert [tuple(r) for r in D.duplicate_columns(df).collect()] == [("a", "b")]
    # Equal as a set, not row by row.
    swapped = spark.createDataFrame([(1, 2), (2, 1)], "a int, b int")
    assert D.duplicate_columns(swapped).count() == 0


def test_wide_table(spark):
    df = spark.range(50).select(*[(F.col("id") * i).alias(f"c{i}") for i in range(150)])
    got = by_name(P.null_profile(df))
    assert len(got) == 150 and {r["rows"] for r in got.values()} == {50} and got["c149"]["position"] == 149


def test_awkward_names(spark):
    df = spark.createDataFrame([("x", 1), (None, 2)], "`customer's name` string, `a.b c` int")
    got = by_name(P.column_profile(df))
    assert got["customer's name"]["null_count"] == 1 and got["a.b c"]["median"] == 1.5
    assert D.duplicate_rows(df).first()["duplicate_rows"] == 0


def test_partitioning_does_not_matter(spark):
    df = spark.range(1000).selectExpr("id % 7 AS a", "cast(id % 13 AS string) AS b", "id / 3 AS c")
    one = [r.asDict() for r in P.column_profile(df.repartition(1)).orderBy("position").collect()]
    many = [r.asDict() for r in P.column_profile(df.repartition(11)).orderBy("position").collect()]
    for a, b in zip(one, many):
        for k in a:
            assert a[k] == b[k] or math.isclose(a[k], b[k])


def test_approximate_profile_is_close(spark):
    df = spark.range(20000).selectExpr("id AS a", "cast(id % 100 AS string) AS b")
    got = by_name(P.column_profile(df, approx=True))
    assert abs(got["a"]["unique_count"] - 20000) < 1000 and got["b"]["unique_count"] in range(95, 106)
    assert abs(got["a"]["median"] - 10000) < 400 and got["a"]["is_approximate"]


def test_medians_do_not_shuffle_the_rows(spark):
    df = spark.range(5000).selectExpr("cast(id AS double) AS x", "100000 + id * 1e-9 AS crowded", "CASE WHEN id = 0 THEN 1e300 ELSE id * 1e-300 END AS wide")
    seen = []
    real = quantiles.settle
    quantiles.settle = lambda step: seen.append(step) or real(step)
    try:
        got = {r["column_name"]: r["median"] for r in exact_median(df, buckets=16).collect()}
    finally:
        quantiles.settle = real
    for name in ("x", "crowded", "wide"):
        assert got[name] == statistics.median(r[0] for r in df.select(name).collect())
    assert len(seen) < 40
    for step in seen:  # what each step keeps: two ranks for each column
        assert step.count() <= 6 and "SinglePartition" not in step._jdf.queryExecution().executedPlan().toString()


def test_top_values_order_by_the_values_themselves(spark):
    rows = ["c" * 70, "a" * 70, "b" * 70, "é" * 40, "a" * 60 + "z", "short"]
    df = spark.createDataFrame([(v,) for v in rows], "v string")
    got = [r["value"] for r in Q.top_values(df, 4).orderBy("rank").collect()]
    assert got == sorted(rows, key=lambda v: v.encode())[:4]
    assert {r["value"] for r in Q.value_frequencies(df).collect()} == set(rows)
    both = df.withColumn("g", F.when(F.col("v") < "b", None).otherwise("x"))
    got = [(r["g"], r["value"]) for r in Q.top_values(both, 1, by="g").orderBy("g").collect()]
    assert got == [(None, "a" * 70), ("x", "b" * 70)]


def test_top_values_among_many_ties(spark):
    """Thousands of texts of one count and one prefix: the lowest are found, and tasks rank k rows of them at most."""
    from collections import Counter

    long = "p" * 70
    rows = [(f"{long}{i:06d}", f"u{i}", "g" if i % 2 else None) for i in range(4000)]
    rows += [(long, "u1", "g"), (long[:60], "u2", None), ("é" * 40, "u3", "g"), ("a" * 200, "x", "g"), ("a" * 200, "x", "g"), (None, None, "g")]
    df = spark.createDataFrame(rows, "t string, u string, s string").repartition(8)
    for by in ((), ("s",)):
        got = Q.top_values(df, 4, ["t", "u"], by=by).collect()
        for c, place in (("t", 0), ("u", 1)):
            for group in ([None, "g"] if by else ["all"]):
                values = Counter(r[place] for r in rows if r[place] is not None and (not by or r[2] == group))
                want = sorted(values.items(), key=lambda x: (-x[1], x[0]))[:4]
                mine = sorted((r["rank"], r["value"], r["cnt"]) for r in got if r["column_name"] == c and (not by or r["s"] == group))
                assert mine == [(i + 1, *w) for i, w in enumerate(want)]
    plan = Q.top_values(df, 4)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") >= 4  # before and after the exchange, of classes and of tied texts
