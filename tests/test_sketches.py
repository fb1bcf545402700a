"""Sketches of values: bounds, merging, exact counts of few values."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from clearwell.operators import frequency as Q
from clearwell.operators import sketches as S

LONG = "x" * 100


@pytest.fixture(scope="module")
def skewed(spark):
    rng = random.Random(4)
    values = [int(rng.paretovariate(0.8)) for _ in range(20000)]
    rows = [(v, [None, "a", "b", LONG, f"u{i}"][min(4, int(rng.random() * 7))], rng.choice(["s", None])) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "v int, t string, g string").repartition(4)


def _counts(df, column):
    return Counter(r[0] for r in df.select(F.col(column).cast("string")).collect() if r[0] is not None)


@pytest.mark.parametrize("tracked", [48, 1000])
def test_counts_lie_within_their_bounds(skewed, tracked):
    states = S.value_sketches(skewed, ["v", "t"], tracked=tracked)
    found = S.frequent_values(states, k=40, tracked=tracked).collect()
    slack = 3.5 / S.slots(tracked) * 20000
    for column in ("v", "t"):
        true = _counts(skewed, column)
        mine = {r["value_key"]: r for r in found if r["column_name"] == column}
        for key, r in mine.items():
            n = true[LONG] if key.startswith("sha256:") else true[key]
            assert r["cnt_low"] <= n <= r["cnt"], (column, key)
        heavy = [k for k, n in true.most_common(40) if n > 2 * slack]
        assert all(k in mine or k == LONG for k in heavy)
    ranks = [r["rank"] for r in found if r["column_name"] == "v"]
    assert sorted(ranks) == list(range(1, len(ranks) + 1))


def test_parts_merge_to_the_whole(skewed):
    parts = [S.value_sketches(skewed.where(F.col("v") % 3 == i), ["v", "t"]) for i in range(3)]
    merged = S.merge_sketches(parts[0].union(parts[1]).union(parts[2]))
    whole = S.value_sketches(skewed, ["v", "t"])
    read = lambda s: sorted(tuple(r) for r in S.frequent_values(s, 5).select("column_name", "rank", "cnt").collect())
    assert read(merged) == read(whole)
    sums = lambda s: sorted((r["column_name"], r["rows"], r["non_null"]) for r in s.collect())
    assert sums(merged) == sums(whole)


def test_few_values_are_counted_exactly_by_group(skewed):
    got = S.approx_top_values(skewed, 3, ["t"], by="g").collect()
    want = Q.top_values(skewed, 3, ["t"], by="g").collect()
    key = lambda r: (str(r["g"]), r["column_name"], r["rank"])
    assert [(*key(r), r["value"], r["cnt"]) for r in sorted(got, key=key)] == [(*key(r), r["value"], r["cnt"]) for r in sorted(want, key=key)]
    assert any(r["value"] == LONG for r in got) and all(r["cnt_low"] <= r["cnt"] for r in got)


def test_duplicates_lie_within_their_error(spark, skewed):
    got = {r["column_name"]: r for r in S.approx_duplicates(S.value_sketches(skewed)).collect()}
    for r in Q.duplicates_per_column(skewed).collect():
        mine = got[r["column_name"]]
        assert abs(mine["duplicate_values"] - r["duplicate_values"]) <= mine["max_error"]
    empty = S.value_sketches(spark.createDataFrame([], "a int, b string"))
    assert S.frequent_values(empty).count() == 0 and {r["duplicate_values"] for r in S.approx_duplicates(empty).collect()} == {0}


@pytest.mark.parametrize("by", [(), "g"])
@pytest.mark.parametrize("tracked", [12, 48, 1000])
def test_settled_counts_are_exact_whatever_is_tracked(skewed, tracked, by):
    # u: more values than are tracked, none frequent, ties everywhere. v: skewed. t: few frequent values, a long one among them.
    df = skewed.withColumn("u", F.pmod(F.xxhash64("v", "t", "g"), F.lit(700)))
    key = lambda r: (str(by and r["g"]), r["column_name"], r["rank"], r["value"], r["cnt"])
    want = sorted(map(key, Q.top_values(df, 3, ["u", "v", "t"], by=by).collect()))
    assert sorted(map(key, S.approx_top_values(df, 3, ["u", "v", "t"], by=by, tracked=tracked, exact=True).collect())) == want
    parts = [S.value_sketches(df.where(F.col("v") % 2 == i), ["u", "v", "t"], by, tracked) for i in range(2)]
    assert sorted(map(key, S.settled_values(df, S.merge_sketches(parts[0].union(parts[1]), by, tracked), 3, by, tracked).collect())) == want


def test_merged_sketches_of_more_values_than_are_tracked(spark, tmp_path):
    from workload import profile_queries
    ids = spark.range(40000).select(F.col("id").alias("event_id"), F.lit("view").alias("event_type"), F.pmod("id", F.lit(18000)).alias("user_id"))
    ids.write.parquet(str(tmp_path / "events.parquet"))
    got = [tuple(r) for r in profile_queries.merged_sketches(spark, str(tmp_path)).orderBy("column_name", "rank").collect()]
    assert got == [("event_type", 1, "view", 40000), ("user_id", 1, "0", 3), ("user_id", 2, "1", 3), ("user_id", 3, "10", 3)]
