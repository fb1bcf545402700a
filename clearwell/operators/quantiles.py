"""Exact medians without sorting or shuffling the data.

Built-in exact percentiles keep every distinct value of a column in one buffer.
Here the middle ranks are narrowed down instead: count values in buckets, keep
the bucket that holds the rank, split it again, and go on until one value is
left. Each step is an aggregation whose shuffle holds bucket counts only, at
most ``BUCKETS`` for each group and rank, however the values crowd together.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..columns import as_list, col, long_form, present, profiled_fields, quoted
from ..runtime import settle

BUCKETS = 1 << 14
MOST_BROADCAST = 100_000
# ln(1 + largest double) is just below 710: the coarse buckets cover any double.
_LOG_LIMIT = 711.0


def _coarse(v: Column, buckets: int) -> Column:
    """Bucket of a value on a logarithmic scale, growing with the value."""
    scaled = F.signum(v) * F.log1p(F.abs(v))
    bounded = F.greatest(F.least(scaled, F.lit(_LOG_LIMIT)), F.lit(-_LOG_LIMIT))
    return F.floor(bounded * (buckets / (2 * _LOG_LIMIT))).cast("bigint")


def _fine(v: Column, low: Column, high: Column, buckets: int) -> Column:
    """Bucket of a value between the bounds of the bucket found before."""
    share = (v - low) / F.when(high > low, high - low)
    return F.coalesce(F.floor(share * buckets), F.lit(0)).cast("bigint")


def _locate(buckets: DataFrame, group: list[str], has_target: bool) -> DataFrame:
    """The bucket in which each wanted rank falls.

    ``buckets``: group..., [target, rank,] bucket, cnt, low, high. At most
    ``BUCKETS`` rows per group and target, so one window task per group is small.
    """
    window = Window.partitionBy(*[col(g) for g in group], *(["target"] if has_target else []))
    ordered = window.orderBy("bucket")
    seen = buckets.withColumn("upto", F.sum("cnt").over(ordered))
    if not has_target:
        seen = (
            seen.withColumn("total", F.sum("cnt").over(window))
            .withColumn(
                "t",
                F.explode(F.array(
                    F.struct(F.lit(0).alias("target"), F.expr("(total + 1) div 2").alias("rank")),
                    F.struct(F.lit(1).alias("target"), F.expr("total div 2 + 1").alias("rank")),
                )),
            )
            .withColumn("target", F.col("t.target"))
            .withColumn("rank", F.col("t.rank"))
        )
    inside = (F.col("rank") <= F.col("upto")) & (F.col("rank") > F.col("upto") - F.col("cnt"))
    return seen.where(inside).select(
        *[col(g) for g in group], "target",
        (F.col("rank") - (F.col("upto") - F.col("cnt"))).alias("rank"),
        "bucket", "low", "high",
    )


def _narrow(cells: DataFrame, state: DataFrame, group: list[str]) -> DataFrame:
    """Rows inside the buckets that are still open, once per target."""
    names = [f"__g{i}" for i in range(len(group))]
    state = state.select(
        *[col(g).alias(n) for g, n in zip(group, names)], "target", "rank",
        F.col("low").alias("lo"), F.col("high").alias("hi"),
    )
    # Two rows per group and numeric column, counted before they are broadcast;
    # beyond the bound the cells are joined by shuffle, where Spark splits hot groups.
    if state.count() <= MOST_BROADCAST:
        state = F.broadcast(state)
    same = reduce(
        lambda a, b: a & b,
        [cells[quoted(g)].eqNullSafe(state[n]) for g, n in zip(group, names)],
    )
    inside = (cells["value"] >= state["lo"]) & (cells["value"] <= state["hi"])
    return cells.join(state, same & inside).drop(*names)


def _open(found: DataFrame) -> DataFrame:
    return found.where(F.col("low") < F.col("high"))


def exact_median(df: DataFrame, columns=None, by=(), buckets: int = BUCKETS) -> DataFrame:
    """``by..., column_name, median``: mean of the two middle values; NaN is null.

    Every step that still has an open bucket is one scan; a step separates at
    least the smallest from the largest value of a bucket and divides its span
    by ``buckets``. The state is two small rows per group and column.
    """
    by = as_list(by)
    group = [*by, "column_name"]
    fields = profiled_fields(df, columns, by)
    cells = long_form(df, fields, by, value=lambda f: present(f).cast("double") + F.lit(0.0))
    keys = [col(g) for g in group]
    counted = cells.groupBy(*keys, _coarse(F.col("value"), buckets).alias("bucket")).agg(
        F.count(F.lit(1)).alias("cnt"), F.min("value").alias("low"), F.max("value").alias("high")
    )
    found = settle(_locate(counted, group, has_target=False))
    done = [found.where(F.col("low") >= F.col("high"))]
    left = _open(found)
    while not left.isEmpty():
        split = _narrow(cells, left, group).groupBy(
            *keys, "target", "rank", _fine(F.col("value"), F.col("lo"), F.col("hi"), buckets).alias("bucket")
        ).agg(F.count(F.lit(1)).alias("cnt"), F.min("value").alias("low"), F.max("value").alias("high"))
        found = settle(_locate(split, group, has_target=True))
        done.append(found.where(F.col("low") >= F.col("high")))
        left = _open(found)
    return reduce(DataFrame.unionByName, done).groupBy(*keys).agg(F.avg("low").alias("median"))
