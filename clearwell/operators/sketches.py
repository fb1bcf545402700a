"""Frequent values and repeated values from mergeable sketches.

One scan keeps, for each column, a frequent-items sketch and a distinct-count
sketch of bounded size. States of parts of a table (files, days, micro-batches)
can be kept and merged into the state of the whole.

A frequent-items sketch tracks up to ``tracked`` values in a table of
``slots(tracked)`` places. Its counts never fall short, and exceed the truth by
at most ``3.5 / slots`` of all values of the column; a value that occurs more
often than that is never missed. Columns of fewer distinct values than are
tracked are counted exactly. :func:`settled_values` makes the counts exact
whatever the number of values: the bounds say which values can be among the
first, and these are counted in one more scan.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..columns import COLUMNS_PER_AGGREGATE, as_list, as_text, col, long_form, profiled_fields, sql_text
from ..functions import value_key
from ..functions.text import KEY_BYTES
from ..runtime import settle
from .frequency import top_values

TRACKED = 10_000
#: Distinct counts have a relative standard error of about 1.04 / sqrt(2 ** 14).
HLL_BITS = 14
DISTINCT_ERROR = 1.04 / math.sqrt(1 << HLL_BITS)
_ERROR_PER_SLOT = 3.5
#: Values that can be among the first are broadcast up to this number.
MOST_CANDIDATES = 1_000_000


def slots(tracked: int) -> int:
    """Places of a sketch's table: the power of two of which ``tracked`` are three quarters at most."""
    return 1 << math.ceil(math.log2(tracked / 0.75))


def value_sketches(df: DataFrame, columns=None, by=(), tracked: int = TRACKED) -> DataFrame:
    """``by..., column_name, rows, non_null, tracked, items, distinct_items``: the state of each column, from one scan.

    Values are sketched by :func:`~clearwell.functions.value_key`, so a long
    text takes 71 bytes.
    """
    by = as_list(by)
    parts = []
    fields = profiled_fields(df, columns, by)
    for start in range(0, len(fields), COLUMNS_PER_AGGREGATE):
        chunk = fields[start:start + COLUMNS_PER_AGGREGATE]
        keyed = df.select(*[col(b).alias(f"__b{i}") for i, b in enumerate(by)], *[value_key(as_text(f)).alias(f"__k{i}") for i, f in enumerate(chunk)])
        aggs = [F.count(F.lit(1)).alias("__rows")]
        for i in range(len(chunk)):
            aggs += [
                F.count(f"__k{i}").alias(f"__n{i}"), F.expr(f"approx_top_k_accumulate(__k{i}, {tracked})").alias(f"__t{i}"),
                F.hll_sketch_agg(f"__k{i}", HLL_BITS).alias(f"__d{i}"),
            ]
        wide = keyed.groupBy(*[f"__b{i}" for i in range(len(by))]).agg(*aggs)
        rows = ", ".join(
            f"named_struct('column_name', {sql_text(f.name)}, 'rows', __rows, 'non_null', __n{i}, 'tracked', {tracked}, 'items', __t{i}, 'distinct_items', __d{i})"
            for i, f in enumerate(chunk)
        )
        parts.append(wide.select(*[F.col(f"__b{i}").alias(b) for i, b in enumerate(by)], F.expr(f"inline(array({rows}))")))
    return reduce(DataFrame.unionByName, parts)


def merge_sketches(states: DataFrame, by=(), tracked: int = TRACKED) -> DataFrame:
    """The states of the whole from those of its parts, which were made with the same ``tracked``."""
    return states.groupBy(*[col(b) for b in as_list(by)], "column_name").agg(
        F.sum("rows").alias("rows"), F.sum("non_null").alias("non_null"), F.max("tracked").alias("tracked"),
        F.expr(f"approx_top_k_combine(items, {tracked})").alias("items"), F.hll_union_agg("distinct_items").alias("distinct_items"),
    )


def _tracked_values(states: DataFrame, k: int, by, tracked: int) -> DataFrame:
    """``by..., column_name, slack, known``: the values that a state tracks, and by how much their counts may exceed the truth."""
    place = F.pow(F.lit(2), F.ceil(F.log2(F.col("tracked") / 0.75)))
    slack = F.floor(F.col("rows") * F.lit(_ERROR_PER_SLOT) / place)
    # Nulls were counted too, as one item.
    items = F.expr(f"approx_top_k_estimate(items, {max(k + 1, tracked)})")
    return states.select(*[col(b) for b in as_list(by)], "column_name", slack.alias("slack"), F.filter(items, lambda x: x["item"].isNotNull()).alias("known"))


def frequent_values(states: DataFrame, k: int = 3, by=(), tracked: int = TRACKED) -> DataFrame:
    """``by..., column_name, rank, value_key, cnt, cnt_low``: the true count lies between ``cnt_low`` and ``cnt``."""
    keys = [col(b) for b in as_list(by)]
    # All that is tracked is ranked, so that ties at the end of the k go to the lower value.
    ranked = _tracked_values(states, k, by, tracked).select(*keys, "column_name", "slack", F.inline("known"))
    # At most as many rows for each column as are tracked.
    window = Window.partitionBy(*keys, "column_name").orderBy(F.desc("count"), "item")
    return ranked.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= k).select(
        *keys, "column_name", "rank", F.col("item").alias("value_key"), F.col("count").alias("cnt"),
        F.greatest(F.col("count") - F.col("slack"), F.lit(1)).cast("bigint").alias("cnt_low"),
    )


def settled_values(df: DataFrame, states: DataFrame, k: int = 3, by=(), tracked: int = TRACKED) -> DataFrame:
    """``by..., column_name, rank, value, cnt``: the ``k`` most frequent values of ``df`` with their exact counts; ties go to the lower value.

    ``states`` are those of the whole of ``df``. A value that is not tracked
    occurs ``slack`` times at most. Where the ``k``-th of the tracked values
    surely occurs more often, only the values whose bounds reach it can be
    among the first, and these alone are counted in a second scan. The columns
    that the bounds leave open are counted whole, as are all where there are
    too many values to broadcast.
    """
    by = as_list(by)
    group = [*by, "column_name"]
    known = _tracked_values(states, k, by, tracked)
    last = F.get(F.sort_array(F.transform("known", lambda x: x["count"]), asc=False), F.lit(k - 1)) - F.col("slack")
    # A row for each column and group, with the values that can be among its first.
    near = settle(known.withColumn("last", F.coalesce(last, F.lit(0))).select(
        *[col(g) for g in group], ((F.col("slack") > 0) & (F.col("last") <= F.col("slack"))).alias("open"),
        F.transform(F.filter("known", lambda x: x["count"] >= F.col("last")), lambda x: x["item"]).alias("near")))
    names = near.groupBy("column_name").agg(F.max("open").alias("open"), F.sum(F.size("near")).alias("size")).collect()  # a row for each column
    shut = [r["column_name"] for r in names if not r["open"]]
    if sum(r["size"] for r in names if not r["open"]) > MOST_CANDIDATES:
        shut = []
    parts = []
    if shut:
        wanted = near.where(F.col("column_name").isin(shut)).select(*[col(g).alias(f"__g{i}") for i, g in enumerate(group)], F.explode("near").alias("__key"))
        same = reduce(lambda a, b: a & b, [col(g).eqNullSafe(F.col(f"__g{i}")) for i, g in enumerate(group)], value_key("value") == F.col("__key"))
        cells = long_form(df, profiled_fields(df, shut, by), by).join(F.broadcast(wanted), same)
        counts = cells.groupBy(*[col(g) for g in group], "value").agg(F.count(F.lit(1)).alias("cnt"))
        window = Window.partitionBy(*[col(g) for g in group]).orderBy(F.desc("cnt"), "value")
        parts.append(counts.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= k).select(*[col(g) for g in group], "rank", "value", "cnt"))
    rest = [r["column_name"] for r in names if r["column_name"] not in shut]
    if rest or not shut:
        parts.append(top_values(df, k, rest, by))
    return reduce(DataFrame.unionByName, parts)


def approx_top_values(df: DataFrame, k: int = 3, columns=None, by=(), tracked: int = TRACKED, exact: bool = False) -> DataFrame:
    """``by..., column_name, rank, value, cnt, cnt_low``: about the ``k`` most frequent values of each column.

    Long texts are sketched by their digests; those among the ``k`` are read
    in a second scan, for which at most ``k`` rows a column and group are joined.
    With ``exact`` that scan counts what the sketch leaves open, by :func:`settled_values`.
    """
    by = as_list(by)
    group = [*by, "column_name"]
    if exact:
        found = settled_values(df, value_sketches(df, columns, by, tracked), k, by, tracked)
        return found.withColumn("cnt_low", F.col("cnt"))
    found = frequent_values(value_sketches(df, columns, by, tracked), k, by, tracked)
    is_long = F.octet_length("value_key") > KEY_BYTES
    short = found.where(~is_long).withColumnRenamed("value_key", "value")
    cells = long_form(df, profiled_fields(df, columns, by), by).where(F.octet_length("value") > KEY_BYTES)
    wanted = found.where(is_long).select(*[col(g).alias(f"__g{i}") for i, g in enumerate(group)], F.col("value_key").alias("__key"), "rank", "cnt", "cnt_low")
    same = reduce(lambda a, b: a & b, [col(g).eqNullSafe(F.col(f"__g{i}")) for i, g in enumerate(group)], value_key("value") == F.col("__key"))
    texts = cells.join(wanted, same).groupBy(*[col(g) for g in group], "rank", "cnt", "cnt_low").agg(F.first("value").alias("value"))
    return short.unionByName(texts).select(*[col(g) for g in group], "rank", "value", "cnt", "cnt_low")


def approx_duplicates(states: DataFrame, by=()) -> DataFrame:
    """``by..., column_name, duplicate_values, max_error``: rows beyond the first of each value, null being one value.

    ``max_error`` is three standard errors of the number of distinct values.
    """
    distinct = F.hll_sketch_estimate("distinct_items")
    nulls = F.col("rows") - F.col("non_null")
    repeated = F.greatest(F.col("non_null") - distinct, F.lit(0)) + F.greatest(nulls - 1, F.lit(0))
    return states.select(
        *[col(b) for b in as_list(by)], "column_name", repeated.cast("bigint").alias("duplicate_values"),
        F.ceil(distinct * F.lit(3 * DISTINCT_ERROR)).cast("bigint").alias("max_error"),
    )
