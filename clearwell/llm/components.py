"""Connected components of links, as DataFrames: large stars and small stars in turn."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clearwell.runtime import scratch_path


def written(df: DataFrame, label: str) -> DataFrame:
    """The rows as a table in the shared folder: computed once, lineage cut, safe from lost executors."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Ids that are broadcast to a join; some 20 MB.
MOST_IDS = 1_000_000


def without(docs: DataFrame, ids: DataFrame, label: str, most: int = MOST_IDS) -> DataFrame:
    """The rows of ``docs`` whose ``doc_id`` is not in ``ids``; rows without an id stay.

    The ids are written and counted first. Up to ``most`` of them are broadcast,
    so that texts are not shuffled; more are joined by shuffle.
    """
    gone = written(ids.select("doc_id").distinct(), label)
    return docs.join(F.broadcast(gone) if gone.count() <= most else gone, "doc_id", "left_anti").select(docs.columns)


def _large(links: DataFrame) -> DataFrame:
    """Each node tells its larger neighbours the smallest one it knows of."""
    both = links.select(F.col("a").alias("u"), F.col("b").alias("v")).union(links.select(F.col("b"), F.col("a")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("m").alias("a"), F.col("v").alias("b")).where("a < b").distinct()


def _small(links: DataFrame) -> DataFrame:
    """Each node joins itself and its smaller neighbours to the smallest of them; links come with a < b."""
    least = links.groupBy("b").agg(F.min("a").alias("m"))
    lower = links.join(least, "b").where("a > m").select(F.col("m").alias("a"), F.col("a").alias("b"))
    return lower.union(least.select(F.col("m").alias("a"), F.col("b"))).distinct()


def components(links: DataFrame, most_rounds: int = 40) -> DataFrame:
    """``id`` and ``component`` (the smallest id reachable) of every node of the links ``a``, ``b``.

    Self-links, repeated links and either direction are fine. Minima are taken
    before the shuffle, and the joins that follow are plain equi-joins, whose
    hot keys Spark can split. Each round is written to the shared folder.
    """
    now = written(links.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    seen = None
    for _ in range(most_rounds):
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen or not state[0]:
            break
        seen = state
        now = written(_small(_large(now)), "links")
    else:
        raise RuntimeError("the links did not settle")
    return now.select(F.col("b").alias("id"), F.col("a").alias("component")).union(now.select("a", "a").distinct())
