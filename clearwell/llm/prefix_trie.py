"""The prefix trie of conversations, built by cutting depths in half.

The depths of the trie are cut as a van Emde Boas layout cuts them: at half
depth, every prefix that reaches the cut gets a name; the depths above form an
upper trie, those below a forest with a tree under each name, and both are cut
again. All blocks of one size are cut in the same job, so there are as many
rounds as the longest conversation's length has binary digits. A prefix is named
by its smallest conversation. Totals go the other way: in each round the tree
totals of the lower forests are grafted onto the prefixes above them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import MOST_IDS, written
from .words import small_batches

WORD = r"[^\x20\x09-\x0D]+"
CHUNK = 8192  # conversation ids that are joined to one string in one group


def turns(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``conv, pos, digest, words``: the turns of each conversation in order, counted from 1.

    Order: ``turn``, null first, then the SHA-256 of role and text, so that ties
    have one order. Null roles and texts are empty; rows without a conversation
    id belong to none and are left out. Rows are dealt by ranges of their whole
    order, so that a long conversation is spread over tasks; what it has in the
    tasks before is added from a broadcast of at most two rows a task.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    named = F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256))
    words = F.size(F.regexp_extract_all(text, F.lit(WORD), 0)).cast("long")
    rows = conversations.where(F.col(conv_col).isNotNull()).select(F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).alias("turn"), named.alias("digest"), words.alias("words"))
    order = [F.asc("conv"), F.asc_nulls_first("turn"), F.asc("digest")]
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).drop("turn")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, seen = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            conv = batch.column(0).to_numpy()
            at = np.arange(len(conv))
            begins = np.append(True, conv[1:] != conv[:-1])
            first = np.maximum.accumulate(np.where(begins, at, 0))
            pos = at - first + 1 + np.where((first == 0) & (conv[0] == last), seen, 0)
            last, seen = conv[-1], pos[-1]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(conv), part, np.int32)), batch.column(0), pa.array(pos), *batch.columns[1:]], names=["part", "conv", "pos", "digest", "words"])

    local = written(small_batches(dealt, rows=10_000).mapInArrow(count, "part int, conv long, pos long, digest binary, words long"), "turns")
    each = local.groupBy("conv", "part").agg(F.count("*").alias("n"))
    several = each.groupBy("conv").agg(F.count("*").alias("parts")).where("parts > 1").select("conv")
    before = F.coalesce(F.sum("n").over(Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    spread = each.join(F.broadcast(several), "conv").select("conv", "part", before.alias("before"))
    return local.join(F.broadcast(spread), ["conv", "part"], "left").select("conv", (F.col("pos") + F.coalesce("before", F.lit(0))).alias("pos"), "digest", "words")


def shared_openings(turns: DataFrame, group: int = 20, most: int = 4) -> tuple[DataFrame, DataFrame]:
    """Conversations rebuilt on the opening of their group's first one: the turns, and ``conv, length`` of all.

    Conversation c takes the first h turns of conversation ``c - c % group``
    (all if it has fewer, none if there is none) and then its own after its
    first h, with h the CRC-32 of its decimal id modulo ``most``.
    """
    h = F.crc32(F.col("conv").cast("string").cast("binary")) % most
    lengths = written(turns.groupBy("conv").agg(F.count("*").alias("n")).select("conv", "n", h.alias("h"), (F.col("conv") - F.col("conv") % group).alias("base")), "lengths")
    of_base = lengths.select(F.col("conv").alias("base"), F.least(F.col("n"), F.lit(most - 1)).alias("base_n"))
    convs = lengths.join(of_base, "base", "left").withColumn("taken", F.least("h", F.coalesce("base_n", F.lit(0))))
    convs = written(convs.select("conv", "base", "n", "h", "taken"), "openings")
    first = turns.where(F.col("pos") < most).withColumnRenamed("conv", "base").join(convs.where("taken > 0"), "base").where("pos <= taken")
    own = turns.join(convs, "conv").where("pos > h").withColumn("pos", F.col("pos") - F.col("h") + F.col("taken"))
    columns = ["conv", "pos", "digest", "words"]
    rebuilt = written(first.select(columns).unionByName(own.select(columns)), "rebuilt")
    return rebuilt, convs.select("conv", (F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length"))


def _segments(rows: DataFrame, rounds: int) -> list[DataFrame]:
    """For each power of two the digests of all whole runs of so many turns that begin at its multiples."""
    levels = [rows.select("conv", (F.col("pos") - 1).alias("at"), "digest")]
    for j in range(1, rounds):
        half, whole = 1 << (j - 1), 1 << j
        side = lambda low: F.max(F.when((F.col("at") % whole == low), F.col("digest")))  # noqa: B023, E731
        start = (F.col("at") - F.col("at") % whole).alias("at")
        both = levels[-1].groupBy("conv", start).agg(side(0).alias("left"), side(half).alias("right"))
        found = both.where("right IS NOT NULL").select("conv", "at", F.unhex(F.sha2(F.concat("left", "right"), 256)).alias("digest"))
        levels.append(written(found, f"runs-{whole}"))
    return levels


def prefix_names(rows: DataFrame, lengths: DataFrame, rounds: int) -> DataFrame:
    """``conv, depth, name``: for every prefix of every conversation, down to the empty one, the smallest conversation that begins so.

    A prefix of one conversation is named by it; the names of the others are
    counted and broadcast, or joined by shuffle beyond ``MOST_IDS`` of them.
    """
    least = lengths.agg(F.min("conv").alias("name"))
    known = [written(lengths.join(F.broadcast(least)).select("conv", F.lit(0).cast("long").alias("depth"), "name"), "names")]  # one row
    segments = _segments(rows, rounds)
    for j in reversed(range(rounds)):
        # From each cut that has a name, the next 2**j turns, where the conversation has them: the cut in the middle.
        cuts = reduce(DataFrame.unionByName, known).join(segments[j].withColumnRenamed("at", "depth"), ["conv", "depth"])
        key = ["name", "depth", "digest"]
        several = cuts.groupBy(key).agg(F.min("conv").alias("smallest"), F.count("*").alias("n")).where("n > 1").drop("n")
        several = written(several, "shared")  # apart from the join, so that Spark can split a prefix of many conversations there
        found = cuts.join(F.broadcast(several) if several.count() <= MOST_IDS else several, key, "left")
        known.append(written(found.select("conv", (F.col("depth") + (1 << j)).alias("depth"), F.coalesce("smallest", "conv").alias("name")), "names"))
    return reduce(DataFrame.unionByName, known)


def grafted(names: DataFrame, nodes: DataFrame, rounds: int, columns: list[str]) -> DataFrame:
    """The nodes' ``columns`` summed over their subtrees.

    In round j, blocks of 2**j depths are joined in pairs: the total of every
    root of a lower forest goes to the prefixes of its name in the upper block.
    """
    totals = nodes.select("name", "depth", *columns)
    for j in range(rounds):
        half, whole = 1 << j, 1 << (j + 1)
        block = F.floor(F.col("depth") / F.lit(whole)).alias("block")
        roots = totals.where(F.col("depth") % whole == half).select(F.col("name").alias("conv"), block, *columns)
        above = names.where(F.col("depth") % whole < half).select("conv", block, "name", "depth")
        gained = above.join(roots, ["conv", "block"]).select("name", "depth", *columns)
        summed = totals.unionByName(gained).groupBy("name", "depth").agg(*[F.sum(c).alias(c) for c in columns])
        totals = written(summed, "totals")
    return totals


def joined_ids_sha256(ends: DataFrame, key: list[str], id_col: str = "conv", chunk: int = CHUNK) -> DataFrame:
    """``key`` and ``ends_sha256``: lowercase SHA-256 of the ids of each key, ascending and joined by commas.

    Ids are joined in ranges of ``chunk`` numbers first. A key within one range
    is done with that. SHA-256 reads its input in order, so the ranges of a
    larger key pass one task, as a stream of strings of which it holds one.
    """
    part = F.floor(F.col(id_col) / F.lit(chunk)).alias("part")
    strings = ends.groupBy(*key, part).agg(F.array_join(F.sort_array(F.collect_list(id_col)).cast("array<string>"), ",").alias("ids"))
    strings = written(strings, "ends")
    several = written(strings.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1").select(*key), "large-ends")
    one = strings.join(several, key, "left_anti").select(*key, F.sha2("ids", 256).alias("ends_sha256"))
    more = strings.join(several, key, "left_semi").select(*key, "part", "ids")
    more = more.repartition(*key).sortWithinPartitions(*key, "part").select(*key, "ids")

    names = one.columns

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        done = lambda: pa.RecordBatch.from_pylist([dict(zip(names, [*now, state.hexdigest()], strict=True))])
        for batch in batches:
            for *at, ids in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if at == now:
                    state.update(b"," + ids.encode())
                    continue
                if now is not None:
                    yield done()
                now, state = at, hashlib.sha256(ids.encode())
        if now is not None:
            yield done()

    return one.unionByName(small_batches(more, rows=64).mapInArrow(digest, one.schema))


def prefix_trie(rows: DataFrame, lengths: DataFrame) -> DataFrame:
    """The nodes of the trie of the sequences ``conv, pos, digest, words``.

    ``lengths`` has ``conv, length`` of every sequence, turnless ones included.
    Per node, named by ``conv_id``, its smallest member, and ``depth``:
    ``parent_conv_id`` (null at the root), ``n_convs``, ``n_children``,
    ``n_leaves`` (childless nodes of its subtree), ``saved_tokens`` (over its
    subtree, words of a node's last turn for each member but the first) and
    ``ends_sha256`` of the members that end here. Equal sequences share their
    nodes; without a sequence there is no node. Groups are counted before they
    are shuffled, and no step needs all members of a node together.
    """
    longest = lengths.agg(F.max("length")).first()[0]
    rounds = int(longest or 0).bit_length()
    names = written(prefix_names(rows, lengths, rounds), "prefixes")
    counts = names.groupBy("name", "depth").agg(F.count("*").alias("n_convs"))
    own = names.where("conv = name").select("conv", "depth")  # a node's smallest member stands for it
    parent = names.select("conv", (F.col("depth") + 1).alias("depth"), F.col("name").alias("parent"))
    words = rows.select("conv", F.col("pos").alias("depth"), "words")
    node = own.join(parent, ["conv", "depth"], "left").join(words, ["conv", "depth"], "left").withColumnRenamed("conv", "name").join(counts, ["name", "depth"])
    node = written(node, "nodes")
    children = node.where("parent IS NOT NULL").groupBy(F.col("parent").alias("name"), (F.col("depth") - 1).alias("depth")).agg(F.count("*").alias("n_children"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long"))
    node = node.join(children, ["name", "depth"], "left").select(
        "name", "depth", "parent", "n_convs", zero("n_children").alias("n_children"),
        F.col("n_children").isNull().cast("long").alias("n_leaves"), ((F.col("n_convs") - 1) * zero("words")).alias("saved_tokens"),
    )
    node = written(node, "nodes")
    sums = ["n_leaves", "saved_tokens"]
    totals = grafted(names, node, rounds, sums)
    ends = joined_ids_sha256(names.join(lengths.select("conv", F.col("length").alias("depth")), ["conv", "depth"]), ["name", "depth"])
    empty = F.lit(hashlib.sha256(b"").hexdigest())
    found = node.drop(*sums).join(totals, ["name", "depth"]).join(ends, ["name", "depth"], "left")
    return found.select(
        F.col("name").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), "n_convs", "n_children", *sums,
        F.coalesce("ends_sha256", empty).alias("ends_sha256"),
    )
