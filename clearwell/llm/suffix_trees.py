"""Substring deduplication by prefix-partitioned suffix trees.

Suffixes are labelled by blocks of ten words. Prefixes of variable length (one
block, three, or all five of a window) deal them into groups that fit in a
task, and each group is walked in label order: neighbours that agree in all
labels are the repeats. This stands in for the tree; nodes of other depths and
longer maximal repeats are not made, as no removed word depends on them. Suffixes that cannot be part of a repeat never leave
their document: a window is only labelled if the least hash of its ten-word
runs, which every copy of it shares, also occurs in another document.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .components import MOST_IDS, written
from .words import map_batches, mix, ngrams, raw, small_batches, symbols

WINDOW, BLOCK = 50, 10
#: Suffixes of one prefix that a task takes; more are told apart by a longer prefix.
MOST_SUFFIXES = 200_000
#: Prefixes of too many suffixes are broadcast up to this number of rows, else joined by shuffle.
MOST_BROADCAST = 100_000
SPANS = "array<struct<start: long, end: long>>"
LABELS = ["l1", "l23", "l45"]  # 10, 30 and 50 words deep


def _least(runs: np.ndarray) -> np.ndarray:
    """For each window, the least hash of the ten-word runs in it."""
    width, low, span = WINDOW - BLOCK + 1, runs, 1
    while span * 2 <= width:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    return np.minimum(low[: len(low) - (width - span)], low[width - span :])


def anchors(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The ten-word runs of a text and the least one in each of its windows, as hashes."""
    runs = ngrams(symbols(data), BLOCK)
    if len(runs) < WINDOW - BLOCK + 1:
        return runs, np.empty(0, dtype=np.uint64)
    return runs, _least(runs)


def _sha(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


def _marks(docs: DataFrame) -> DataFrame:
    """Of every row: number of words, digest of its words, and the distinct anchors of its windows."""

    def per_batch(batch: pa.RecordBatch) -> list:
        sizes, digests, found = [], [], []
        for text in batch.column(1).to_pylist():
            data = raw(text)
            words = data.split()
            sizes.append(len(words))
            digests.append(_sha(words))
            found.append(np.unique(anchors(data)[1]).view(np.int64) if len(words) >= WINDOW else np.empty(0, np.int64))
        ends = np.cumsum([0, *map(len, found)], dtype=np.int32)
        return [batch.column(0), pa.array(sizes, pa.int64()), pa.array(digests), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(found)))]

    return map_batches(docs, per_batch, "doc_id long, n_words long, sha string, anchors array<long>")


def _suffixes(candidates: DataFrame) -> DataFrame:
    """The labelled suffixes of the windows whose anchor is shared: document, start, and what the window says in 24 bytes."""

    def per_batch(batch: pa.RecordBatch) -> list | None:
        columns: list[list] = [[], [], [], [], [], []]
        for doc, tag, text, shared in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            runs, least = anchors(raw(text))
            starts = np.flatnonzero(np.isin(least, np.array(shared, dtype=np.int64).view(np.uint64)))
            blocks = [runs[starts + i] for i in range(0, WINDOW, BLOCK)]
            low, high = np.uint64(0xFFFFFFFF), np.uint64(32)
            pack = lambda a, b: (mix(a) & low) << high | mix(b) & low
            for column, values in zip(columns, (np.full(len(starts), doc), np.full(len(starts), tag), starts, blocks[0].view(np.int64), pack(*blocks[1:3]).view(np.int64), pack(*blocks[3:]).view(np.int64)), strict=True):
                column.append(values)
        return [pa.array(np.concatenate(c).astype(np.int64)) for c in columns]

    return map_batches(candidates.select("doc_id", "tag", "text", "shared"), per_batch, "doc_id long, tag long, start long, l1 long, l23 long, l45 long")


def _walk(suffixes: DataFrame) -> DataFrame:
    """Windows that also start in a smaller document: a walk over each subtree in label order, then by document.

    Neighbours that agree in all labels stand below one node as deep as a
    window; its first leaf is the smallest document. The walk keeps one leaf.
    """

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, first = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            doc, tag, start, *labels = (c.to_numpy() for c in batch.columns)
            same = np.ones(len(doc), dtype=bool)
            for column in labels:
                same[1:] &= column[1:] == column[:-1]
            same[0] = last == tuple(int(c[0]) for c in labels)
            heads = np.where(same, -1, np.arange(len(doc)))
            at = np.maximum.accumulate(heads)
            firsts = np.where(at >= 0, doc[np.maximum(at, 0)], first)
            last, first = tuple(int(c[-1]) for c in labels), firsts[-1]
            repeated = doc > firsts
            yield pa.RecordBatch.from_arrays([pa.array(x[repeated]) for x in (doc, tag, start)], names=["doc_id", "tag", "start"])

    dealt = suffixes.repartition("prefix").sortWithinPartitions(*LABELS, "doc_id")
    return small_batches(dealt.select("doc_id", "tag", "start", *LABELS), rows=20_000).mapInArrow(walk, "doc_id long, tag long, start long")


def _with_key(df: DataFrame, key: list[str], keys: DataFrame, how: str) -> DataFrame:
    return df.join(keys.select(*key), key, how).select("doc_id", "tag", "start", *LABELS)


def repeats(suffixes: DataFrame, most: int = MOST_SUFFIXES) -> DataFrame:
    """``doc_id``, ``tag``, ``start`` of the windows that also start in a smaller document.

    The suffixes of a prefix of ten words make one subtree, unless there are
    more than ``most``; those go by thirty words, then by fifty. More than
    ``most`` equal windows are one leaf, whose smallest document is found by
    partial minima and joined back.
    """
    rest, groups, leaves = suffixes, [], None
    for depth in range(1, len(LABELS) + 1):
        key = LABELS[:depth]
        large = written(rest.groupBy(*key).agg(F.count("*").alias("n"), F.min("doc_id").alias("least")).where(F.col("n") > most), "prefixes")
        count = large.count()
        keys = F.broadcast(large) if count <= MOST_BROADCAST else large
        small = _with_key(rest, key, keys, "left_anti") if count else rest
        groups.append(small.withColumn("prefix", F.xxhash64(*key)))
        if not count:
            break
        if depth == len(LABELS):
            leaves = rest.join(keys, key).where(F.col("doc_id") > F.col("least")).select("doc_id", "tag", "start")
        else:
            rest = _with_key(rest, key, keys, "left_semi")
    found = groups[0]
    for more in groups[1:]:
        found = found.unionByName(more)
    walked = _walk(found)
    return walked.union(leaves) if leaves is not None else walked


def _spans(starts: np.ndarray) -> list[dict[str, int]]:
    """The runs of words that windows at these starts cover: first word, and the word after the last."""
    at = np.unique(starts)
    heads = np.flatnonzero(np.concatenate(([True], at[1:] > at[:-1] + WINDOW)))
    return [{"start": int(at[i]), "end": int(at[j]) + WINDOW} for i, j in zip(heads, [*(heads[1:] - 1), len(at) - 1], strict=True)]


def _removed(found: DataFrame) -> DataFrame:
    """Of each document with repeated windows, the spans of words that they cover."""

    def per_batch(batch: pa.RecordBatch) -> list:
        spans = [_spans(np.array(starts, dtype=np.int64)) for starts in batch.column(2).to_pylist()]
        return [batch.column(0), batch.column(1), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))]

    starts = found.groupBy("doc_id", "tag").agg(F.collect_set("start").alias("starts"))
    return map_batches(starts, per_batch, StructType.fromDDL(f"doc_id long, tag long, removed {SPANS}"))


def _kept(rows: DataFrame) -> DataFrame:
    """Of rows of id, text and removed spans: what is left of each text."""

    def per_batch(batch: pa.RecordBatch) -> list:
        sizes, tags, texts = [], [], []
        for text, removed in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            words = raw(text).split()
            edges = [0, *(edge for s in removed for edge in (s["start"], s["end"])), len(words)]
            sizes.append(len(words))
            tags.append(int(_sha(words)[:15], 16))
            texts.append(b" ".join([w for i in range(0, len(edges), 2) for w in words[edges[i] : edges[i + 1]]]))
        return [batch.column(0), pa.array(tags, pa.int64()), pa.array(sizes, pa.int64()), batch.column(2), pa.array(texts, pa.string())]

    return map_batches(rows.select("doc_id", "text", "removed"), per_batch, StructType.fromDDL(f"doc_id long, tag long, n_words long, removed {SPANS}, kept string"))


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = MOST_SUFFIXES, most_ids: int = MOST_IDS) -> DataFrame:
    """Per row: ``doc_id``, ``n_words``, ``removed`` (spans of words, in order, ends excluded), ``kept`` (the other words joined by one space).

    A word is removed if a window of ``WINDOW`` words that covers it also starts
    in a row with a smaller id. Rows of the same words are one class: all but
    those of the smallest id lose everything if they are as long as a window,
    so copies build no trees. Rows without an id neither lose words nor cause
    losses; null and empty texts have no words; rows that repeat an id each get
    their row; extra columns are ignored. Words and windows are compared by
    hashes of 64 and 192 bits. Texts that lose nothing are not shuffled for
    it, unless more than ``most_ids`` others do.
    """
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    marks = written(_marks(source), "marks").withColumn("tag", F.conv(F.substring("sha", 1, 15), 16, 10).cast("long"))
    firsts = marks.groupBy("sha").agg(F.min("doc_id").alias("first"))
    alone = marks.where(F.size("anchors") > 0).join(firsts, "sha").where(F.col("doc_id") == F.col("first"))
    seeds = written(alone.select("doc_id", "tag", F.explode("anchors").alias("anchor")), "anchors")
    shared = seeds.groupBy("anchor").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a < b").select("anchor")
    chosen = seeds.join(shared, "anchor").groupBy("doc_id", "tag").agg(F.collect_set("anchor").alias("shared"))
    joined = F.trim(F.regexp_replace("text", "[\\x20\\x09-\\x0D]+", " "))
    tag = F.conv(F.substring(F.sha2(joined, 256), 1, 15), 16, 10).cast("long")
    candidates = written(source.join(chosen, "doc_id").where(tag == F.col("tag")), "candidates")
    found = repeats(written(_suffixes(candidates), "suffixes"), most)
    removed = written(_removed(found), "removed")
    copies = marks.join(firsts, "sha").where((F.col("doc_id") > F.col("first")) & (F.col("n_words") >= WINDOW))
    copies = written(copies.select("doc_id", "tag", "n_words"), "copies")
    changed = written(removed.select("doc_id", "tag").union(copies.select("doc_id", "tag")).distinct(), "changed")
    whole = _kept(source.withColumn("removed", F.array().cast(SPANS)))
    whole = whole.join(F.broadcast(changed) if changed.count() <= most_ids else changed, ["doc_id", "tag"], "left_anti")
    cut = _kept(candidates.select("doc_id", "tag", "text").join(removed, ["doc_id", "tag"]))
    span = F.struct(F.lit(0).cast("long").alias("start"), F.col("n_words").alias("end"))
    copies = copies.withColumns({"removed": F.array(span), "kept": F.lit("")})
    names = ["doc_id", "n_words", "removed", "kept"]
    return whole.select(names).union(cut.select(names)).union(copies.select(names))


def digests(kept: DataFrame) -> DataFrame:
    """What ``without_repeats`` returns, as ``doc_id``, ``n_words``, ``n_removed``, ``kept_sha256``."""
    n_removed = F.aggregate("removed", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return kept.select("doc_id", "n_words", n_removed.alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256"))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = MOST_SUFFIXES) -> DataFrame:
    """Per row, of what ``without_repeats`` leaves: ``doc_id``, ``n_words``, ``n_removed``, ``kept_sha256``."""
    return digests(without_repeats(docs, id_col, text_col, most))
