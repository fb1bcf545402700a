"""A word bigram model with deleted interpolation, learned from and applied to whole corpora.

Counts are kept apart from texts: batches of texts ask shards of the n-gram
space for the counts of their distinct n-grams, and each shard answers. What
is shuffled is six bytes and a small count for each distinct n-gram of a batch,
never a row for each token.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import written
from .words import LOWER_TABLE, map_batches, mix, raw, small_batches, symbols

TRAIN, WEIGHTS, OTHER = 0, 1, 2  # parts: learned from; learned from, and held out while weights are learned; only scored
BEGIN, END = np.uint64(0x5BD1E9955BD1E995), np.uint64(0x27D4EB2F165667C5)
_LEFT, _RIGHT = np.uint64(0x9FB21C651E98DF25), np.uint64(0xA0761D6478BD642F)
KEY_BITS = 56  # of an n-gram; its first bits are the shard, its last 48 are sent
LEAST_SHARD_BITS = 8
KEYS_PER_SHARD = 2_000_000
BATCH_BYTES = 8 << 20
BUCKETS = 24  # of context frequency, by powers of two
GRID = 0.1  # step of the natural logarithm in which held-out probabilities are counted
NEVER = -(1 << 40)  # stands for the logarithm of zero


def bucket(count: np.ndarray) -> np.ndarray:
    """0 for contexts never seen, else one more than the whole part of log2 of the count."""
    return np.minimum(np.frexp(count.astype(np.float64))[1], BUCKETS - 1)


# --- texts in batches ---------------------------------------------------------------
def batches_of(docs: DataFrame, part) -> DataFrame:
    """Rows of about ``BATCH_BYTES`` of text that are all of one part: a new id, the documents' ids, their texts compressed."""

    def pack(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        import zstandard

        held: dict[int, list] = {}
        sizes: dict[int, int] = {}

        def flush(kind: int) -> pa.RecordBatch:
            ids, texts = zip(*held.pop(kind), strict=True)
            sizes.pop(kind)
            blob = zstandard.ZstdCompressor(level=1).compress(b"".join(texts))
            lengths = np.array([len(t) for t in texts], dtype=np.int64)
            tokens = sum(len(t.split()) for t in texts) + len(texts)
            return pa.RecordBatch.from_arrays(
                [pa.array([uuid.uuid4().hex]), pa.array([kind], pa.int32()), pa.array([tokens], pa.int64()), pa.array([list(ids)], pa.list_(pa.int64())), pa.array([lengths.tobytes()], pa.binary()), pa.array([blob], pa.binary())],
                names=["batch", "part", "tokens", "ids", "lengths", "texts"],
            )

        for batch in rows:
            for id_, text, kind in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                data = raw(text).translate(LOWER_TABLE)
                held.setdefault(kind, []).append((id_, data))
                sizes[kind] = sizes.get(kind, 0) + len(data) + 16
                if sizes[kind] >= BATCH_BYTES:
                    yield flush(kind)
        for kind in list(held):
            yield flush(kind)

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), part.cast("int").alias("part"))
    return small_batches(source).mapInArrow(pack, "batch string, part int, tokens long, ids array<long>, lengths binary, texts binary")


class Batch:
    """The tokens of a batch: words and one end for each document, as symbols, and the contexts before them."""

    def __init__(self, lengths: bytes, texts: bytes):
        import zstandard

        data = zstandard.ZstdDecompressor().decompress(texts, max_output_size=max(1, int(np.frombuffer(lengths, np.int64).sum())))
        ends = np.cumsum(np.frombuffer(lengths, dtype=np.int64))
        words = [np.append(symbols(data[a:b]), END) for a, b in zip([0, *ends[:-1]], ends, strict=True)]
        self.sizes = np.array([len(w) for w in words])
        self.words = np.concatenate(words)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.before = np.roll(self.words, 1)
        self.before[self.starts] = BEGIN

    def keys(self, order: int) -> np.ndarray:
        if order == 1:
            return self.words >> np.uint64(64 - KEY_BITS)
        return mix(self.before * _LEFT + self.words * _RIGHT) >> np.uint64(64 - KEY_BITS)


def _six(keys: np.ndarray) -> bytes:
    return np.ascontiguousarray(keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def _from_six(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 6, 8), dtype=np.uint8)
    out[:, :6] = np.frombuffer(data, dtype=np.uint8).reshape(-1, 6)
    return out.view("<u8").reshape(-1)


def _small(counts: np.ndarray) -> tuple[bytes, bytes]:
    """Counts in a byte each, and those of 255 or more in full."""
    return np.minimum(counts, 255).astype(np.uint8).tobytes(), counts[counts >= 255].astype("<i8").tobytes()


def _unsmall(small: bytes, large: bytes) -> np.ndarray:
    out = np.frombuffer(small, dtype=np.uint8).astype(np.int64)
    out[out == 255] = np.frombuffer(large, dtype="<i8")
    return out


# --- questions and answers ----------------------------------------------------------
def _ask(batches: DataFrame, shard_bits: int) -> DataFrame:
    """For each batch, order and shard that meet: the distinct keys, ascending, and how often the batch has them."""

    def ask(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in rows:
            for name, part, lengths, texts in zip(*(c.to_pylist() for c in group.columns), strict=True):
                batch = Batch(lengths, texts)
                for order in (1, 2):
                    keys, counts = np.unique(batch.keys(order), return_counts=True)
                    shards = (keys >> np.uint64(KEY_BITS - shard_bits)).astype(np.int64)
                    cuts = np.flatnonzero(np.diff(shards, prepend=-1))
                    out: list[list] = [[], [], [], []]
                    for a, b in zip(cuts, [*cuts[1:], len(keys)], strict=True):
                        small, large = _small(counts[a:b])
                        for column, value in zip(out, (int(shards[a]), _six(keys[a:b]), small, large), strict=True):
                            column.append(value)
                    n = len(cuts)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([name] * n), pa.array([part] * n, pa.int32()), pa.array([order] * n, pa.int32()), pa.array(out[0], pa.int64()), *(pa.array(c, pa.binary()) for c in out[1:])],
                        names=["batch", "part", "order", "shard", "keys", "small", "large"],
                    )

    return small_batches(batches.select("batch", "part", "lengths", "texts"), rows=1).mapInArrow(ask, "batch string, part int, order int, shard long, keys binary, small binary, large binary")


_ANSWER = "batch string, order int, shard long, small binary, large binary, train_small binary, train_large binary, n_kinds long"


def _answer(asked: pd.DataFrame) -> pd.DataFrame:
    """The counts of one shard: over all that is learned from, and for batches that teach weights also without them."""
    keys = [_from_six(k) for k in asked["keys"]]
    counts = [_unsmall(s, x) for s, x in zip(asked["small"], asked["large"], strict=True)]
    known, place = np.unique(np.concatenate(keys), return_inverse=True)
    ends = np.cumsum([len(k) for k in keys])
    train, both = np.zeros(len(known), dtype=np.int64), np.zeros(len(known), dtype=np.int64)
    places = [place[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]
    for part, at, n in zip(asked["part"], places, counts, strict=True):
        if part == TRAIN:
            train[at] += n
        if part in (TRAIN, WEIGHTS):
            both[at] += n
    out = []
    for row, (batch, part, order, shard, at) in enumerate(zip(asked["batch"], asked["part"], asked["order"], asked["shard"], places, strict=True)):
        alone = _small(train[at]) if part == WEIGHTS else (b"", b"")
        out.append((batch, order, shard, *_small(both[at]), *alone, int((both > 0).sum()) if row == 0 else 0))
    return pd.DataFrame(out, columns=[f.split()[0] for f in _ANSWER.split(", ")])


def _with_answers(batches: DataFrame, answers: DataFrame) -> DataFrame:
    fields = ["order", "shard", "small", "large", "train_small", "train_large"]
    gathered = answers.groupBy("batch").agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("answers"))  # no more than the batch asked for
    return batches.select("batch", "ids", "lengths", "texts").join(gathered, "batch").select("ids", "lengths", "texts", "answers")


def _counts(batch: Batch, answers: list[dict], train_only: bool) -> tuple[np.ndarray, np.ndarray]:
    """Counts of each token and of each token in its context, in the order of the batch."""
    found = []
    for order in (1, 2):
        own = [a for a in answers if a["order"] == order]
        names = ("train_small", "train_large") if train_only else ("small", "large")
        counts = np.concatenate([_unsmall(a[names[0]], a[names[1]]) for a in own])
        found.append(counts[np.unique(batch.keys(order), return_inverse=True)[1]])
    return found[0], found[1]


def _before(batch: Batch, words: np.ndarray, texts: int) -> np.ndarray:
    """How often each token's context was followed by something: the count of the word before, or the number of texts."""
    before = np.roll(words, 1)
    before[batch.starts] = texts
    return before


# --- the model ----------------------------------------------------------------------
def learn_weights(grid: np.ndarray, rounds: int = 60) -> np.ndarray:
    """Expectation-maximisation of (BUCKETS, 3) weights from held-out counts.

    ``grid`` has rows (bucket, p2, p1, p0, n): n held-out tokens to which the
    bigram, the unigram and the uniform estimate give these probabilities.
    """
    weights = np.tile([0.4, 0.5, 0.1], (BUCKETS, 1))
    weights[0] = [0.0, 0.8, 0.2]
    for b in range(BUCKETS):
        rows = grid[grid[:, 0] == b] if len(grid) else grid
        if not len(rows):
            continue
        p, n = rows[:, 1:4], rows[:, 4]
        for _ in range(rounds):
            parts = p * weights[b]
            weights[b] = (parts / parts.sum(axis=1, keepdims=True) * n[:, None]).sum(axis=0) / n.sum()
        weights[b] = np.maximum(weights[b], 1e-9)
        weights[b] /= weights[b].sum()
    return weights


def _held_out_grid(paired: DataFrame, train_tokens: int, train_texts: int, kinds: int, grid: float) -> np.ndarray:
    """Held-out tokens counted by bucket and by their probabilities in logarithmic steps of ``grid``; its size does not grow with the corpus."""

    def count(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in rows:
            for _, lengths, texts, answers in zip(*(c.to_pylist() for c in group.columns), strict=True):
                batch = Batch(lengths, texts)
                words, pairs = _counts(batch, answers, train_only=True)
                before = _before(batch, words, train_texts)
                step = lambda p: np.where(p > 0, np.round(np.log(np.maximum(p, 1e-30)) / grid), NEVER).astype(np.int64)
                cells = np.stack([bucket(before), step(pairs / np.maximum(before, 1)), step(words / max(1, train_tokens))], axis=1)
                cells, n = np.unique(cells, axis=0, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(cells[:, 0]), pa.array(cells[:, 1]), pa.array(cells[:, 2]), pa.array(n)], names=["bucket", "p2", "p1", "n"])

    cells = small_batches(paired, rows=1).mapInArrow(count, "bucket long, p2 long, p1 long, n long").groupBy("bucket", "p2", "p1").agg(F.sum("n").alias("n")).collect()
    value = lambda q: 0.0 if q == NEVER else float(np.exp(q * grid))
    return np.array([(r["bucket"], value(r["p2"]), value(r["p1"]), 1 / (kinds + 1), r["n"]) for r in cells], dtype=np.float64).reshape(-1, 5)


def score_texts(docs: DataFrame, part, grid: float = GRID) -> DataFrame:
    """Per row: ``doc_id``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``score``, both log10 of probabilities.

    ``part`` is a column of ``TRAIN``, ``WEIGHTS`` or ``OTHER`` over ``docs``
    (``doc_id``, ``text``). The model mixes f(word | word before), f(word) and a
    uniform estimate; the weights hang on how often the word before was seen
    and are learned by expectation-maximisation on the ``WEIGHTS`` part, from
    counts that leave it out. Scores use the counts of ``TRAIN`` and
    ``WEIGHTS`` together. Each count covers the whole corpus; n-grams are told
    apart by 56 bits. Null texts are empty: one token, the end. Repeated rows
    each get their row (and count); extra columns are ignored; without any text
    to learn from all words are equally unknown.
    """
    batches = written(batches_of(docs, part), "batches")
    sizes = {r["part"]: r for r in batches.groupBy("part").agg(F.sum("tokens").alias("tokens"), F.sum(F.size("ids")).alias("texts")).collect()}
    tokens = {p: sizes[p]["tokens"] if p in sizes else 0 for p in (TRAIN, WEIGHTS, OTHER)}
    texts = {p: sizes[p]["texts"] if p in sizes else 0 for p in (TRAIN, WEIGHTS, OTHER)}
    shard_bits = max(LEAST_SHARD_BITS, int(np.ceil(np.log2(max(1, sum(tokens.values()) / KEYS_PER_SHARD)))))
    answers = written(_ask(batches, shard_bits).groupBy("order", "shard").applyInPandas(_answer, _ANSWER), "answers")
    kinds = answers.where("order = 1").agg(F.sum("n_kinds")).first()[0] or 0
    held_out = _with_answers(batches.where(F.col("part") == WEIGHTS), answers.where(F.col("train_small") != F.lit(b"")))
    weights = learn_weights(_held_out_grid(held_out, tokens[TRAIN], texts[TRAIN], kinds, grid))
    n, learned_texts = tokens[TRAIN] + tokens[WEIGHTS], texts[TRAIN] + texts[WEIGHTS]

    def score(group: pa.RecordBatch) -> list:
        found: list[list] = [[], [], [], [], []]
        for ids, lengths, data, replies in zip(*(c.to_pylist() for c in group.columns), strict=True):
            batch = Batch(lengths, data)
            words, pairs = _counts(batch, replies, train_only=False)
            before = _before(batch, words, learned_texts)
            w = weights[bucket(before)]
            mixed = w[:, 0] * (pairs / np.maximum(before, 1)) + w[:, 1] * (words / max(1, n)) + w[:, 2] / (kinds + 1)
            per_text = lambda x: np.add.reduceat(x, batch.starts)
            base = np.log10((words + 1) / (n + kinds + 1))
            for column, values in zip(found, (ids, batch.sizes.tolist(), per_text((words > 0).astype(np.int64)).tolist(), per_text(base).tolist(), per_text(np.log10(mixed)).tolist()), strict=True):
                column.extend(values)
        return [pa.array(found[0], pa.int64()), pa.array(found[1], pa.int64()), pa.array(found[2], pa.int64()), pa.array([n] * len(found[0]), pa.int64()), pa.array(found[3], pa.float64()), pa.array(found[4], pa.float64())]

    scored = map_batches(_with_answers(batches, answers), score, "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1")
    return scored
