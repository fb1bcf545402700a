"""Document quality by nearest-neighbour voting in a latent-semantic space."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .words import map_batches, raw, symbols

BIGRAM_TERMS = 2000  # hashed byte pairs
TERMS = BIGRAM_TERMS + 8  # and eight terms for how words repeat

_PAIRS = (np.arange(65536, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)) % np.uint64(BIGRAM_TERMS)
_PAIRS = _PAIRS.astype(np.int32)
_BLOCK = 1 << 20


def terms(text: str | None) -> np.ndarray:
    """Relative term frequencies of a whole text: byte pairs, and words that repeat their predecessors."""
    data = raw(text)
    out = np.zeros(TERMS, dtype=np.float32)
    if not data.strip():
        return out
    codes = np.frombuffer(data, dtype=np.uint8)
    counts = np.zeros(BIGRAM_TERMS, dtype=np.int64)
    for i in range(0, len(codes) - 1, _BLOCK):
        part = codes[i : i + _BLOCK + 1].astype(np.int32)
        counts += np.bincount(_PAIRS[part[:-1] * 256 + part[1:]], minlength=BIGRAM_TERMS)
    out[:BIGRAM_TERMS] = counts / max(1, len(codes) - 1)
    words = symbols(data)
    for i, back in enumerate((1, 2, 3, 4)):
        if len(words) > back:
            same = float(np.mean(words[back:] == words[:-back]))
            out[BIGRAM_TERMS + 2 * i] = same
            out[BIGRAM_TERMS + 2 * i + 1] = same > 0.25
    return out


class Space:
    """A latent-semantic space with the labelled vectors in it; some MB at most, by the bounds of :func:`fit`."""

    def __init__(self, weights: np.ndarray, axes: np.ndarray, vectors: np.ndarray, labels: np.ndarray, neighbours: int, power: int):
        self.weights, self.axes, self.vectors, self.labels = weights, axes, vectors, labels
        self.neighbours, self.power = neighbours, power

    def place(self, frequencies: np.ndarray) -> np.ndarray:
        """Unit vectors of rows of term frequencies; a zero row stays zero."""
        placed = (np.sqrt(frequencies) * self.weights) @ self.axes
        length = np.linalg.norm(placed, axis=1, keepdims=True)
        return np.divide(placed, length, out=np.zeros_like(placed), where=length > 0)

    def score(self, frequencies: np.ndarray) -> np.ndarray:
        """The neighbours' labels weighted by their cosines; the share of label 1 where nothing is near."""
        if not len(self.labels):
            return np.full(len(frequencies), 0.5)
        prior = float(self.labels.mean())
        cosines = self.place(frequencies) @ self.vectors.T
        k = min(self.neighbours, len(self.labels))
        nearest = np.argpartition(-cosines, k - 1, axis=1)[:, :k]
        weights = np.maximum(np.take_along_axis(cosines, nearest, axis=1), 0).astype(np.float64) ** self.power
        total = weights.sum(axis=1)
        votes = (weights * self.labels[nearest]).sum(axis=1)
        return np.clip(np.divide(votes, total, out=np.full(len(total), prior), where=total > 0), 0.0, 1.0)


def fit(docs: DataFrame, labels: DataFrame, usable: Column, sample: int = 6000, rank: int = 64, neighbours: int = 15, power: int = 8) -> Space:
    """Fit the space and place the labelled rows in it.

    ``docs`` has ``doc_id`` and ``text``, ``labels`` has ``doc_id`` and
    ``quality``. At most ``sample`` labelled rows that are ``usable`` are taken,
    those with the smallest hash of their id: that bound is what makes the
    broadcast small (``sample * rank + 2008 * rank`` floats) at any input size.
    Where ``docs`` has several rows of one id, the text of the smallest hash
    stands for it.
    """
    spark = docs.sparkSession
    chosen = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
        .where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & usable)
        .distinct().orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(sample).collect()
    )
    empty = Space(np.zeros(TERMS, np.float32), np.zeros((TERMS, 1), np.float32), np.zeros((0, 1), np.float32), np.zeros(0), neighbours, power)
    if not chosen:
        return empty
    picked = spark.createDataFrame(chosen, "doc_id long, quality int")

    def per_batch(batch: pa.RecordBatch) -> list:
        found = [terms(t) for t in batch.column(1).to_pylist()]
        present = [np.flatnonzero(f).astype(np.uint16) for f in found]
        values = [f[p].tobytes() for f, p in zip(found, present, strict=True)]
        return [batch.column(0), pa.array([p.tobytes() for p in present], pa.binary()), pa.array(values, pa.binary())]

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    texts = source.join(F.broadcast(picked), "doc_id").groupBy("doc_id", "quality").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))
    rows = map_batches(texts.select("quality", "text"), per_batch, "quality int, present binary, terms binary")
    got = sorted((bytes(r["present"]), bytes(r["terms"]), r["quality"]) for r in rows.collect())
    if not got:
        return empty
    known = np.array([q for *_, q in got], dtype=np.float64)
    weights = (np.log((1 + len(got)) / (1 + np.bincount(np.concatenate([np.frombuffer(p, np.uint16) for p, *_ in got]), minlength=TERMS))) + 1).astype(np.float32)

    def blocks(size: int = 500):
        for i in range(0, len(got), size):
            dense = np.zeros((len(got[i : i + size]), TERMS), dtype=np.float32)
            for row, (present, values, _) in zip(dense, got[i : i + size], strict=True):
                row[np.frombuffer(present, np.uint16)] = np.frombuffer(values, np.float32)
            yield dense

    axes = _main_axes(sum((w := np.sqrt(b) * weights).T @ w for b in blocks()), min(rank, TERMS))
    space = Space(weights, axes, np.zeros((0, 1), np.float32), known, neighbours, power)
    space.vectors = np.concatenate([space.place(b) for b in blocks()])
    return space


def _main_axes(gram: np.ndarray, rank: int, rounds: int = 40) -> np.ndarray:
    """The leading eigenvectors of a symmetric matrix, by repeated multiplication of a fixed start: no memory beyond a few columns."""
    axes = np.linalg.qr(np.random.default_rng(7).normal(size=(len(gram), rank)))[0]
    for _ in range(rounds):
        axes = np.linalg.qr(gram.astype(np.float64, copy=False) @ axes)[0]
    return axes.astype(np.float32)


def score(docs: DataFrame, space: Space) -> DataFrame:
    """``doc_id`` and ``score`` (0 to 1) of every row, its whole text compared with every labelled vector.

    Cosines are exact products of blocks: a batch of documents by all labelled
    vectors. Null and empty texts get the share of label 1; without any label
    every score is 0.5. Repeated rows each get their row; extra columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(space)

    def per_batch(batch: pa.RecordBatch) -> list:
        texts = batch.column(1).to_pylist()
        scores = [shared.value.score(np.stack([terms(t) for t in texts[i : i + 256]])) for i in range(0, len(texts), 256)]
        return [batch.column(0), pa.array(np.concatenate(scores), pa.float64())]

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_batches(source, per_batch, "doc_id long, score double")


def accepted(docs: DataFrame, space: Space, least: float = 0.5) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose text scores ``least`` or more."""
    shared = docs.sparkSession.sparkContext.broadcast(space)
    at = docs.columns.index("text")

    def per_batch(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column(at).to_pylist()
        scores = [shared.value.score(np.stack([terms(t) for t in texts[i : i + 256]])) for i in range(0, len(texts), 256)]
        return batch.filter(pa.array(np.concatenate(scores) >= least))

    return map_batches(docs, per_batch, docs.schema)


def fold(modulus: int, doc_id: str = "doc_id") -> Column:
    """The CRC-32 of the id as text, modulo; a row without an id counts as 0."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % modulus, F.lit(0))
