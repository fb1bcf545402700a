"""Near-duplicate vectors by a pivot-permutation index.

A vector is described by its nearest reference points (pivots), in order. Near
vectors share pivots, so they meet in the pivots' inverted lists; pairs that
share enough pivots are verified by their cosine in double precision.

Where vectors are dense, that order is chance: there a vector lies close to a
pivot, and an angle bound takes the place of the order. By the triangle
inequality, every vector linked with one that lies within ``INSIDE`` of its
nearest pivot lies within ``INSIDE`` and one link angle of that pivot, and no
further from it than two link angles more than from its own nearest. All that
meet both bounds are put in that pivot's ball, so these links are all found.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components, written
from .words import map_batches

COSINE = 0.95
PREFIX = 8  # nearest pivots that describe a vector
SHARED = 2  # pivots that a pair must share to be verified
BLOCK = 4096  # vectors of one list in one task; longer lists are split into pairs of blocks
MOST_PIVOTS, VECTORS_PER_PIVOT = 4096, 48
#: In link angles: pivots are at least so far apart; vectors so near to their nearest pivot are compared by its ball.
APART, INSIDE = 1.5, 1.75
#: Pivots that may lie within a ball's reach of each other: a vector is in few more balls than that.
MOST_BALLS = 64
SLACK = 1e-6  # radians, for rounding
OUTSIDE = np.iinfo(np.int64).max


def unit(vectors: np.ndarray) -> np.ndarray:
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def _angles(cosines: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(cosines, -1.0, 1.0))


def thinned(pivots: list[np.ndarray], angle: float, most: int = MOST_BALLS) -> list[np.ndarray]:
    """The pivots in order without those near to a pivot kept before, or within reach of ``most`` of them; ``angle`` is the link angle."""
    kept: list[np.ndarray] = []
    units: dict[int, np.ndarray] = {}
    counts: dict[int, int] = {}
    for pivot in pivots:
        size = len(pivot)
        if size not in units:
            units[size], counts[size] = np.empty((sum(len(p) == size for p in pivots), size)), 0
        own = unit(pivot[None])[0]
        away = _angles(units[size][: counts[size]] @ own)
        if (away >= APART * angle).all() and (away <= (INSIDE + 1) * angle).sum() < most:
            units[size][counts[size]] = own
            counts[size] += 1
            kept.append(pivot)
    return kept


def nearest_pivots(vectors: np.ndarray, pivots: list[np.ndarray], prefix: int, angle: float) -> tuple[np.ndarray, np.ndarray, list[list[int]]]:
    """Of vectors of one length, by pivots of that length.

    The numbers of each one's nearest pivots, nearest first, -1 where there are
    fewer; the nearest if it is within ``INSIDE``, else ``OUTSIDE``; and the
    pivots whose balls the vector is in. Where no pivot has that length, all
    are in one ball of a negative number.
    """
    same = np.array([i for i, p in enumerate(pivots) if len(p) == vectors.shape[1]])
    out = np.full((len(vectors), prefix), -1, dtype=np.int64)
    if not len(same):
        own = -1 - vectors.shape[1]
        return out, np.full(len(vectors), own), [[own]] * len(vectors)
    cosines = unit(vectors) @ unit(np.stack([pivots[i] for i in same])).T
    k = min(prefix, len(same))
    near = np.argpartition(-cosines, k - 1, axis=1)[:, :k] if k < len(same) else np.tile(np.arange(len(same)), (len(vectors), 1))
    order = np.argsort(-np.take_along_axis(cosines, near, axis=1), axis=1, kind="stable")
    out[:, :k] = same[np.take_along_axis(near, order, axis=1)]
    least = _angles(cosines.max(axis=1))
    homes = np.where(least <= INSIDE * angle, same[cosines.argmax(axis=1)], OUTSIDE)
    reach = np.minimum((INSIDE + 1) * angle, least + 2 * angle) + SLACK
    within = cosines >= np.cos(np.minimum(reach, np.pi))[:, None]
    return out, homes, [same[row].tolist() for row in within]


def _place(classes: DataFrame, pivots: list[np.ndarray], prefix: int, angle: float) -> DataFrame:
    shared = classes.sparkSession.sparkContext.broadcast(pivots)

    def per_batch(batch: pa.RecordBatch) -> list:
        vectors = batch.column(1).to_pylist()
        near, homes, balls = ([None] * len(vectors) for _ in range(3))
        for size in {len(v) for v in vectors}:
            rows = [i for i, v in enumerate(vectors) if len(v) == size]
            found = nearest_pivots(np.array([vectors[i] for i in rows]), shared.value, prefix, angle)
            for i, permutation, home, within in zip(rows, found[0].tolist(), found[1].tolist(), found[2], strict=True):
                near[i], homes[i], balls[i] = [p for p in permutation if p >= 0] if home == OUTSIDE else [], home, within
        lists = pa.list_(pa.int64())
        return [batch.column(0), batch.column(2), pa.array(near, lists), pa.array(homes, pa.int64()), pa.array(balls, lists), batch.column(1)]

    return map_batches(classes.select("first", "vector", "size"), per_batch, "id long, size long, pivots array<long>, home long, balls array<long>, vector array<double>")


def _roots(n: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The smallest position linked with each of n positions."""
    root = np.arange(n)
    while True:
        low = root.copy()
        np.minimum.at(low, x, root[y])
        np.minimum.at(low, y, root[x])
        low = low[low]
        if (low == root).all():
            return root
        root = low


def _verify(key: tuple, rows: pd.DataFrame, cosine: float, shared: int) -> pd.DataFrame:
    """Pairs of one list, or of two blocks of it.

    In a ball: those of which one is inside, by the smaller pivot where both
    are. In an inverted list: those that share enough pivots and whose smallest
    common pivot this is.
    """
    ball, pivot, left, right = (int(k) for k in key)
    inside = (rows["home"].to_numpy() == pivot) | (not ball)
    order = np.lexsort((rows["id"].to_numpy(), ~inside))
    ids, sizes, blocks, homes, inside = (*(rows[c].to_numpy()[order] for c in ("id", "size", "block", "home")), inside[order])
    vectors, near = rows["vector"].to_numpy()[order], rows["pivots"].to_numpy()[order]
    lists = np.full((len(ids), max(len(p) for p in near)), -1, dtype=np.int64)
    for i, p in enumerate(near):
        lists[i, : len(p)] = np.sort(p)
    enough = np.minimum(shared, (lists >= 0).sum(axis=1))

    def rule(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        if ball:
            return np.minimum(homes[x], homes[y]) == pivot
        common = (lists[x][:, :, None] == lists[y][:, None, :]).any(axis=2) & (lists[x] >= 0)
        least = np.where(common, lists[x], OUTSIDE).min(axis=1)
        return (common.sum(axis=1) >= np.minimum(enough[x], enough[y])) & (least == pivot)

    links, root = np.zeros(len(ids)), np.arange(len(ids))
    for size in {len(v) for v in vectors}:
        own = np.flatnonzero([len(v) == size for v in vectors])
        units = unit(np.stack(vectors[own]))
        for i in range(0, int(inside[own].sum()), 512):
            x, y = np.nonzero(np.triu(units[i : i + 512] @ units[i:].T >= cosine, 1))
            x, y = own[x + i], own[y + i]
            if left != right:
                apart = blocks[x] != blocks[y]
                x, y = x[apart], y[apart]
            good = np.concatenate([rule(x[a : a + 200_000], y[a : a + 200_000]) for a in range(0, len(x), 200_000)] or [np.empty(0, dtype=bool)])
            x, y = x[good], y[good]
            links += np.bincount(x, weights=sizes[y], minlength=len(ids)) + np.bincount(y, weights=sizes[x], minlength=len(ids))
            new = root[x] != root[y]
            if new.any():
                root = _roots(len(ids), root[x[new]], root[y[new]])[root]
    linked = links > 0
    return pd.DataFrame({"id": ids[linked], "links": links[linked].astype(np.int64), "root": ids[root][linked]})


def link_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = COSINE, prefix: int = PREFIX, shared: int = SHARED, most_pivots: int = MOST_PIVOTS, block: int = BLOCK) -> DataFrame:
    """Per row: ``vec_id``, ``n_links``, ``component_id`` (smallest id reachable), ``kept``.

    Pivots are at most ``most_pivots`` distinct vectors, one for each
    ``VECTORS_PER_PIVOT``, those with the smallest hash of their id: that is
    the bounded sample the index is fitted on, and what is broadcast; those
    near to another are left out, so that dense groups share few. Every
    vector is indexed. Equal vectors are one class with a size from the start.
    A pair of which one vector lies within ``INSIDE`` link angles of its nearest
    pivot is always verified, in that pivot's ball. Any other pair is verified
    where it shares ``shared`` of the ``prefix`` nearest pivots, once, in the
    list of its smallest common pivot: that part is an index, not exact. A
    length of vectors without a pivot is one ball. A list of more than
    ``block`` classes is split into pairs of blocks, so no task gets an unbounded
    list, and none is cut. Tasks report link counts and a spanning forest, never
    all pairs. Vectors that are null, empty, zero or hold null or non-finite
    components, and vectors of different lengths, do not link. Repeated ids
    count as rows; extra columns are ignored; an empty table gives no rows.
    """
    rows = written(vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector")), "vectors")
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    sound = F.coalesce(F.col("vec_id").isNotNull() & finite & F.exists("vector", lambda x: x != 0), F.lit(False))
    classes = written(rows.where(sound).groupBy("vector").agg(F.min("vec_id").alias("first"), F.count("*").alias("size")), "classes")
    count = classes.count()
    wanted = max(1, min(most_pivots, max(64, count // VECTORS_PER_PIVOT)))
    angle = float(np.arccos(cosine))
    sample = [np.array(r["vector"]) for r in classes.orderBy(F.xxhash64("first"), "first").limit(wanted).select("vector").collect()]
    placed = written(_place(classes, thinned(sample, angle), prefix, angle), "placed")
    entry = lambda ball: lambda p: F.struct(F.lit(ball).alias("ball"), p.alias("pivot"))
    entries = F.concat(F.transform("pivots", entry(0)), F.transform("balls", entry(1)))
    keys = ["ball", "pivot"]
    lists = placed.select("id", "size", "pivots", "home", "vector", F.explode(entries).alias("entry")).select("entry.*", "id", "size", "pivots", "home", "vector")
    blocks = placed.select(F.explode(entries).alias("entry")).select("entry.*").groupBy(*keys).agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))  # two rows for each pivot
    own = lists.join(F.broadcast(blocks), keys).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    cells = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.struct(F.least("block", j).alias("left"), F.greatest("block", j).alias("right")))
    dealt = own.withColumn("cell", F.explode(cells)).select(*keys, "cell.*", "block", "id", "size", "pivots", "home", "vector")
    found = written(
        dealt.groupBy(*keys, "left", "right").applyInPandas(lambda key, rows: _verify(key, rows, cosine, shared), "id long, links long, root long"), "found"
    )
    joined = components(found.select(F.col("id").alias("a"), F.col("root").alias("b")))
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    named = (
        classes.join(links, F.col("first") == F.col("id"), "left").drop("id").join(joined, F.col("first") == F.col("id"), "left")
        .select("vector", (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("n_links"), F.coalesce("component", "first").alias("component_id"))
    )
    component = F.coalesce("component_id", "vec_id")
    return rows.join(named, "vector", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (F.col("vec_id") == component).alias("kept"))
