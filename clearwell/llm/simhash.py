"""SimHash near-duplicates by multi-index hashing."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components, written
from .words import LOWER_TABLE, map_batches, raw

_CHUNK = 1 << 16


def fingerprint(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """64 bits: each is 1 if it is set in over half of the shingles' hashes."""
    from xxhash import xxh64_intdigest as hash_

    words = raw(text).translate(LOWER_TABLE).split()
    if not words:
        return 0
    if len(words) < shingle:
        hashes = [hash_(b" ".join(words), seed)]
    else:
        hashes = [hash_(s, seed) for s in map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False))]
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, len(hashes), _CHUNK):
        bits = np.unpackbits(np.array(hashes[i : i + _CHUNK], dtype="<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += np.add.reduce(bits, axis=0, dtype=np.uint32)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and ``fingerprint`` (64 bits as a long) of every row, by lower-cased 3-word shingles."""

    def per_batch(batch: pa.RecordBatch) -> list:
        return [batch.column(0), pa.array([fingerprint(t) for t in batch.column(1).to_pylist()], pa.int64())]

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return map_batches(source, per_batch, "doc_id long, fingerprint long")


def near_pairs(classes: DataFrame, distance: int = 3, segments: int = 2) -> DataFrame:
    """Pairs ``a < b`` of the distinct fingerprints in ``classes`` that differ in at most ``distance`` bits.

    If two fingerprints differ in d bits, they differ in at most d // segments
    of them within some segment. So every fingerprint is filed under each of its
    segments, and looked up under all values in the Hamming ball of that radius
    (0 or 1 here) around them; whole distances decide.
    """
    width, radius = 64 // segments, distance // segments
    if radius > 1:
        raise ValueError("use more segments for this distance")
    mask = (1 << width) - 1
    keys = F.array(*[F.shiftrightunsigned("f", width * i).bitwiseAND(F.lit(mask)) for i in range(segments)])
    filed = classes.select(F.col("fingerprint").alias("f")).select("f", F.posexplode(keys).alias("segment", "key"))
    ball = F.array(*[F.lit(x).cast("long") for x in [0, *[1 << i for i in range(width)][: width * radius]]])
    probes = filed.select(F.col("f").alias("a"), "segment", F.explode(F.transform(ball, lambda x: F.col("key").bitwiseXOR(x))).alias("key"))
    close = (F.col("a") < F.col("f")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("f"))) <= distance)
    return probes.join(filed, ["segment", "key"]).where(close).select("a", F.col("f").alias("b"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = 3) -> DataFrame:
    """Per row: ``doc_id``, ``fingerprint`` (16 hexadecimal digits), ``component_id``, the smallest id reachable by links.

    Equal fingerprints are one class from the start, so copies are never
    paired; only distinct fingerprints are looked up. Null and empty texts have
    fingerprint zero and link like any other. Repeated rows each get their row,
    extra columns are ignored, an empty table gives no rows, and rows without
    an id take part in their class but never name a component.
    """
    marked = written(fingerprints(docs, id_col, text_col), "fingerprints")
    classes = written(marked.groupBy("fingerprint").agg(F.min("doc_id").alias("first")), "classes")
    merged = components(near_pairs(classes, distance))
    roots = (
        classes.join(merged.withColumnRenamed("id", "fingerprint"), "fingerprint", "left")
        .select("fingerprint", "first", F.coalesce("component", "fingerprint").alias("root"))
    )
    named = roots.join(roots.groupBy("root").agg(F.min("first").alias("component_id")), "root").select("fingerprint", "component_id")
    return marked.join(written(named, "named"), "fingerprint").select(
        "doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id"
    )
