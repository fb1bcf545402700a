"""Words of whole texts, and 64-bit symbols for them, for the operators that run in Arrow batches.

A word is a run of anything but the six ASCII white-space characters
(space and U+0009 to U+000D), which is what ``bytes.split()`` cuts at.
A null text has no words.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32
LOWER_TABLE = LOWER.tobytes()

_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class Powers:
    """Powers of an odd number and of its inverse, both modulo 2**64, as far as they were needed."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 2**64)
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up), 4096)
            for name, base in (("up", self.base), ("down", self.inverse)):
                powers = np.full(size, base, dtype=np.uint64)
                powers[0] = 1
                setattr(self, name, np.multiply.accumulate(powers))
        return self.up[:n], self.down[:n]


_OF_BYTES = Powers(0x9E3779B97F4A7C15)
_OF_WORDS = Powers(0xC2B2AE3D27D4EB4F)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every bit of a 64-bit number over all bits; a bijection."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


LONG_WORD = 64  # bytes


def symbols(raw: bytes) -> np.ndarray:
    """One 64-bit symbol for each word, equal for equal words.

    Words of more than ``LONG_WORD`` bytes are hashed by XXH64: sums modulo a
    power of two do not tell certain words of a thousand bytes apart.
    """
    data = np.frombuffer(raw, dtype=np.uint8)
    if not len(data):
        return np.empty(0, dtype=np.uint64)
    edge = np.diff(np.concatenate(([0], (~IS_SPACE[data]).view(np.int8), [0])).astype(np.int8))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    up, down = _OF_BYTES.get(len(data) + 1)
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_BYTE[data] * up[:-1], out=sums[1:])
    found = mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))
    for i in np.flatnonzero(end - start > LONG_WORD).tolist():
        found[i] = xxhash.xxh64_intdigest(raw[start[i] : end[i]])
    return found


def ngrams(symbols_: np.ndarray, n: int) -> np.ndarray:
    """The 64-bit symbol of each run of n words."""
    count = len(symbols_) - n + 1
    if count <= 0:
        return np.empty(0, dtype=np.uint64)
    up, down = _OF_WORDS.get(len(symbols_) + 1)
    sums = np.zeros(len(symbols_) + 1, dtype=np.uint64)
    np.cumsum(symbols_ * up[:-1], out=sums[1:])
    return mix((sums[n:] - sums[:count]) * down[:count] + np.uint64(n))


def raw(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def small_batches(df: DataFrame, rows: int = 1000, megabytes: int = 16) -> DataFrame:
    """Keep Arrow batches small, as some texts are long."""
    conf = df.sparkSession.conf
    conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(megabytes << 20))
    return df


def map_batches(df: DataFrame, per_batch: Callable[[pa.RecordBatch], pa.RecordBatch | list | None], schema: str | StructType) -> DataFrame:
    """Apply a function to each Arrow batch; it returns a batch, or a list of columns in the order of the schema."""
    names = schema.names if isinstance(schema, StructType) else [field.split()[0] for field in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                out = per_batch(batch)
                if out is not None:
                    yield out if isinstance(out, pa.RecordBatch) else pa.RecordBatch.from_arrays(out, names=names)

    return small_batches(df).mapInArrow(run, schema)
