"""Texts cut into pieces that a byte-level BPE pattern never crosses, and the corpus's most frequent pieces.

A single space between two characters that are no white space always starts a
pre-token and nothing before it reaches over it. So a text can be cut there,
each piece but the first standing for itself with that space before it, and
what is known of a piece holds wherever it occurs.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import small_batches

_TROUBLE = re.compile(r"\s ")
_CUT = re.compile(r"(?<=\S) (?=\S)")


def cut(text: str) -> list[str]:
    """The pieces of a text, without the space before each but the first."""
    return text.split(" ") if not _TROUBLE.search(text) and text[:1] != " " and text[-1:] != " " else _CUT.split(text)


def frequent_pieces(docs: DataFrame, text: str = "text", size: int = 65536, per_task: int = 8192, longest: int = 64) -> list[str]:
    """At most ``size`` pieces, the most frequent ones by the counts that tasks keep.

    Each task reads all its texts and reports its ``per_task`` most frequent
    pieces, so the shuffle holds that many rows a task and no stream of
    pre-tokens. The result only says what is worth broadcasting; it decides no
    result. Its size in bytes is at most ``size * longest`` characters.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()
        for batch in batches:
            for value in batch.column(0).to_pylist():
                counts.update(cut(value or "")[1:])
            if len(counts) > 40 * per_task:  # bounded memory: keep the upper part and go on
                counts = Counter(dict(counts.most_common(10 * per_task)))
        best = [(p, n) for p, n in counts.most_common(per_task) if len(p) <= longest]
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in best], pa.string()), pa.array([n for _, n in best], pa.int64())], names=["piece", "n"])

    found = small_batches(docs.select(F.col(text).cast("string").alias("text"))).mapInArrow(count, "piece string, n long")
    rows = found.groupBy("piece").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "piece").limit(size).collect()
    return [r["piece"] for r in rows]
