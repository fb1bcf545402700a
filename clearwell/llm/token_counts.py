"""Token counts by a two-tier lookup on the map side, without a shuffle of pre-tokens."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .pieces import cut, frequent_pieces
from .words import small_batches

_ENCODERS: dict = {}  # of this worker: path -> tokenizer and its caches


class _Lengths(dict):
    """Piece -> number of tokens. The frequent ones come along; the others are encoded once and kept while there is room."""

    def __init__(self, encoder, frequent: dict[str, int], room: int):
        super().__init__(frequent)
        self.encoder, self.frequent, self.room = encoder, frequent, room

    def __missing__(self, piece: str) -> int:
        n = len(self.encoder.encode(f" {piece}", add_special_tokens=False).ids)
        if len(piece) <= 256:
            if len(self) >= self.room:
                self.clear()
                self.update(self.frequent)
            self[piece] = n
        return n


def _encoder(path: str, frequent: dict[str, int], room: int):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    known = _ENCODERS.get(path)
    if known is None or known[2] is not frequent:
        from tokenizers import Tokenizer

        encoder = Tokenizer.from_file(path)
        encoder.no_truncation()
        encoder.no_padding()
        special = [t.content for t in encoder.get_added_tokens_decoder().values()]
        known = _ENCODERS[path] = (encoder, special, frequent, _Lengths(encoder, frequent, room))
    return known[0], known[1], known[3]


def count_tokens(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", table: int = 65536, room: int = 600_000) -> DataFrame:
    """Per row: the id, ``n_bytes`` (UTF-8) and ``n_tokens`` of the whole text.

    ``tokenizer`` names a byte-level BPE file of the ``tokenizers`` library, on
    every machine. The lengths of the ``table`` most frequent pieces of the
    corpus are broadcast (at most ``table * 64`` characters); every other piece
    is encoded by the library in the worker that meets it and kept in a cache
    of at most ``room`` entries. A text that holds a special string is encoded
    whole, as the library treats it. Null and empty texts have 0 tokens;
    repeated rows each get their row; extra columns are ignored.
    """
    from tokenizers import Tokenizer

    spark = docs.sparkSession
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    best = frequent_pieces(source, size=table)
    encoded = Tokenizer.from_file(tokenizer).encode_batch([f" {p}" for p in best], add_special_tokens=False)
    lengths = spark.sparkContext.broadcast({p: len(e.ids) for p, e in zip(best, encoded, strict=True)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, special, known = _encoder(tokenizer, lengths.value, room)
        whole = lambda x: len(encoder.encode(x, add_special_tokens=False).ids)
        for batch in batches:
            sizes, counts = [], []
            for text in batch.column(1).to_pylist():
                text = text or ""
                sizes.append(len(text) if text.isascii() else len(text.encode()))
                if any(s in text for s in special):
                    counts.append(whole(text))
                    continue
                first, *rest = cut(text)
                counts.append((whole(first) if first else 0) + sum(map(known.__getitem__, rest)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64())], names=[id_col, "n_bytes", "n_tokens"])

    kind = source.schema["id"].dataType.simpleString()
    return small_batches(source).mapInArrow(run, f"`{id_col}` {kind}, n_bytes long, n_tokens long")
