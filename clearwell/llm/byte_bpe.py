"""Byte-level BPE: encoding by ranked merges over bytes, decoding by joining the bytes of tokens.

The merges of the corpus's frequent words are folded by Spark's higher-order
functions with the ranks as a literal map; every other distinct word is merged
by the same rule in the worker that meets it.
"""

from __future__ import annotations

import base64
import heapq
import json
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .pieces import cut, frequent_pieces
from .words import small_batches

BUCKETS = 8192  # of the literal rank map: Spark looks a key up in a map by trying one after the other
_ENCODERS: dict = {}  # of this worker


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: a line for each token, its bytes in base64 and its rank."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


# --- the fold in Spark --------------------------------------------------------------
def rank_literal(ranks: dict[bytes, int]) -> Column:
    """The ranks as one foldable expression: buckets by CRC-32, in each a map from a token's hexadecimal bytes."""
    buckets: list[dict[str, int]] = [{} for _ in range(BUCKETS)]
    for token, rank in ranks.items():
        name = token.hex().upper()
        buckets[zlib.crc32(name.encode()) % BUCKETS][name] = rank
    return F.from_json(F.lit(json.dumps(buckets, separators=(",", ":"))), "array<map<string,int>>")


def fold_merges(word: Column, ranks: Column) -> Column:
    """Token ids of a binary word: its bytes, then again and again the leftmost pair of the lowest rank made one."""
    rank = lambda x: F.element_at(F.element_at(ranks, (F.crc32(x) % BUCKETS + 1).cast("int")), x)

    def merge(parts: Column, _: Column) -> Column:
        pairs = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.struct(rank(F.concat(F.element_at(parts, i), F.element_at(parts, i + 1))).alias("rank"), i.alias("at")))
        best = F.array_min(F.filter(pairs, lambda p: p["rank"].isNotNull()))
        at = best["at"]
        merged = F.concat(F.slice(parts, 1, at - 1), F.array(F.concat(F.element_at(parts, at), F.element_at(parts, at + 1))), F.slice(parts, at + 2, F.size(parts)))
        return F.when(F.size(parts) < 2, parts).otherwise(F.coalesce(merged, parts))

    name = F.hex(word)
    bytes_ = F.transform(F.sequence(F.lit(0), F.length(word) - 1), lambda i: F.substring(name, i * 2 + 1, 2))
    steps = F.sequence(F.lit(1), F.greatest(F.length(word) - 1, F.lit(1)))
    folded = F.aggregate(steps, bytes_, merge)
    return F.when(F.length(word) == 0, F.array().cast("array<int>")).when(rank(name).isNotNull(), F.array(rank(name))).otherwise(F.transform(folded, rank))


def encode_words(spark: SparkSession, words: list[bytes], ranks: dict[bytes, int]) -> dict[bytes, list[int]]:
    """Ids of distinct words, folded on the executors. The words are a bounded list; of the ranks, those that occur in them are sent."""
    parts = {w[i:j] for w in words for i in range(len(w)) for j in range(i + 1, len(w) + 1)}
    ranks = {token: rank for token, rank in ranks.items() if token in parts}
    df = spark.createDataFrame([(w,) for w in words], "word binary").repartition(spark.sparkContext.defaultParallelism)
    return {bytes(r["word"]): r["ids"] for r in df.select("word", fold_merges(F.col("word"), rank_literal(ranks)).alias("ids")).collect()}


# --- the same merges in a worker ----------------------------------------------------
def merge_word(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Token ids of one word of any length."""
    if word in ranks:
        return [ranks[word]]
    return _merge_long(word, ranks) if len(word) > 48 else _merge_short(word, ranks)


def _merge_short(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    none, get = len(ranks) + 256, ranks.get
    parts = [word[i : i + 1] for i in range(len(word))]
    pairs = [get(word[i : i + 2], none) for i in range(len(word) - 1)]
    while pairs:
        best = min(pairs)
        if best == none:
            break
        i = pairs.index(best)
        parts[i] += parts.pop(i + 1)
        del pairs[i]
        if i < len(pairs):
            pairs[i] = get(parts[i] + parts[i + 1], none)
        if i:
            pairs[i - 1] = get(parts[i - 1] + parts[i], none)
    return [ranks[p] for p in parts]


def _merge_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """A heap holds the candidate pairs, so n bytes take n log n steps."""
    n = len(word)
    end = list(range(1, n + 1))  # of the part that begins here
    before = list(range(-1, n - 1))
    alive = [True] * n
    heap = [(ranks[p], i, i + 2) for i in range(n - 1) if (p := word[i : i + 2]) in ranks]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        j = end[i]
        if not alive[i] or j >= n or end[j] != stop:
            continue
        alive[j] = False
        end[i] = stop
        if stop < n:
            before[stop] = i
            if (r := ranks.get(word[i : end[stop]])) is not None:
                heapq.heappush(heap, (r, i, end[stop]))
        if (k := before[i]) >= 0 and (r := ranks.get(word[k:stop])) is not None:
            heapq.heappush(heap, (r, k, stop))
    return [ranks[word[i : end[i]]] for i in range(n) if alive[i]]


class _Pieces(dict):
    """Piece with its space -> ids as int32 bytes. Words are merged once while there is room.

    There are two generations: when the younger is full it becomes the older,
    from which what is met again is taken back.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str, frequent: dict[bytes, bytes], room: int):
        import regex

        super().__init__()
        self.ranks, self.words, self.frequent, self.room = ranks, regex.compile(pattern).findall, frequent, room
        self.older: dict[str, bytes] = {}

    def word(self, word: str) -> bytes:
        data = word.encode()
        ids = self.frequent.get(data)
        return array("i", merge_word(data, self.ranks)).tobytes() if ids is None else ids

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.word, self.words(text)))

    def __missing__(self, piece: str) -> bytes:
        ids = self.older.get(piece)
        if ids is None:
            if piece[-1:] in (".", ",") and piece[:-1].isalpha():  # letters and one mark are two words under any such pattern
                ids = self[piece[:-1]] + self.word(piece[-1])
            else:
                ids = self.encode(f" {piece}")
        if len(piece) <= 256:
            if len(self) >= self.room:
                self.older = dict(self)
                self.clear()
            self[piece] = ids
        return ids


def _encoder(path: str, pattern: str, frequent: dict[bytes, bytes], room: int):
    known = _ENCODERS.get((path, pattern))
    if known is None or known[2] is not frequent:
        ranks = read_ranks(path)
        tokens = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            tokens[rank] = token
        known = _ENCODERS[path, pattern] = (_Pieces(ranks, pattern, frequent, room), tokens, frequent)
    return known[:2]


def encode(docs: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", table: int = 16384, room: int = 500_000) -> DataFrame:
    """Per row: the id, ``ids`` (array of int) of the whole text and ``decoded`` (binary), joined from the ids' bytes.

    The words of the ``table`` most frequent pieces are folded by
    :func:`encode_words` and broadcast; they are at most ``table * 64``
    characters. The others are merged in the workers, whose caches hold at most
    ``2 * room`` pieces. ``rank_file`` lies on every machine. Null and empty texts
    give no ids and no bytes; repeated rows each get their row; extra columns
    are ignored.
    """
    import regex

    spark = docs.sparkSession
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    words = {w.encode() for p in frequent_pieces(source, size=table) for w in regex.findall(pattern, f" {p}")}
    words = {w for w in words if len(w) <= 64}
    folded = encode_words(spark, sorted(words), read_ranks(rank_file)) if words else {}
    frequent = spark.sparkContext.broadcast({w: np.array(ids, dtype=np.int32).tobytes() for w, ids in folded.items()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, tokens = _encoder(rank_file, pattern, frequent.value, room)
        for batch in batches:
            ids, decoded = [], []
            for text in batch.column(1).to_pylist():
                first, *rest = cut(text or "")
                one = b"".join([known.encode(first), *map(known.__getitem__, rest)])
                ids.append(one)
                decoded.append(b"".join(map(tokens.__getitem__, np.frombuffer(one, dtype=np.int32).tolist())))
            ends = np.cumsum([0, *(len(x) // 4 for x in ids)], dtype=np.int32)
            values = pa.Array.from_buffers(pa.int32(), int(ends[-1]), [None, pa.py_buffer(b"".join(ids))])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends), values), pa.array(decoded, pa.binary())], names=[id_col, "ids", "decoded"])

    kind = source.schema["id"].dataType.simpleString()
    return small_batches(source, rows=500).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>, decoded binary")
