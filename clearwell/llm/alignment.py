"""Alignment of two tokenizers over whole texts: groups by pointer jumping, and how often each pair of ids meets.

A space between two characters that are no white space is a place where the
tokens of either tokenizer begin, so a text is cut there and what is known of a
piece holds wherever it occurs. All tokens of a batch's new pieces lie on one
line of bytes. Each points to the token farthest to the right that overlaps it;
successors are doubled until nothing changes, and the token that ends a chain
names its group.

Texts are dealt into blocks of bounded size. A block knows its distinct pieces
and their pairs of ids; only its distinct pairs are shuffled, once to be summed
and once to come back with their totals.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import written
from .library_bpe import PieceEncoder
from .pieces import cut
from .words import small_batches

BLOCK = 32 << 20  # characters of text in a block
_TOKENIZERS: dict = {}  # of this worker


# --- both tokenizers ----------------------------------------------------------------
class _Both:
    """The two tokenizers: ids of pieces, bytes of ids, and the decimal text of ids with what may follow it."""

    def __init__(self, first: str, second: str):
        import sentencepiece

        self.a = PieceEncoder(first, special=False)
        self.b = sentencepiece.SentencePieceProcessor(model_file=second)
        names = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        bytes_b = [bytes([int(n[3:-1], 16)]) if self.b.is_byte(i) else n.replace("▁", " ").encode() for i, n in enumerate(names)]
        #: Whether no token of the second reaches over a space into the next piece.
        self.cuts = not any("▁" in n.lstrip("▁") for n in names)
        self.bytes = [_Ragged(self.a.vocabulary()), _Ragged(bytes_b)]
        # Of an id its text before another of its side, before the other side (A) or the next group (B), and at the end (B).
        shown = [[f"{i}{mark}".encode() for i in range(len(side.size)) for mark in marks] for side, marks in zip(self.bytes, [",|", ",;\n"], strict=True)]
        self.shown, self.b_from = shown[0] + shown[1], len(shown[0])

    def pieces(self, text: str) -> list[str]:
        return cut(text) if self.cuts else [text]

    def ids(self, pieces: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """For either side all ids, one piece after the other, and how many each has."""
        return [self.a.pieces(pieces), _flat(self.b.encode(pieces, num_threads=1))]


class _Ragged:
    """Byte strings of different lengths, taken by number all at once."""

    def __init__(self, strings: list[bytes]):
        self.size = np.array([len(s) for s in strings], np.int64)
        self.start = np.concatenate(([0], np.cumsum(self.size)[:-1])).astype(np.int64)
        self.data = np.frombuffer(b"".join(strings), np.uint8)

    def take(self, numbers: np.ndarray) -> np.ndarray:
        size = self.size[numbers]
        ends = np.cumsum(size)
        shift = np.repeat(self.start[numbers] - (ends - size), size)
        return self.data[shift + np.arange(int(ends[-1]) if len(ends) else 0)]


def _flat(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.fromiter(map(len, lists), np.int64, len(lists))
    return np.fromiter((x for one in lists for x in one), np.int64, int(sizes.sum())), sizes


def _pieces_of(side: _Ragged, ids: np.ndarray, per_piece: np.ndarray) -> list[bytes]:
    """The bytes of each piece."""
    data = side.take(ids).tobytes()
    after = np.concatenate(([0], np.cumsum(side.size[ids])))[np.cumsum(per_piece)].tolist()
    return [data[i:j] for i, j in zip([0, *after], after, strict=False)]


# --- groups -------------------------------------------------------------------------
def terminals(starts_a: np.ndarray, ends_a: np.ndarray, starts_b: np.ndarray, ends_b: np.ndarray) -> np.ndarray:
    """For each token of A and then of B the last token of its group, by pointer jumping.

    Either side covers the same line without gaps. A token points to the
    overlapping one that ends farthest to the right; where that ends where the
    token itself does, A's token is the terminal and points to itself.
    """
    n = len(starts_a)
    to_b = np.searchsorted(starts_b, ends_a, "left") - 1
    to_a = np.searchsorted(starts_a, ends_b, "left") - 1
    points = np.concatenate((np.where(ends_b[to_b] > ends_a, n + to_b, np.arange(n)), to_a))
    while True:
        doubled = points[points]
        if np.array_equal(doubled, points):
            return points
        points = doubled


class Aligned:
    """What a list of pieces has in common: numbers for each piece, its groups as text, its links as codes ``a << 32 | b``."""

    def __init__(self, both: _Both, pieces: list[str]):
        (a, per_a), (b, per_b) = both.ids(pieces)
        text = [f" {p}".encode() for p in pieces]
        size = np.fromiter(map(len, text), np.int64, len(text))
        bytes_a, bytes_b = both.bytes[0].take(a), both.bytes[1].take(b)
        line = np.frombuffer(b"".join(text), np.uint8)
        self.good = np.ones(len(pieces), bool)
        if not (np.array_equal(bytes_a, line) and np.array_equal(bytes_b, line)):
            decoded = [_pieces_of(side, ids, per) for side, ids, per in zip(both.bytes, (a, b), (per_a, per_b), strict=True)]
            self.good = np.array([x == y == z for x, y, z in zip(text, *decoded, strict=True)], bool)
        # Pieces whose bytes differ have no tokens; the others keep theirs.
        keep_a, keep_b = np.repeat(self.good, per_a), np.repeat(self.good, per_b)
        a, b, of_a, of_b = a[keep_a], b[keep_b], np.repeat(np.arange(len(pieces)), per_a)[keep_a], np.repeat(np.arange(len(pieces)), per_b)[keep_b]
        n, m, many = len(a), len(b), len(pieces)
        self.n_a, self.n_b = np.bincount(of_a, minlength=many), np.bincount(of_b, minlength=many)
        self.n_groups = self.n_links = np.zeros(many, np.int64)
        self.codes, self.groups = np.empty(0, np.int64), [b""] * many
        if not n:
            return
        ends_a, ends_b = np.cumsum(both.bytes[0].size[a]), np.cumsum(both.bytes[1].size[b])
        starts_a, starts_b = ends_a - both.bytes[0].size[a], ends_b - both.bytes[1].size[b]
        label = terminals(starts_a, ends_a, starts_b, ends_b)
        is_end = label[:n] == np.arange(n)
        rank = np.cumsum(is_end) - 1  # of the groups, by their terminal
        group_a, group_b = rank[label[:n]], rank[label[n:]]
        count = int(rank[-1]) + 1
        in_a, in_b = np.bincount(group_a, minlength=count), np.bincount(group_b, minlength=count)
        of_group = of_a[is_end]
        self.n_groups = np.bincount(of_group, minlength=many)
        # Links: each A token with the B tokens from the first that ends behind its start to the last that starts before its end.
        low = np.searchsorted(ends_b, starts_a, "right")
        links = np.searchsorted(starts_b, ends_a, "left") - low
        flat = np.repeat(low - (np.cumsum(links) - links), links) + np.arange(int(links.sum()))
        self.codes = np.repeat(a, links) << 32 | b[flat]
        self.n_links = np.bincount(np.repeat(of_a, links), minlength=many)
        # Text: a group's A tokens, its B tokens, then the next group.
        first = np.cumsum(in_a + in_b) - (in_a + in_b)
        place_a = np.arange(n) - (np.cumsum(in_a) - in_a)[group_a] + first[group_a]
        place_b = np.arange(m) - (np.cumsum(in_b) - in_b)[group_b] + (first + in_a)[group_b]
        tokens = np.empty(n + m, np.int64)
        last_a, last_b = np.cumsum(in_a) - 1, np.cumsum(in_b) - 1
        mark_a, mark_b = np.zeros(n, np.int64), np.zeros(m, np.int64)
        mark_a[last_a], mark_b[last_b] = 1, 1
        closing = np.append(of_group[1:] != of_group[:-1], True)
        mark_b[last_b[closing]] = 2
        tokens[place_a], tokens[place_b] = 2 * a + mark_a, both.b_from + 3 * b + mark_b
        texts = iter(b"".join(map(both.shown.__getitem__, tokens.tolist())).split(b"\n"))
        self.groups = [next(texts) if k else b"" for k in self.n_groups.tolist()]


class _Block:
    """The distinct pieces of a block, numbered in the order of their first occurrence."""

    def __init__(self, both: _Both):
        self.both, self.number, self.size = both, {}, 0
        self.groups: list[bytes] = []
        self.parts: list[Aligned] = []
        self.stats = np.empty((0, 4), np.int64)  # n_a, n_b, n_groups, n_links of each piece
        self.good = np.empty(0, bool)
        self.counts = np.empty(0, np.int64)  # occurrences of each piece

    def learn(self, cuts: list[list[str]]) -> None:
        new = list(dict.fromkeys(p for one in cuts for p in one if p not in self.number))
        if new:
            self.number.update(zip(new, range(len(self.number), len(self.number) + len(new)), strict=True))
            found = Aligned(self.both, new)
            self.parts.append(found)
            self.groups += found.groups
            self.stats = np.concatenate((self.stats, np.stack((found.n_a, found.n_b, found.n_groups, found.n_links), 1)))
            self.good = np.concatenate((self.good, found.good))

    def numbers(self, pieces: list[str]) -> np.ndarray:
        return np.fromiter(map(self.number.__getitem__, pieces), np.int64, len(pieces))

    def texts(self, texts: list[str]) -> list[np.ndarray]:
        """The piece numbers of each text; a text with a piece whose bytes differ is looked at as one piece, and has none if it still differs."""
        cuts = [self.both.pieces(t) if t else [] for t in texts]
        self.learn(cuts)
        found = [self.numbers(one) for one in cuts]
        bad = [i for i, one in enumerate(found) if len(one) and not self.good[one].all()]
        self.learn([[texts[i]] for i in bad])
        for i in bad:
            one = self.numbers([texts[i]])
            found[i] = one if self.good[one[0]] else one[:0]
        used = np.concatenate(found) if found else np.empty(0, np.int64)
        counts = np.bincount(used, minlength=len(self.number))
        counts[: len(self.counts)] += self.counts
        self.counts = counts
        self.size += sum(map(len, texts))
        return found

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct codes, how many links hold each, and for each piece its number of links and, one after the other, the places of their codes."""
        codes = np.concatenate([p.codes for p in self.parts] or [np.empty(0, np.int64)])
        used, per_piece = self.counts > 0, self.stats[:, 3]  # a text that was looked at as one piece leaves its others unused
        codes, per_piece = codes[np.repeat(used, per_piece)], np.where(used, per_piece, 0)
        distinct, place = np.unique(codes, return_inverse=True)
        n = np.bincount(place, weights=np.repeat(self.counts, per_piece), minlength=len(distinct)).astype(np.int64)
        return distinct, n, per_piece, place


def _packed(numbers: np.ndarray) -> bytes:
    return zlib.compress(np.ascontiguousarray(numbers, "<i4").view(np.uint8).reshape(-1, 4).T.tobytes(), 1)  # bytes of the same weight together


def _unpacked(data: bytes) -> np.ndarray:
    raw = np.frombuffer(zlib.decompress(data), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(raw.T).view("<i4").reshape(-1).astype(np.int64)


_SUMS = ["n_a", "n_b", "n_groups", "n_links"]


def align(docs: DataFrame, first: str, second: str, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """Two tables, written to the shared folder.

    ``rows``, one for each document: ``block``, the id, ``n_a``, ``n_b``,
    ``n_groups``, ``n_links``, ``groups_sha256`` and ``pieces``. ``blocks``:
    ``block``, its distinct ``codes`` with their link counts ``n``, and packed
    the links of its pieces. ``first`` is a byte-level file of the
    ``tokenizers`` library, ``second`` a model of ``sentencepiece``, on every
    machine. A block ends after ``block`` characters or with its task.
    """
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = source.schema["id"].dataType.simpleString()
    names = ["block", "id", *_SUMS, "groups_sha256", "pieces", "codes", "n", "per_piece", "place"]
    schema = f"block long, id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pieces binary, codes array<long>, n array<long>, per_piece binary, place binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = _TOKENIZERS.get((first, second))
        if both is None:
            both = _TOKENIZERS[first, second] = _Both(first, second)
        number, now, id_type = TaskContext.get().partitionId() << 32, _Block(both), pa.int64()

        def closing() -> pa.RecordBatch:
            codes, n, per_piece, place = now.pairs()
            values = [number, None, 0, 0, 0, 0, None, None, codes, n, _packed(per_piece), _packed(place)]
            kinds = [pa.int64(), id_type, *[pa.int64()] * 4, pa.string(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], names=names)

        for batch in batches:
            rows, id_type = batch.num_rows, batch.column(0).type
            found = now.texts([t or "" for t in batch.column(1).to_pylist()])
            sums = [now.stats[one].sum(0) for one in found]
            shas = [hashlib.sha256(b";".join(map(now.groups.__getitem__, one.tolist()))).hexdigest() if len(one) else "" for one in found]
            columns = [pa.array(np.full(rows, number)), batch.column(0), *map(pa.array, np.array(sums, np.int64).reshape(-1, 4).T.copy()), pa.array(shas, pa.string()), pa.array([_packed(one) for one in found], pa.binary())]
            empty = [pa.nulls(rows, pa.list_(pa.int64())), pa.nulls(rows, pa.list_(pa.int64())), pa.nulls(rows, pa.binary()), pa.nulls(rows, pa.binary())]
            yield pa.RecordBatch.from_arrays([*columns, *empty], names=names)
            if now.size >= block:
                yield closing()
                number, now = number + 1, _Block(both)
        if now.number:
            yield closing()

    both_kinds = written(small_batches(source, rows=500).mapInArrow(run, schema), "aligned")
    rows = both_kinds.where("codes IS NULL").select(*names[:8])
    return rows, both_kinds.where("codes IS NOT NULL").select("block", *names[8:])


def pair_counts(blocks: DataFrame) -> DataFrame:
    """``code, total, best``: of each pair of ids, how many links hold it, and whether no pair of its B id has more.

    The greatest count of each B id is broadcast: at most one row for each
    entry of B's vocabulary.
    """
    each = blocks.select(F.explode(F.arrays_zip("codes", "n")).alias("x")).select(F.col("x.codes").alias("code"), F.col("x.n").alias("n"))
    total = written(each.groupBy("code").agg(F.sum("n").alias("total")).withColumn("b", F.col("code").bitwiseAND(0xFFFFFFFF)), "pairs")
    most = total.groupBy("b").agg(F.max("total").alias("most"))
    return total.join(F.broadcast(most), "b").select("code", F.shiftright("code", 32).alias("a"), "b", "total", (F.col("total") == F.col("most")).alias("best"))


def align_counts(docs: DataFrame, first: str, second: str, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """Per row: the id, ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``n_best``, ``count_sum``, ``groups_sha256``.

    Texts that are null or empty, or that a tokenizer does not give back byte
    for byte behind a space, have no tokens: zeros and an empty string. Repeated
    rows and ids each get their row and count each time; null ids stay; extra
    columns are ignored; an empty table gives none. Nothing is broadcast but a
    row for each entry of B's vocabulary, and a group is one block, whose size
    is bounded whatever its documents' ids or sources are.
    """
    rows, blocks = align(docs, first, second, id_col, text_col, block)
    pairs = blocks.select("block", F.posexplode("codes").alias("at", "code"))
    known = pairs.join(pair_counts(blocks).select("code", "total", "best"), "code")
    stats = known.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("at", "total", "best"))).alias("s"))
    stats = blocks.select("block", "per_piece", "place").join(stats.select("block", F.col("s.total").alias("total"), F.col("s.best").alias("best")), "block", "left")
    kind = rows.schema["id"].dataType.simpleString()
    names = [id_col, *_SUMS, "n_best", "count_sum", "groups_sha256"]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        one = right.slice(0, 1).to_pydict() if right.num_rows else None
        n = left.num_rows
        best = counted = np.zeros(n, np.int64)
        if one:
            total = np.array(one["total"][0] or [], np.int64)
            is_best = np.array(one["best"][0] or [], np.int64)
            per_piece, place = _unpacked(one["per_piece"][0]), _unpacked(one["place"][0])
            running = np.zeros((len(place) + 1, 2), np.int64)
            np.cumsum(np.stack((is_best[place], total[place]), 1), 0, out=running[1:])
            ends = np.cumsum(per_piece)
            sums = running[ends] - running[ends - per_piece]
            found = np.array([sums[_unpacked(x)].sum(0) for x in left.column("pieces").to_pylist()], np.int64).reshape(-1, 2)
            best, counted = found[:, 0].copy(), found[:, 1].copy()
        columns = [left.column("id"), *[left.column(c) for c in _SUMS], pa.array(best), pa.array(counted), left.column("groups_sha256")]
        return pa.Table.from_arrays(columns, names=names)

    grouped = rows.groupBy("block").cogroup(stats.withColumnRenamed("block", "of_block").groupBy("of_block"))
    return grouped.applyInArrow(run, f"`{id_col}` {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")
