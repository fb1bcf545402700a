"""Token ids of documents as Parquet files: one list of ids a document, in the order of the documents' ids.

A dataset is a folder with two tables:

``tokens``
    ``part, doc_id, offset, n_tokens, ids``. Every file holds one range of ids,
    in order; ``offset`` counts the ids before the document in its own file.
    Ids are dictionary-coded (a vocabulary's dictionary takes 16 bits an id),
    the ascending numbers delta-coded. Row groups and pages have a set size, and
    each page has its entry in the page index, so that a reader of a few
    documents skips row groups and pages, and a reader of counts never touches
    the ids.
``parts``
    ``part, docs, tokens, start, least, greatest``: a row for each file, with
    the ids of all files before it.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .library_bpe import PieceEncoder
from .pieces import cut
from .words import small_batches

ROW_GROUP, PAGE, PAGE_ROWS = 32 << 20, 256 << 10, 1000  # bytes, bytes, documents
KEPT_PIECES = 300_000  # in each worker, without the marks behind them, besides those of a batch
_ENCODERS: dict = {}  # of this worker
_SPACE = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"  # what Python calls so
#: Where a space or line feed does not stand between two characters that are no white space.
_TROUBLE = rf"^[ \n]|[ \n]$|{_SPACE}[ \n]|\n{_SPACE}"


def _bounds(texts: pa.StringArray) -> np.ndarray:
    if not len(texts):
        return np.zeros(1, np.int32)
    return np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]


def _spans(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """All numbers of the spans of ``size`` numbers from ``start``, one span after the other."""
    ends = np.cumsum(size)
    shift = (start - (ends - size)).astype(np.int32)
    return np.repeat(shift, size) + np.arange(int(ends[-1]) if len(ends) else 0, dtype=np.int32)


class _Ids:
    """Ids of texts, piece by piece.

    A batch's distinct pieces are parted from the marks behind them, what is
    left is looked up, and what is new is encoded together and kept while there
    is room.
    """

    def __init__(self, path: str, room: int = KEPT_PIECES):
        self.encoder, self.room = PieceEncoder(path), room
        self.place = pa.array([], pa.string())  # what is kept; a part's place is its row
        self.start, self.size, self.ids = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint32)
        self.run: dict[str, int] = {}  # of marks
        self.run_start, self.run_size, self.run_ids = np.zeros(1, np.int64), np.zeros(1, np.int64), np.empty(0, np.uint32)

    def _places(self, parts: pa.StringArray, word: pa.BooleanArray) -> np.ndarray:
        found = pc.index_in(parts, value_set=self.place)
        new = pc.is_null(found)
        places = pc.fill_null(found, -1).to_numpy().astype(np.int64)
        at = np.flatnonzero(places < 0)
        if len(at):
            ids, start, size = self.encoder.parts(parts.filter(new), word.filter(new))
            self.start, self.size, self.ids = (np.concatenate(x) for x in ((self.start, len(self.ids) + start), (self.size, size), (self.ids, ids.astype(np.uint32))))
            places[at] = np.arange(len(self.place), len(self.place) + len(at))
            self.place = pa.concat_arrays([self.place, parts.filter(new)])
        if len(self.place) > self.room:  # go on with what this batch has
            start, self.size = self.start[places], self.size[places]
            self.ids, self.start = self.ids[_spans(start, self.size)], np.cumsum(self.size) - self.size
            places, self.place = np.arange(len(parts)), parts
        return places

    def _runs(self, pieces: pa.StringArray, parts: pa.StringArray) -> np.ndarray:
        """The number of the marks that each piece has behind its part; 0 is none."""
        ends = _bounds(pieces)[1:]
        lost = np.diff(_bounds(pieces)) - np.diff(_bounds(parts))
        found = np.zeros(len(pieces), np.int64)

        def number(run: str) -> int:
            if run not in self.run:
                self.run[run] = len(self.run_size)
                ids = self.encoder.marks(run)
                self.run_start, self.run_size = np.append(self.run_start, len(self.run_ids)), np.append(self.run_size, len(ids))
                self.run_ids = np.append(self.run_ids, np.array(ids, np.uint32))
            return self.run[run]

        if len(self.run) > self.room:  # runs of marks are few in any but made-up texts
            self.run, self.run_start, self.run_size, self.run_ids = {}, self.run_start[:1], self.run_size[:1], self.run_ids[:0]
        one, more = np.flatnonzero(lost == 1), np.flatnonzero(lost > 1)
        if len(one):
            last = np.frombuffer(pieces.buffers()[2], np.uint8)[ends[one] - 1]
            table = np.zeros(256, np.int64)
            for byte in np.unique(last).tolist():
                table[byte] = number(chr(byte))
            found[one] = table[last]
        for i, piece in zip(more.tolist(), pieces.take(pa.array(more)).to_pylist(), strict=True):
            found[i] = number(piece[-int(lost[i]) :])
        return found

    def _pieces(self, pieces: pa.StringArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, and for each piece where its ids begin and how many there are."""
        parts, word = self.encoder.parted(pieces)
        coded = parts.dictionary_encode()
        index = coded.indices.to_numpy()
        kinds = np.zeros(len(coded.dictionary), bool)
        kinds[index] = word.to_numpy(zero_copy_only=False)
        place = self._places(coded.dictionary, pa.array(kinds))[index]
        run = self._runs(pieces, parts)
        size, more = self.size[place], self.run_size[run]
        start = np.cumsum(size + more) - (size + more)
        ids = np.empty(int((size + more).sum()), np.uint32)
        ids[_spans(start, size)] = self.ids[_spans(self.start[place], size)]
        ids[_spans(start + size, more)] = self.run_ids[_spans(self.run_start[run], more)]
        return ids, start, size + more

    def _whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x.ids, np.uint32) for x in self.encoder.whole.encode_batch_fast(texts, add_special_tokens=False)]

    def texts(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each text; nulls are empty."""
        texts = pc.fill_null(texts, "")
        odd = pc.match_substring_regex(texts, _TROUBLE)
        for string in self.encoder.special:
            odd = pc.or_(odd, pc.match_substring(texts, string))
        found: list = [None] * len(texts)
        # A space or line feed alone between other characters begins a pre-token: there the text is cut.
        # Texts with special strings, or with other white space beside these, are cut by the careful rule or not at all.
        at = np.flatnonzero(odd.to_numpy(zero_copy_only=False))
        careful = texts.take(pa.array(at)).to_pylist()
        whole = [i for i, t in enumerate(careful) if " \n" in t or any(s in t for s in self.encoder.special)]
        for i, ids in zip(whole, self._whole([careful[i] for i in whole]), strict=True):
            found[at[i]] = ids
        cuts = [(at[i], cut(t)) for i, t in enumerate(careful) if found[at[i]] is None]
        even = np.flatnonzero(~odd.to_numpy(zero_copy_only=False))
        lists = pc.split_pattern(pc.replace_substring(texts.take(pa.array(even)), "\n", " \n"), " ")
        bounds = np.concatenate((lists.offsets.to_numpy().astype(np.int64), len(lists.values) + np.cumsum([len(c) for _, c in cuts], dtype=np.int64)))
        flat = pa.concat_arrays([lists.values, pa.array([p for _, c in cuts for p in c], lists.values.type)])
        order = [*even.tolist(), *(i for i, _ in cuts)]
        # Behind the first piece of a text, every piece follows a space or begins with a line feed.
        coded = flat.dictionary_encode()
        known, start, size = self._pieces(coded.dictionary)
        place = coded.indices.to_numpy()
        size, start = size[place], start[place]
        heads = flat.take(pa.array(bounds[:-1])).to_pylist()
        size[bounds[:-1]] = 0
        ends = np.cumsum(size)
        ids = known[_spans(start, size)]
        after = np.concatenate(([0], ends))[bounds]
        for i, head, low, high in zip(order, self._whole(heads), after.tolist(), after[1:].tolist(), strict=False):
            found[i] = np.concatenate((head, ids[low:high]))
        return found


def write_tokens(
    docs: DataFrame, path: str, tokenizer: str, end_id: int | None = 0, id_col: str = "doc_id", text_col: str = "text",
    files: int | None = None, row_group: int = ROW_GROUP, page: int = PAGE, page_rows: int = PAGE_ROWS,
) -> None:
    """Encode whole texts, append ``end_id`` to each and write the dataset at ``path``.

    ``tokenizer`` is a file of the ``tokenizers`` library on every machine.
    Documents are dealt by ranges of their id and, where an id repeats or is
    null, of their text's hash, so no id fills a file alone; there are
    ``files`` of them, or as many as the session has shuffle partitions.
    Order: null ids first, then by id, hash and text. Null and empty texts have
    the end id only (nothing where ``end_id`` is None). Repeated rows each get
    their row, extra columns are ignored, an empty table gives an empty dataset.
    """
    spark = docs.sparkSession
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    order = [F.asc_nulls_first("doc_id"), F.xxhash64("text"), F.asc_nulls_first("text")]
    dealt = (source.repartitionByRange(files, *order[:2]) if files else source.repartitionByRange(*order[:2])).sortWithinPartitions(*order)
    end = np.array([] if end_id is None else [end_id], np.uint32)
    kind = source.schema["doc_id"].dataType.simpleString()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _ENCODERS.get(tokenizer)
        if known is None:
            known = _ENCODERS[tokenizer] = _Ids(tokenizer)
        part, before = TaskContext.get().partitionId(), 0
        for batch in batches:
            if not batch.num_rows:
                continue
            found = known.texts(batch.column(1))
            sizes = np.fromiter(map(len, found), np.int64, len(found)) + len(end)
            ends = np.cumsum(np.concatenate(([0], sizes)))
            ids = np.concatenate([x for one in found for x in (one, end)]).astype(np.uint32).view(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids))
            part_col = pa.array(np.full(len(found), part, np.int32))
            yield pa.RecordBatch.from_arrays([part_col, batch.column(0), pa.array(before + ends[:-1]), pa.array(sizes), lists], names=["part", "doc_id", "offset", "n_tokens", "ids"])
            before += int(ends[-1])

    rows = small_batches(dealt, rows=10_000, megabytes=8).mapInArrow(encode, f"part int, doc_id {kind}, offset long, n_tokens long, ids array<int>")
    (
        rows.write.option("compression", "zstd").option("parquet.writer.version", "v2")
        .option("parquet.block.size", row_group).option("parquet.page.size", page).option("parquet.page.row.count.limit", page_rows)
        .option("parquet.enable.dictionary#doc_id", "false").option("parquet.enable.dictionary#offset", "false")
        .parquet(f"{path}/tokens")
    )
    parts = (
        spark.read.schema(rows.schema).parquet(f"{path}/tokens").groupBy("part")
        .agg(F.count("*").alias("docs"), F.sum("n_tokens").alias("tokens"), F.min("doc_id").alias("least"), F.max("doc_id").alias("greatest"))
    )
    before = F.sum("tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))  # a row for each file
    parts.withColumn("start", F.coalesce(before, F.lit(0).cast("long"))).write.parquet(f"{path}/parts")


def _parts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/parts")


def read_tokens(spark: SparkSession, path: str, where: Column | None = None, tokens: bool = True) -> DataFrame:
    """``doc_id, start, n_tokens`` and, unless ``tokens`` is false, ``ids`` of the documents.

    ``start`` counts the ids of all documents before. A condition on ``doc_id``
    or ``n_tokens`` reaches the scan, which skips row groups and pages by their
    statistics; without ``tokens`` the ids are not read. The join brings one
    number a file and is broadcast, as the files are listed by the driver anyway.
    """
    rows = spark.read.parquet(f"{path}/tokens")
    rows = rows if where is None else rows.where(where)
    rows = rows if tokens else rows.drop("ids")
    start = _parts(spark, path).select("part", F.col("start").alias("__before"))
    found = rows.join(F.broadcast(start), "part")
    return found.select("doc_id", (F.col("__before") + F.col("offset")).alias("start"), "n_tokens", *(["ids"] if tokens else []))


def read_range(spark: SparkSession, path: str, first: int, stop: int) -> DataFrame:
    """``start`` and ``ids`` of the documents' parts that lie in positions ``first`` to ``stop`` (without it) of all ids.

    The parts table tells which files overlap; the condition on ``part`` and
    ``offset`` lets the scan skip the others.
    """
    hit = _parts(spark, path).where((F.col("start") < stop) & (F.col("start") + F.col("tokens") > first))
    rows = spark.read.parquet(f"{path}/tokens").join(F.broadcast(hit.select("part", F.col("start").alias("__before"))), "part")
    at = F.col("__before") + F.col("offset")
    low = F.greatest(F.lit(first).cast("long") - at, F.lit(0).cast("long"))
    high = F.least(F.lit(stop).cast("long") - at, F.col("n_tokens"))
    found = rows.where((at < stop) & (at + F.col("n_tokens") > first))
    return found.select((at + low).alias("start"), F.slice("ids", (low + 1).cast("int"), (high - low).cast("int")).alias("ids"))


def crc32_of(rows: DataFrame, ids_col: str = "ids") -> DataFrame:
    """The rows with ``ids`` replaced by ``ids_crc32``: of the ids as little-endian unsigned 32-bit integers."""
    others = [c for c in rows.columns if c != ids_col]
    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in others)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(len(others))
            flat = np.ascontiguousarray(lists.values.to_numpy(zero_copy_only=False), "<i4").view(np.uint8)
            ends = (lists.offsets.to_numpy().astype(np.int64) * 4).tolist()
            crcs = [zlib.crc32(flat[a:b]) for a, b in zip(ends, ends[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(others)], pa.array(crcs, pa.int64())], names=[*others, "ids_crc32"])

    return small_batches(rows.select(*others, ids_col)).mapInArrow(run, f"{kinds}, ids_crc32 long")
