"""Delimited text: finding out its layout, reading it, and its broken lines.

Detection reads lines with the text source, so a file of any size is split over
many tasks. Only facts about files reach the driver: separator, encoding and
header, one row per file.
"""

from __future__ import annotations

import csv
from collections.abc import Sequence
from dataclasses import dataclass, field, replace
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import settings as S
from ..columns import as_list, col, quoted
from ..functions.text import INTEGER
from .names import normalize_names

CORRUPT = "_corrupt_record"


class DelimitedReadError(Exception):
    """A delimited source cannot be read."""


def _is_wide(encoding: str | None) -> bool:
    """Whether characters are several bytes wide, so that lines cannot be cut at single bytes."""
    return bool(encoding) and encoding.lower().replace("_", "-").startswith(("utf-16", "utf-32"))


def read_lines(spark: SparkSession, paths, encoding: str | None = None, line_sep: str | None = None) -> DataFrame:
    """``path, block, id, value``: every line, with its place in its file.

    Lines end with any of the three line breaks, or with ``line_sep``. Files of
    a wide encoding are decoded whole, a task for each.
    """
    if _is_wide(encoding):
        source = (
            spark.read.option("encoding", encoding).option("multiLine", True).option("sep", "\u0001").option("quote", "")
            .schema("value string").csv(as_list(paths))
        )
    else:
        source = (spark.read.option("lineSep", line_sep) if line_sep else spark.read).text(as_list(paths))
    return source.select(
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("id"),
        # A byte order mark is dropped; other bytes stay as they are, whatever the encoding.
        F.when(F.col("value").startswith("\ufeff"), F.substring("value", 2, 2**31 - 1)).otherwise(F.col("value")).alias("value"),
    )


def _width(line: Column, sep: str) -> Column:
    """Number of fields of a line; separators inside quotes do not count."""
    bare = F.regexp_replace(line, '"[^"]*"', "")
    return F.length(bare) - F.length(F.replace(bare, F.lit(sep), F.lit(""))) + 1


def _quotes(line: Column) -> Column:
    return F.length(line) - F.length(F.replace(line, F.lit('"'), F.lit("")))


def _opens(line: Column) -> Column:
    """Whether a line begins a quoted field that it does not end."""
    return (_quotes(line) % 2 == 1) & line.rlike('(^|[,;\t|:])"')


def file_facts(spark: SparkSession, paths, encoding: str | None = None) -> DataFrame:
    """``path, encoding, multi_line``: one pass; a file with an open quote at a line's end has records of several lines."""
    lines = read_lines(spark, paths, encoding)
    found = F.lit(encoding) if encoding else F.when(F.bool_and(F.is_valid_utf8("value")), "utf-8").otherwise("latin-1")
    return lines.groupBy("path").agg(found.alias("encoding"), F.coalesce(F.bool_or(_opens(F.col("value"))), F.lit(False)).alias("multi_line"))


def _place() -> Column:
    """Where a line stands in its file, as one number, so that aggregates over it can hash."""
    inside = F.col("id").bitwiseAND(F.lit((1 << 33) - 1))
    return F.col("block").cast("decimal(20,0)") * F.lit(1 << 33).cast("decimal(12,0)") + inside.cast("decimal(12,0)")


_PLAIN, _QUOTED, _CLOSING = 0, 1, 2  # outside quotes, inside, and behind a quote that may end the field


def _end_state(line: Column, sep: str, start: int) -> Column:
    """Whether a quoted field is open at the end of a line (1) or not (0), if the line begins in the state ``start``.

    A quote opens a field at the line's start or behind a separator; two in a
    row inside a field are one; any other quote is text.
    """
    pieces = F.split(line, '"', -1)

    def behind(state: Column, i: Column) -> Column:
        text = F.get(pieces, i - 1)  # between the quote before and this one
        opens = F.when(text.endswith(F.lit(sep)), _QUOTED).otherwise(_PLAIN)
        plain = F.when((i == 1) & (text == ""), _QUOTED).otherwise(opens)
        return F.when(state == _QUOTED, _CLOSING).when(state == _PLAIN, plain).when(text == "", _QUOTED).otherwise(opens).cast("int")

    quotes = F.size(pieces) - 1
    end = F.aggregate(F.sequence(F.lit(1), quotes), F.lit(start), behind)
    return F.when(quotes == 0, F.lit(start)).otherwise((end == _QUOTED).cast("int"))


def _records(lines: DataFrame, sep: str | None = None) -> DataFrame:
    """Lines joined to records where a quoted field is open at their end.

    A line takes the state before it to the state behind it: it keeps it, turns
    it over, or sets it. Such steps can be joined in any grouping, so they are
    summed up inside the blocks of a file, which tasks do on their own, and
    from block to block over one row a block. Lines that are records by
    themselves are not moved again. Without ``sep`` every quote counts.
    """
    value = F.col("value")
    if sep is None:
        odd = _quotes(value) % 2
        plain, quoted = odd, 1 - odd
    else:
        plain, quoted = _end_state(value, sep, _PLAIN), _end_state(value, sep, _QUOTED)
    has_quote = value.contains('"')
    marked = lines.withColumns({
        "plain": F.when(has_quote, plain).otherwise(0), "quoted": F.when(has_quote, quoted).otherwise(1),
    })
    inside = Window.partitionBy("path", "block").orderBy("id")
    before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)

    def behind(rows, turned: Column, window, start: Column) -> DataFrame:
        """``after``: the state behind each row. It is what the last row that sets one set, turned over as often as rows since then do."""
        rows = rows.withColumn("turns", F.sum(turned.cast("int")).over(window))
        since = F.when(F.col("plain") == F.col("quoted"), (F.col("plain") + F.col("turns")) % 2)
        return rows.withColumn("set", F.last(since, ignorenulls=True).over(window)).withColumn("after", (F.coalesce("set", start) + F.col("turns")) % 2)

    turned = (F.col("plain") == 1) & (F.col("quoted") == 0)
    each = behind(marked, turned, inside, F.lit(0)).withColumn("fixed", F.col("set").isNotNull())
    # A block as one step: what it ends with from either state.
    blocks = each.groupBy("path", "block").agg(F.max_by("after", "id").alias("plain"), F.max_by("fixed", "id").alias("fixed"))
    blocks = blocks.withColumn("quoted", F.when(F.col("fixed"), F.col("plain")).otherwise(1 - F.col("plain")))
    whole = Window.partitionBy("path").orderBy("block")
    blocks = behind(blocks, turned, whole, F.lit(0))
    start = blocks.select("path", "block", F.coalesce(F.lag("after").over(whole), F.lit(0)).alias("at_start"))
    placed = each.join(start, ["path", "block"]).withColumn("after", F.when(F.col("fixed"), F.col("after")).otherwise((F.col("after") + F.col("at_start")) % 2))
    placed = placed.withColumn("starts", F.coalesce(F.lag("after").over(inside), F.col("at_start")) == 0)
    single = placed.where(F.col("starts") & (F.col("after") == 0)).select("path", "block", "id", "value")
    opened = placed.withColumn("begin", F.last(F.when(F.col("starts"), F.struct("block", "id")), ignorenulls=True).over(inside))
    last = opened.groupBy("path", "block").agg(F.max(F.when(F.col("starts"), F.struct("block", "id"))).alias("last"))
    carried = last.select("path", "block", F.last("last", ignorenulls=True).over(before).alias("carried"))
    named = opened.where(~F.col("starts") | (F.col("after") == 1)).join(carried, ["path", "block"]).withColumn("begin", F.coalesce("begin", "carried"))
    parts = F.array_sort(F.collect_list(F.struct("block", "id", "value")))
    joined = named.groupBy("path", "begin").agg(parts.alias("parts")).select(
        "path", "begin.block", "begin.id", F.array_join(F.transform("parts", lambda p: p["value"]), "\n").alias("value")
    )
    return single.unionByName(joined)


def read_records(spark: SparkSession, paths, encoding: str | None = None, sep: str | None = None) -> DataFrame:
    """As :func:`read_lines`, but lines of one quoted record are one row, at the place of the first."""
    lines = read_lines(spark, paths, encoding)
    facts = file_facts(spark, paths, encoding).where("multi_line").select(F.col("path").alias("__path"))
    if facts.isEmpty():
        return lines
    several = F.broadcast(facts)  # a row for each file, which the driver lists anyway
    same = F.col("path") == F.col("__path")
    return lines.join(several, same, "left_anti").unionByName(_records(lines.join(several, same, "left_semi"), sep))


def detect_encoding(spark: SparkSession, paths) -> DataFrame:
    """``path, encoding``: utf-8 when every line decodes, else latin-1."""
    raw = spark.read.text(as_list(paths)).select(F.col("_metadata.file_path").alias("path"), "value")
    ok = F.bool_and(F.is_valid_utf8("value"))
    return raw.groupBy("path").agg(F.when(ok, "utf-8").otherwise("latin-1").alias("encoding"))


def detect_delimiter(spark: SparkSession, paths, encoding: str | None = None) -> DataFrame:
    """The best separator of each file and how well its lines agree on it.

    ``path, sep, score, column_count, stability, consistent_rows, total_rows``;
    everything after ``path`` is null when no candidate gives two columns.
    """
    lines = read_records(spark, paths, encoding).where(F.length("value") > 0)
    candidates = F.array(*[
        F.struct(F.lit(i).alias("rank"), F.lit(s).alias("sep"), _width(F.col("value"), s).alias("width"))
        for i, s in enumerate(S.DELIMITERS)
    ])
    widths = (
        lines.select("path", _place().alias("key"), F.inline(candidates))
        .groupBy("path", "rank", "sep", "width")
        .agg(F.count(F.lit(1)).alias("cnt"), F.min("key").alias("first"))
    )
    each = Window.partitionBy("path", "rank", "sep")
    whole = each.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    scored = (
        widths.withColumn("total_rows", F.sum("cnt").over(each))
        .withColumn("header", F.min_by("width", "first").over(whole))
        .withColumn("mode", F.max_by("width", F.struct(F.col("cnt"), -F.col("width"))).over(whole))
        .withColumn("column_count", F.when(F.col("header") >= 2, F.col("header")).otherwise(F.col("mode")))
        .where(F.col("width") == F.col("column_count"))
        .withColumn("usable", F.col("column_count") >= 2)
        .withColumn("stability", F.col("cnt") / F.col("total_rows"))
        .withColumn("score", F.col("stability") * 100 + F.col("column_count"))
    )
    best = Window.partitionBy("path").orderBy(F.desc("usable"), F.desc("score"), "rank")
    only = lambda c: F.when(F.col("usable"), F.col(c))
    return scored.withColumn("n", F.row_number().over(best)).where(F.col("n") == 1).select(
        "path", only("sep").alias("sep"), only("score").alias("score"),
        only("column_count").alias("column_count"), only("stability").alias("stability"),
        only("cnt").alias("consistent_rows"), only("total_rows").alias("total_rows"),
    )


def header_lines(spark: SparkSession, paths, encoding: str | None = None) -> DataFrame:
    """``path, header``: the first line of each file, from its first block."""
    first = read_lines(spark, paths, encoding).where(F.col("block") == 0)
    return first.groupBy("path").agg(F.min_by("value", "id").alias("header"))


def malformed_rows(spark: SparkSession, paths, sep: str, examples: int = 5, encoding: str | None = None) -> tuple[DataFrame, DataFrame]:
    """``(counts, sample)`` of records whose width differs from their header's.

    counts: ``path, header_columns, rows, short_rows, long_rows``.
    sample: the first lines per file, ``path, line_number, expected_columns,
    actual_columns, content``. Blank lines are no rows.
    """
    lines = read_lines(spark, paths, encoding)
    records = read_records(spark, paths, encoding, sep)
    rows = records.where(F.length("value") > 0).withColumn("actual_columns", _width(F.col("value"), sep))
    # Lines are counted by width first, so only (file, width) pairs meet the headers.
    widths = rows.groupBy("path", "actual_columns").agg(
        F.count(F.lit(1)).alias("cnt"), F.min(_place()).alias("first")
    )
    expected = widths.groupBy("path").agg(F.min_by("actual_columns", "first").alias("expected_columns"))
    judged = widths.join(expected, "path")
    total = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("cnt"))), F.lit(0))
    counts = judged.groupBy("path").agg(
        F.max("expected_columns").alias("header_columns"),
        (F.sum("cnt") - 1).alias("rows"),
        total(F.col("actual_columns") < F.col("expected_columns")).alias("short_rows"),
        total(F.col("actual_columns") > F.col("expected_columns")).alias("long_rows"),
    )
    # The first lines of each width hold the first lines of every wrong width.
    of_width = Window.partitionBy("path", "actual_columns").orderBy("block", "id")
    order = Window.partitionBy("path").orderBy("block", "id")
    bad = (
        rows.withColumn("n", F.row_number().over(of_width)).where(F.col("n") <= examples)
        .join(expected, "path").where(F.col("actual_columns") != F.col("expected_columns"))
        .withColumn("n", F.row_number().over(order)).where(F.col("n") <= examples)
    )
    # Lines before a block: one row per block of a file.
    blocks = lines.groupBy("path", "block").agg(F.count(F.lit(1)).alias("lines"), F.min("id").alias("first_id"))
    before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = blocks.withColumn("lines_before", F.coalesce(F.sum("lines").over(before), F.lit(0))).drop("lines")
    sample = bad.join(starts, ["path", "block"]).select(
        "path",
        (F.col("lines_before") + F.col("id") - F.col("first_id") + 1).alias("line_number"),
        "expected_columns", "actual_columns", F.substring("value", 1, 100).alias("content"),
    )
    return counts, sample


@dataclass(frozen=True)
class Layout:
    """Files that can be read by one scan."""

    sep: str
    encoding: str
    columns: tuple[str, ...]
    paths: tuple[str, ...] = field(default=())
    multi_line: bool = False


#: The characters that cp1252 has where ISO 8859-1 has control characters, by the rule of the code page.
_CP1252 = {b: c for b in range(0x80, 0xA0) if (c := bytes([b]).decode("cp1252", "ignore"))}


def _is_cp1252(name: str) -> bool:
    return name.lower().replace("_", "-") in ("cp1252", "windows-1252")


def _reader_encoding(name: str) -> str:
    low = name.lower().replace("_", "-")
    return {"latin-1": "iso-8859-1", "cp1252": "iso-8859-1", "windows-1252": "iso-8859-1"}.get(low, low)


def _header_columns(line: str, sep: str, normalize: bool) -> tuple[str, ...]:
    names = next(csv.reader([line], delimiter=sep), [])
    return tuple(normalize_names(names)) if normalize else tuple(names)


def layouts(spark: SparkSession, paths, sep: str | None = None, encoding: str | None = None,
            normalize: bool = True) -> tuple[list[Layout], dict[str, str]]:
    """Files grouped by separator, encoding and header, and the files that have none."""
    facts = header_lines(spark, paths, encoding).join(file_facts(spark, paths, encoding), "path")
    if sep is None:
        facts = facts.join(detect_delimiter(spark, paths, encoding).select("path", "sep"), "path", "left")
    else:
        facts = facts.withColumn("sep", F.lit(sep))
    groups: dict[tuple, list[str]] = {}
    errors: dict[str, str] = {}
    # One row per file: the scans below need the list of files on the driver anyway.
    latin = F.lower("encoding").isin("latin-1", "iso-8859-1", "cp1252", "windows-1252")
    header = F.when(latin, F.decode(F.col("header").cast("binary"), "iso-8859-1")).otherwise(F.col("header"))
    for row in facts.select("path", header.alias("header"), "sep", "encoding", "multi_line").toLocalIterator():
        if not row["sep"]:
            errors[row["path"]] = "no separator gives two columns"
        else:
            line = row["header"].translate(_CP1252) if _is_cp1252(row["encoding"]) else row["header"]
            names = _header_columns(line, row["sep"], normalize)
            groups.setdefault((row["sep"], row["encoding"], names, row["multi_line"]), []).append(unquote(row["path"]))
    return [Layout(s, e, n, tuple(sorted(p)), m) for (s, e, n, m), p in sorted(groups.items())], errors


def _breaks_with_returns(spark: SparkSession, paths) -> list[str]:
    """Files whose lines end with carriage returns alone; no line feed cuts them."""
    lines = read_lines(spark, paths, line_sep="\n").groupBy("path").agg(F.count(F.lit(1)).alias("n"), F.max(F.col("value").rlike(r"\r.")).alias("cr"))
    return [unquote(r["path"]) for r in lines.where("n = 1 AND cr").select("path").toLocalIterator()]


def _quoted_records(spark: SparkSession, layout: Layout, mode: str) -> DataFrame:
    """``layout``'s columns, ``_corrupt_record`` and ``path`` of files with line breaks in quotes, read by as many tasks as they have blocks.

    Lines are cut at line feeds and joined to whole records by :func:`_records`;
    each record is then parsed where it lies.
    """
    lines = read_lines(spark, list(layout.paths), line_sep="\n")
    first = lines.where("block = 0").groupBy("path").agg(F.min("id").alias("header"))  # a row for each file
    records = _records(lines, layout.sep).join(F.broadcast(first), "path")
    # The header is a record of its own, and a line feed may leave a carriage return behind.
    records = records.where((F.col("block") != 0) | (F.col("id") != F.col("header")))
    if _reader_encoding(layout.encoding) != "utf-8":
        records = records.withColumn("value", F.decode(F.col("value").cast("binary"), _reader_encoding(layout.encoding)))
    records = records.withColumn("value", F.regexp_replace("value", r"\r\z", "")).where(F.length("value") > 0)
    fields = [T.StructField(n, T.StringType()) for n in layout.columns]
    options = {"sep": layout.sep, "quote": '"', "escape": '"', "maxCharsPerColumn": "-1"}
    if mode == "strict":
        options["mode"] = "FAILFAST"
    else:
        fields.append(T.StructField(CORRUPT, T.StringType()))
        options |= {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}
    schema = ", ".join(f"{quoted(f.name)} string" for f in fields)
    parsed = records.select(F.from_csv("value", schema, options).alias("r"), "path")
    return parsed.select("r.*", F.col("path").alias("__path"))


def scan(spark: SparkSession, layout: Layout, mode: str = "permissive", null_tokens: Sequence[str] = tuple(S.NULL_TOKENS),
         source_column: str | None = None, multi_line: bool = False) -> DataFrame:
    """One scan of the files of a layout, every column text.

    ``permissive`` skips lines that are too long and pads short ones with nulls;
    ``strict`` fails on the first line of the wrong width. Files with line breaks
    in quotes are read a block in a task like any other. Files of a wide encoding,
    and quoted ones whose lines end with carriage returns alone, are read a file
    in one task, as is a layout with ``multi_line`` asked for.
    """
    if mode not in ("permissive", "strict"):
        raise ValueError("mode must be 'permissive' or 'strict'")
    names = list(layout.columns)
    if layout.multi_line and not multi_line and not _is_wide(layout.encoding):
        whole = set(_breaks_with_returns(spark, list(layout.paths)))
        cut = tuple(p for p in layout.paths if p not in whole)
        parts = []
        if cut:
            records = _quoted_records(spark, replace(layout, paths=cut), mode)
            parts.append(_kept(records, layout, names, mode, null_tokens, F.col("__path").alias(source_column) if source_column else None))
        if whole:
            parts.append(scan(spark, replace(layout, paths=tuple(sorted(whole))), mode, null_tokens, source_column, multi_line=True))
        return reduce(DataFrame.unionByName, parts)
    fields = [T.StructField(n, T.StringType()) for n in names]
    reader = (
        spark.read.option("header", True).option("sep", layout.sep).option("quote", '"').option("escape", '"')
        .option("encoding", _reader_encoding(layout.encoding)).option("multiLine", multi_line or layout.multi_line or _is_wide(layout.encoding))
        # A pruned column would hide lines of the wrong width.
        .option("columnPruning", False)
    )
    paths = list(layout.paths)
    if mode == "strict":
        df = reader.schema(T.StructType(fields)).option("mode", "FAILFAST").csv(paths)
    else:
        schema = T.StructType([*fields, T.StructField(CORRUPT, T.StringType())])
        df = (
            reader.schema(schema).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT).csv(paths)
        )
    source = F.col("_metadata.file_path").alias(source_column) if source_column else None
    return _kept(df, layout, names, mode, null_tokens, source)


def _kept(df: DataFrame, layout: Layout, names: list[str], mode: str, null_tokens: Sequence[str], source: Column | None) -> DataFrame:
    """The rows whose width fits, null tokens as nulls."""
    if mode != "strict":
        broken = F.col(CORRUPT)
        # The test names a data column, because the source refuses to be read
        # for the broken lines alone.
        fits = broken.isNull() | (_width(broken, layout.sep) <= len(names)) | (col(names[0]) == "\u0000")
        df = df.where(fits)
    tokens = list(null_tokens)
    text = {n: col(n) for n in names}
    if _is_cp1252(layout.encoding):
        text = {n: F.translate(c, "".join(map(chr, _CP1252)), "".join(_CP1252.values())) for n, c in text.items()}
    out = [(F.when(~c.isin(tokens), c) if tokens else c).alias(n) for n, c in text.items()]
    return df.select(*out, *([] if source is None else [source]))


_BOOLEANS = ["True", "TRUE", "true", "False", "FALSE", "false"]
_FLOAT = r"^[+-]?([0-9]++(\.[0-9]*+)?|\.[0-9]++)([eE][+-]?[0-9]++)?$"


def infer_types(df: DataFrame, columns=None) -> DataFrame:
    """Cast text columns whose every value is a whole number, number or boolean.

    One aggregate decides for all columns.
    """
    names = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)
             and (columns is None or f.name in as_list(columns))]
    if not names:
        return df
    counts = df.agg(*[
        F.struct(
            F.count(col(n)).alias("n"),
            F.count_if(col(n).rlike(INTEGER) & col(n).try_cast("bigint").isNotNull()).alias("whole"),
            F.count_if(col(n).rlike(_FLOAT)).alias("number"),
            F.count_if(col(n).isin(_BOOLEANS)).alias("flag"),
        ).alias(f"__c{i}")
        for i, n in enumerate(names)
    ]).first()
    casts = {}
    for i, n in enumerate(names):
        c = counts[i]
        if c["n"] == 0:
            continue
        kind = next((t for k, t in (("whole", "bigint"), ("number", "double"), ("flag", "boolean")) if c[k] == c["n"]), None)
        if kind:
            casts[n] = col(n).try_cast(kind)
    return df.withColumns(casts) if casts else df


def read_delimited(spark: SparkSession, paths, sep: str | None = None, encoding: str | None = None,
                   mode: str = "permissive", null_tokens: Sequence[str] = tuple(S.NULL_TOKENS),
                   infer: bool = True, normalize: bool = True, multi_line: bool = False) -> DataFrame:
    """Read delimited files of one layout; what is not given is detected."""
    found, errors = layouts(spark, paths, sep, encoding, normalize)
    if errors:
        path, reason = next(iter(errors.items()))
        raise DelimitedReadError(f"{path}: {reason}")
    if not found:
        raise DelimitedReadError("the source is empty")
    if len({(x.sep, x.encoding, x.columns) for x in found}) > 1:
        raise DelimitedReadError("the files differ in separator, encoding or header; use read_batch")
    # Files of the same layout, with and without records of several lines.
    df = reduce(DataFrame.unionByName, [scan(spark, x, mode, null_tokens, multi_line=multi_line) for x in found])
    return infer_types(df) if infer else df


def read_batch(spark: SparkSession, paths, sep=None, encoding=None, mode="permissive") -> tuple[list[DataFrame], dict[str, str]]:
    """Many files: one DataFrame per layout with a ``source_name`` column, and the failures."""
    found, errors = layouts(spark, paths, sep, encoding)
    return [scan(spark, layout, mode, source_column="source_name") for layout in found], errors


def preview(df: DataFrame, row_key, n: int = 10) -> DataFrame:
    """The first rows."""
    return df.orderBy(*[col(c) for c in as_list(row_key)]).limit(n)
