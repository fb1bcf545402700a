"""Writing reports, and clean and quarantine tables."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..columns import as_list, col, is_text
from ..operators.cleaning import business_keys

_MODES = {"APPEND": "append", "REPLACE": "overwrite"}


def load_mode(strategy: str) -> str:
    """Writer mode of a load strategy; REPLACE empties the tables first."""
    try:
        return _MODES[str(strategy).strip().upper()]
    except KeyError:
        raise ValueError("the load strategy must be APPEND or REPLACE") from None


def write_pair(clean: DataFrame, quarantine: DataFrame, clean_path: str, quarantine_path: str,
               strategy: str = "REPLACE", format: str = "parquet") -> None:
    """Write both outputs; clean files are sorted by their business keys for skipping."""
    mode = load_mode(strategy)
    keys = business_keys(clean)
    laid_out = clean.sortWithinPartitions(*[col(k) for k in keys]) if keys else clean
    laid_out.write.mode(mode).format(format).save(clean_path)
    quarantine.write.mode(mode).format(format).save(quarantine_path)


#: One row for each load that took place.
_LOADS = "version long, run_id string, clean array<string>, quarantine array<string>"


def _head(spark: SparkSession, root: str):
    """The rows of the latest load and of all loads, as a DataFrame; None where nothing was loaded."""
    try:
        loads = spark.read.schema(_LOADS).parquet(f"{root}/loads")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None, None
    return loads.orderBy(F.desc("version"), "run_id").first(), loads


def commit_pair(clean: DataFrame, quarantine: DataFrame, root: str, strategy: str = "REPLACE", run_id: str | None = None) -> int:
    """Load both outputs so that readers see both new ones or neither; the number of the load.

    Both are staged in folders of their own under ``root``. Then one row that
    names all folders of either table is added to the ``loads`` table: a single
    file, which the file system's rename makes visible at once. A load that
    fails before leaves the tables as they were, and one that is run again
    under its ``run_id`` after it took place does nothing. ``REPLACE`` leaves
    earlier folders to readers that began before. One loader at a time.
    """
    mode = load_mode(strategy)
    spark = clean.sparkSession
    last, loads = _head(spark, root)
    if run_id is not None and loads is not None:
        done = loads.where(F.col("run_id") == run_id).select("version").first()
        if done:
            return done[0]
    name = uuid.uuid4().hex
    staged = {part: f"{root}/{part}/{name}" for part in ("clean", "quarantine")}
    write_pair(clean, quarantine, *staged.values(), "APPEND")
    before = {part: last[part] if last and mode == "append" else [] for part in staged}
    row = (last["version"] + 1 if last else 1, run_id or name, *[[*before[part], staged[part]] for part in staged])
    spark.createDataFrame([row], _LOADS).coalesce(1).write.mode("append").parquet(f"{root}/loads")
    return row[0]


def read_pair(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """The clean and quarantine tables as the latest load left them."""
    last, _ = _head(spark, root)
    if last is None:
        raise ValueError(f"nothing was loaded into {root}")
    return spark.read.parquet(*last["clean"]), spark.read.parquet(*last["quarantine"])


def save_pair(clean: DataFrame, quarantine: DataFrame, clean_table: str, quarantine_table: str,
              strategy: str = "REPLACE", buckets: int | None = None) -> None:
    """The same as catalog tables; with ``buckets`` joins on the business keys need no shuffle."""
    mode = load_mode(strategy)
    keys = business_keys(clean)
    writer = clean.write.mode(mode)
    if buckets and keys:
        writer = writer.bucketBy(buckets, *keys).sortBy(*keys)
    writer.saveAsTable(clean_table)
    quarantine.write.mode(mode).saveAsTable(quarantine_table)


FILE_BYTES = 128 << 20  # of values before they are encoded, which a task sorts for a file of a clustered table

_BITS = 6  # of the place of a value among the quantiles of its key


def _ordered(field) -> Column:
    """A number that grows with a value: the value itself, or the first bytes of a text."""
    c = col(field.name)
    if is_text(field):
        head = F.rpad(F.hex(F.substring(c.cast("binary"), 1, 7)), 14, "0")
        return F.when(c.isNotNull(), F.conv(head, 16, 10).cast("double"))
    if isinstance(field.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return F.unix_micros(c.cast("timestamp")).cast("double")
    return c.cast("double")


def _width(field) -> Column:
    """About the bytes of a value in a row."""
    c = col(field.name)
    if isinstance(field.dataType, (T.NumericType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)):
        return F.lit(8).cast("bigint")
    return F.coalesce(F.octet_length(c if isinstance(field.dataType, T.BinaryType) else c.cast("string")), F.lit(0)).cast("bigint") + 16


def _curve(places: list[Column], bits: int) -> Column:
    """The bits of several places in turn, highest first: rows near in every key are near in this number."""
    z = F.lit(0).cast("bigint")
    for bit in reversed(range(bits)):
        for place in places:
            z = F.shiftleft(z, 1) + F.shiftright(place, bit).bitwiseAND(1)
    return z


def write_clustered(df: DataFrame, path: str, keys=None, files: int | None = None, mode: str = "overwrite",
                    row_group: int = 64 << 20, page_rows: int = 20_000, file_bytes: int = FILE_BYTES) -> None:
    """Write rows so that a condition on any one of several keys reads few files, row groups and pages.

    Each key is cut at its quantiles (one aggregate finds them for all keys),
    and rows are dealt by ranges of the places' interleaved bits; the hash of a
    row and its place divides places that hold too much, so a value of a third of all rows
    fills many files like any other rows. Inside a file rows are sorted, and
    Parquet keeps the least and greatest value of each row group and page.
    ``keys`` are the business keys by default; nulls come first. There are
    ``files`` files, or more where one would hold over ``file_bytes`` of values,
    as a task sorts what it writes to a file.
    """
    keys = as_list(keys) or business_keys(df)
    if not keys:
        raise ValueError("the table has no business key; name the keys")
    fields = {f.name: f for f in df.schema.fields}
    if unknown := [k for k in keys if k not in fields]:
        raise ValueError(f"unknown columns: {unknown}")
    cuts = [i / (1 << _BITS) for i in range(1, 1 << _BITS)]
    size = F.sum(reduce(lambda a, b: a + b, [_width(f) for f in fields.values()])).alias("size")
    bounds = df.agg(*[F.percentile_approx(_ordered(fields[k]), cuts, 10_000).alias(f"q{i}") for i, k in enumerate(keys)], size).first()
    needed = -(-(bounds["size"] or 0) // file_bytes)
    if files or needed > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        files = max(files or 1, needed)
    places = []
    for i, key in enumerate(keys):
        cut = sorted(set(bounds[i] or []))
        passed = reduce(lambda a, b: a + b, [(_ordered(fields[key]) >= F.lit(float(b))).cast("bigint") for b in cut], F.lit(0).cast("bigint"))
        # Few different values are spread over all bits.
        places.append(F.coalesce(F.floor(passed * F.lit(((1 << _BITS) - 1) / max(len(cut), 1))).cast("bigint"), F.lit(0).cast("bigint")))
    dealt = df.withColumns({"__curve": _curve(places, _BITS), "__row": F.xxhash64(*[col(c) for c in df.columns], F.monotonically_increasing_id())})
    order = ["__curve", *[col(k) for k in keys], "__row"]
    ranged = dealt.repartitionByRange(files, *order) if files else dealt.repartitionByRange(*order)
    laid_out = ranged.sortWithinPartitions(*order).drop("__curve", "__row")
    laid_out.write.mode(mode).option("parquet.block.size", row_group).option("parquet.page.row.count.limit", page_rows).parquet(path)


def files_to_read(spark: SparkSession, path: str, column: str, values: DataFrame) -> DataFrame:
    """``value, files, of``: for each value of the one column of ``values`` how many of a table's files can hold it, by their ranges."""
    table = spark.read.parquet(path)
    ranges = table.groupBy(F.col("_metadata.file_path").alias("file")).agg(F.min(col(column)).alias("low"), F.max(col(column)).alias("high"))
    wanted = values.toDF("value").distinct()
    total = ranges.agg(F.count(F.lit(1)).alias("of"))
    # A row for each file, which the driver lists anyway.
    held = wanted.join(F.broadcast(ranges), F.col("value").between(F.col("low"), F.col("high")), "left").groupBy("value").agg(F.count("file").alias("files"))
    return held.crossJoin(F.broadcast(total))  # one row


def export_csv(df: DataFrame, path: str) -> None:
    """A small report as CSV with a header."""
    df.write.mode("overwrite").option("header", True).csv(path)


def write_report(tables: dict[str, DataFrame], path: str, run_id: str) -> None:
    """One folder per section, one partition per run; earlier runs stay."""
    for name, df in tables.items():
        (
            df.withColumn("run_id", F.lit(run_id)).write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic").partitionBy("run_id").parquet(f"{path}/{name}")
        )
