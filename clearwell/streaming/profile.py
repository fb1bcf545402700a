"""Profiles of data that keeps arriving.

Counts add up over micro-batches, distinct values are kept as mergeable
sketches. Each batch writes its own folder, so a batch that is run again after
a failure replaces its earlier result instead of counting twice.
"""

from __future__ import annotations

from contextlib import contextmanager
from functools import reduce

from pyspark import StorageLevel
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..columns import as_text, col, dtype_label, is_numeric, is_text, percent, present, profiled_fields
from ..functions import trim_space, value_key
from ..operators.cleaning import clean_rows, quarantine_rows
from ..operators.semantics import ColumnType

COLUMNS = "columns"
TABLE = "table"


def batch_columns(df: DataFrame) -> DataFrame:
    """Additive metrics per column, with a sketch of the distinct values."""
    fields = profiled_fields(df)
    aggs, rows = [F.count(F.lit(1)).alias("__rows")], []
    for i, f in enumerate(fields):
        c = present(f)
        aggs += [
            F.count(c).alias(f"__n{i}"),
            (F.count_if(trim_space(c) == "") if is_text(f) else F.lit(0).cast("bigint")).alias(f"__b{i}"),
            F.hll_sketch_agg(value_key(as_text(f)), 14).alias(f"__s{i}"),
        ]
        rows.append(F.struct(
            F.lit(i).alias("position"), F.lit(f.name).alias("column_name"), F.lit(dtype_label(f)).alias("dtype"),
            F.col("__rows").alias("rows"), F.col(f"__n{i}").alias("non_null"),
            F.col(f"__b{i}").alias("blank_count"), F.col(f"__s{i}").alias("sketch"),
        ))
    return df.agg(*aggs).select(F.inline(F.array(*rows)))


def batch_table(df: DataFrame) -> DataFrame:
    fields = profiled_fields(df)
    whole = reduce(lambda a, b: a & b, [present(f).isNotNull() for f in fields], F.lit(True))
    return df.agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(whole).alias("complete_rows"),
        F.lit(len(fields)).cast("bigint").alias("columns"),
    )


@contextmanager
def _read_once(batch: DataFrame):
    """A micro-batch that two sinks need is read and parsed once; lost blocks are read again.

    Its rows are dealt over all cores: a large file of few row groups would keep as few busy.
    """
    dealt = batch.hint("rebalance").persist(StorageLevel.MEMORY_AND_DISK)
    try:
        yield dealt
    finally:
        dealt.unpersist()


def profile_writer(path: str):
    """``foreachBatch`` function that writes the metrics of one micro-batch."""

    def write(batch: DataFrame, batch_id: int) -> None:
        with _read_once(batch) as rows:
            batch_columns(rows).write.mode("overwrite").parquet(f"{path}/{COLUMNS}/batch_id={batch_id}")
            batch_table(rows).write.mode("overwrite").parquet(f"{path}/{TABLE}/batch_id={batch_id}")

    return write


def start_profile(stream: DataFrame, path: str, checkpoint: str, trigger: dict | None = None):
    """Start profiling a stream into ``path``."""
    writer = stream.writeStream.foreachBatch(profile_writer(path)).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def column_totals(spark: SparkSession, path: str) -> DataFrame:
    """Column metrics over all batches so far."""
    parts = spark.read.parquet(f"{path}/{COLUMNS}")
    total = parts.groupBy("position", "column_name", "dtype").agg(
        F.sum("rows").alias("rows"), F.sum("non_null").alias("non_null"), F.sum("blank_count").alias("blank_count"),
        F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("approx_unique"),
    )
    nulls = F.col("rows") - F.col("non_null")
    return total.withColumn("null_count", nulls).withColumn("null_percent", percent(nulls, "rows"))


def table_totals(spark: SparkSession, path: str) -> DataFrame:
    """Table metrics over all batches so far."""
    parts = spark.read.parquet(f"{path}/{TABLE}")
    return parts.agg(
        F.sum("rows").alias("rows"), F.max("columns").alias("columns"), F.sum("complete_rows").alias("complete_rows"),
        F.count(F.lit(1)).alias("batches"),
    ).withColumn("complete_percent", percent("complete_rows", "rows"))


# --- one running state -----------------------------------------------------------------
_STATE = "state"


def batch_state(df: DataFrame) -> DataFrame:
    """A row for each column: counts, blanks, moments and extremes of numbers, sketches of quantiles and of distinct values."""
    fields = profiled_fields(df)
    aggs, rows = [F.count(F.lit(1)).alias("__rows")], []
    whole = reduce(lambda a, b: a & b, [present(f).isNotNull() for f in fields], F.lit(True))
    aggs.append(F.count_if(whole).alias("__complete"))
    for i, f in enumerate(fields):
        c = present(f)
        v = c.cast("double") if is_numeric(f) else F.lit(None).cast("double")
        aggs += [
            F.count(c).alias(f"__n{i}"), (F.count_if(trim_space(c) == "") if is_text(f) else F.lit(0).cast("bigint")).alias(f"__b{i}"),
            F.min(v).alias(f"__low{i}"), F.max(v).alias(f"__high{i}"), F.avg(v).alias(f"__mean{i}"), F.var_pop(v).alias(f"__var{i}"),
            (F.kll_sketch_agg_double(v, 800) if is_numeric(f) else F.lit(None).cast("binary")).alias(f"__q{i}"),
            F.hll_sketch_agg(value_key(as_text(f)), 14).alias(f"__s{i}"),
        ]
        n = F.when(F.lit(is_numeric(f)), F.col(f"__n{i}")).otherwise(F.lit(0))
        rows.append(F.struct(
            F.lit(i).alias("position"), F.lit(f.name).alias("column_name"), F.lit(dtype_label(f)).alias("dtype"),
            F.col("__rows").alias("rows"), F.col("__complete").alias("complete_rows"), F.col(f"__n{i}").alias("non_null"), F.col(f"__b{i}").alias("blank_count"),
            n.cast("bigint").alias("numbers"), F.col(f"__low{i}").alias("min"), F.col(f"__high{i}").alias("max"), F.col(f"__mean{i}").alias("mean"),
            (F.col(f"__var{i}") * F.col(f"__n{i}")).alias("squares"), F.col(f"__q{i}").alias("quantiles"), F.col(f"__s{i}").alias("sketch"),
        ))
    return df.agg(*aggs).select(F.inline(F.array(*rows)))


def merge_states(states: DataFrame) -> DataFrame:
    """The state of all rows from the states of disjoint parts of them, in any order and grouping.

    Means and squared deviations are merged about the common mean, so nothing
    is lost where a mean is large and a spread small.
    """
    keys = ["position", "column_name", "dtype"]
    each = Window.partitionBy(*keys)  # a row for each part
    mean = F.sum(F.col("mean") * F.col("numbers")).over(each) / F.sum("numbers").over(each)
    apart = states.withColumn("__mean", mean).withColumn(
        "__squares", F.col("squares") + F.col("numbers") * (F.col("mean") - F.col("__mean")) * (F.col("mean") - F.col("__mean")))
    total = lambda c: F.sum(c).alias(c)
    # A column that is no number has no sketch of quantiles, and one without numbers an empty one.
    return apart.groupBy(*keys).agg(
        total("rows"), total("complete_rows"), total("non_null"), total("blank_count"), total("numbers"),
        F.min("min").alias("min"), F.max("max").alias("max"), F.max("__mean").alias("mean"), F.sum("__squares").alias("squares"),
        F.kll_merge_agg_double("quantiles").alias("quantiles"), F.hll_union_agg("sketch").alias("sketch"),
    ).select(states.columns)


def _slot(spark: SparkSession, path: str, slot: int) -> tuple[int, DataFrame] | None:
    """The batch that a slot holds the state of, and that state; None where there is none, or a write broke off."""
    try:
        df = spark.read.parquet(f"{path}/{_STATE}/slot={slot}")
        first = df.select("batch_id").first()
    except AnalysisException as error:
        if error.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None
    return (first[0], df.drop("batch_id")) if first else None


def running_writer(path: str):
    """``foreachBatch`` function that keeps one state of all batches so far.

    A batch's state is merged with the one before and written to the slot that
    this one does not lie in, so two small folders are all there ever is, however
    many batches come. A batch that is run again starts from the state before it.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        found = [s for s in (_slot(spark, path, i) for i in (0, 1)) if s and s[0] < batch_id]
        state = batch_state(batch)
        if found:
            state = merge_states(max(found, key=lambda s: s[0])[1].unionByName(state))
        state.withColumn("batch_id", F.lit(batch_id).cast("bigint")).coalesce(1).write.mode("overwrite").parquet(f"{path}/{_STATE}/slot={batch_id % 2}")

    return write


def start_running_profile(stream: DataFrame, path: str, checkpoint: str, trigger: dict | None = None):
    """Start keeping the running state of a stream in ``path``."""
    writer = stream.writeStream.foreachBatch(running_writer(path)).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def running_totals(spark: SparkSession, path: str) -> DataFrame:
    """Column metrics over all batches so far: counts, extremes, mean, deviation, approximate median and distinct values."""
    found = [s for s in (_slot(spark, path, i) for i in (0, 1)) if s]
    if not found:
        raise ValueError(f"no batch was profiled into {path}")
    state = max(found, key=lambda s: s[0])[1]
    nulls = F.col("rows") - F.col("non_null")
    return state.select(
        "position", "column_name", "dtype", "rows", "complete_rows", "non_null", nulls.alias("null_count"), percent(nulls, "rows").alias("null_percent"),
        "blank_count", "min", "max", "mean", F.when(F.col("numbers") > 1, F.sqrt(F.col("squares") / (F.col("numbers") - 1))).alias("std"),
        F.when(F.col("numbers") > 0, F.kll_sketch_get_quantile_double("quantiles", F.lit(0.5))).alias("approx_median"),
        F.hll_sketch_estimate("sketch").alias("approx_unique"),
    )


def without_repeats(stream: DataFrame, columns=None, event_time: str | None = None, delay: str | None = None) -> DataFrame:
    """Drop rows seen before.

    The state holds a SHA-256 of the compared values, 64 characters for each
    distinct row. With an event time, which needs a ``delay``, the watermark
    bounds it, and repeats further apart than the delay are let through;
    without one every distinct row is remembered, spread over the partitions.
    """
    if event_time and not delay:
        raise ValueError("an event time needs a delay: how late a repeat may come")
    fields = profiled_fields(stream, columns)
    values = F.struct(*[as_text(f).alias(f"v{i}") for i, f in enumerate(fields)])
    keyed = stream.withColumn("__seen", F.sha2(F.to_json(values, {"ignoreNullFields": "false"}), 256))
    if event_time:
        return keyed.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(["__seen"]).drop("__seen")
    return keyed.dropDuplicates(["__seen"]).drop("__seen")


def start_clean(stream: DataFrame, types: list[ColumnType], clean_path: str, quarantine_path: str, checkpoint: str,
                trigger: dict | None = None):
    """Split a stream into clean and quarantined rows; a repeated batch overwrites its own folder."""

    def write(batch: DataFrame, batch_id: int) -> None:
        with _read_once(batch) as rows:
            clean_rows(rows, types).write.mode("overwrite").parquet(f"{clean_path}/batch_id={batch_id}")
            quarantine_rows(rows, types).write.mode("overwrite").parquet(f"{quarantine_path}/batch_id={batch_id}")

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def file_stream(spark: SparkSession, path: str, schema: T.StructType, files_per_batch: int | None = None,
                format: str = "parquet") -> DataFrame:
    """A folder that files keep arriving in."""
    reader = spark.readStream.schema(schema).format(format)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(path)
