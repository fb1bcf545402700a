"""Delimited text, sinks and streams, on files Spark writes from the whole tables."""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from clearwell.operators import cleaning as C
from clearwell.operators import semantics as M
from clearwell.plans import analysis as A
from clearwell.plans.report import report_tables
from clearwell.runtime import scratch_path
from clearwell.sources import delimited as I
from clearwell.sources import names, sinks, tables
from clearwell.streaming import profile as T

from .registry import SCHEMAS, big, query, r6, source, sql_boolean, sql_parse, union_columns, with_source


def _written(spark, df, label, **options):
    path = scratch_path(spark, label)
    df.write.options(header=True, **options).csv(path)
    return path


# --- reading -------------------------------------------------------------------------------

@query("SELECT c_custkey, c_name, CAST(c_nationkey AS BIGINT) AS c_nationkey, c_acctbal, c_mktsegment FROM customer")
def read_delimited(spark, d):
    """Separator, encoding and types are all found again."""
    return I.read_delimited(spark, _written(spark, source(spark, d, "customer"), "customer", sep=";"))


@query("""SELECT ';' AS sep, CAST(5 AS INTEGER) AS column_count, count(*) AS data_rows, CAST(1 AS DOUBLE) AS stability FROM customer
UNION ALL SELECT '|', 6, count(*), 1.0 FROM orders UNION ALL SELECT chr(9), 4, count(*), 1.0 FROM supplier""")
def detect_delimiter(spark, d):
    paths = [
        _written(spark, source(spark, d, "customer"), "semicolons", sep=";"),
        _written(spark, source(spark, d, "orders"), "bars", sep="|"),
        _written(spark, source(spark, d, "supplier"), "tabs", sep="\t"),
    ]
    # Each file has a header of its own, which is no data row.
    return I.detect_delimiter(spark, paths).groupBy("sep", "column_count").agg(
        (F.sum("total_rows") - F.count(F.lit(1))).alias("data_rows"), F.min("stability").alias("stability"))


@query("""SELECT 'latin-1' AS encoding, count(*) AS lines FROM documents UNION ALL SELECT 'utf-8', count(*) FROM documents""")
def detect_encoding(spark, d):
    """Accented text written in two encodings is told apart file by file."""
    flat = F.concat(F.lit("né "), F.regexp_replace("text", r"[\r\n]+", " "))
    df = source(spark, d, "documents").select("doc_id", flat.alias("text"), "lang", "source")
    paths = [_written(spark, df, "latin", encoding="iso-8859-1"), _written(spark, df, "utf8", encoding="utf-8")]
    found = I.detect_encoding(spark, paths)
    lines = I.read_lines(spark, paths).groupBy("path").agg((F.count(F.lit(1)) - 1).alias("n"))
    return found.join(lines, "path").groupBy("encoding").agg(F.sum("n").alias("lines"))


@query("SELECT doc_id, md5(text) AS digest, lang, source, n_chars FROM documents")
def read_quoted_lines(spark, d):
    """Whole texts, with their quotes and line breaks, come back as they were."""
    path = _written(spark, source(spark, d, "documents"), "texts", escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    read = I.read_delimited(spark, path, sep=",", infer=False)
    return read.select(F.col("doc_id").cast("bigint"), F.md5("text").alias("digest"), "lang", "source", F.col("n_chars").cast("bigint"))


@query("SELECT count(*) AS rows, CAST(0 AS BIGINT) AS short_rows, CAST(0 AS BIGINT) AS long_rows FROM documents")
def quoted_lines_are_whole(spark, d):
    """Records of several lines are no broken rows."""
    path = _written(spark, source(spark, d, "documents"), "texts", escape='"')
    counts, _ = I.malformed_rows(spark, path, ",")
    return counts.agg(*[F.sum(c).alias(c) for c in ("rows", "short_rows", "long_rows")])


@query("SELECT count(*) AS good_rows, true AS broken_fails FROM orders")
def strict_mode(spark, d):
    """A strict read loads every line of a sound file and fails on lines of the wrong width."""
    good = I.read_delimited(spark, _written(spark, source(spark, d, "orders"), "sound"), sep=",", mode="strict")
    try:
        I.read_delimited(spark, _broken(spark, d), sep=",", mode="strict").write.format("noop").mode("overwrite").save()
        fails = False
    except (PySparkException, Py4JJavaError):
        fails = True
    return good.agg(F.count(F.lit(1)).alias("good_rows"), F.lit(fails).alias("broken_fails"))


def _broken(spark, d):
    """Orders as text; a priority with a bare separator makes the line too long."""
    extra = F.when(F.col("o_orderkey") % 10 == 0, F.concat("o_orderpriority", F.lit(",extra"))).otherwise(F.col("o_orderpriority"))
    df = source(spark, d, "orders").select("o_orderkey", "o_orderstatus", extra.alias("o_orderpriority"))
    return _written(spark, df, "broken", quote="")


@query("SELECT count(*) AS rows, CAST(0 AS BIGINT) AS short_rows, CAST(count(*) FILTER (o_orderkey % 10 = 0) AS BIGINT) AS long_rows FROM orders")
def malformed_rows(spark, d):
    counts, _ = I.malformed_rows(spark, _broken(spark, d), ",")
    return counts.agg(*[F.sum(c).alias(c) for c in ("rows", "short_rows", "long_rows")])


@query("SELECT o_orderkey, o_orderstatus, o_orderpriority FROM orders WHERE o_orderkey % 10 <> 0")
def read_permissive(spark, d):
    """Lines that are too long are skipped, all others are loaded."""
    return I.read_delimited(spark, _broken(spark, d), sep=",")


@query("""SELECT count(*) AS lines, CAST(min(expected) AS INTEGER) AS expected_columns, 4 AS actual_columns FROM (
SELECT 3 AS expected FROM orders WHERE o_orderkey % 10 = 0 ORDER BY o_orderkey LIMIT 5)""")
def malformed_sample(spark, d):
    """The five sample lines of a single-file source."""
    path = _broken(spark, d)
    _, sample = I.malformed_rows(spark, path, ",")
    first = sample.groupBy("path").agg(F.count(F.lit(1)).alias("lines"), F.max("expected_columns").alias("expected_columns"),
                                       F.max("actual_columns").alias("actual_columns"))
    return first.agg(F.max("lines").alias("lines"), F.max("expected_columns").alias("expected_columns"), F.max("actual_columns").alias("actual_columns"))


@query("""SELECT part, line AS line_number, 4 AS expected_columns, 5 AS actual_columns, content FROM (
SELECT *, row_number() OVER (PARTITION BY part ORDER BY line) AS n FROM (
SELECT o_orderkey % 10 AS last, CAST(o_orderkey // 4000 AS BIGINT) AS part, row_number() OVER (PARTITION BY o_orderkey // 4000 ORDER BY o_orderkey) + 1 AS line,
       concat_ws(',', o_orderkey, o_orderstatus, o_orderpriority, 'x,y') AS content FROM orders) WHERE last = 0) WHERE n <= 5""")
def export_bad_lines(spark, d):
    """The first broken lines of each file, with their numbers and contents, exported as CSV and read back."""
    part = F.floor(F.col("o_orderkey") / 4000)
    tail = F.when(F.col("o_orderkey") % 10 == 0, "x,y").otherwise("x")
    line = F.concat_ws(",", "o_orderkey", "o_orderstatus", "o_orderpriority", tail).alias("o_orderkey,o_orderstatus,o_orderpriority,mark")
    df = source(spark, d, "orders").select("o_orderkey", part.alias("part"), line)
    path = scratch_path(spark, "numbered")
    ordered = df.repartition("part").sortWithinPartitions("part", "o_orderkey").drop("o_orderkey")
    ordered.write.partitionBy("part").options(header=True, sep="\u0001", quote="").csv(path)
    _, sample = I.malformed_rows(spark, path, ",")
    out = scratch_path(spark, "bad-lines")
    sinks.export_csv(sample.withColumn("part", F.regexp_extract("path", "part=([0-9]+)", 1).cast("bigint")).drop("path"), out)
    return spark.read.csv(out, header=True, schema="line_number bigint, expected_columns int, actual_columns int, content string, part bigint")


@query("SELECT 'loaded' AS state, CAST(5 AS BIGINT) AS columns, count(*) AS rows FROM customer UNION ALL SELECT 'loaded', 4, count(*) FROM supplier "
       "UNION ALL SELECT 'no separator gives two columns', 1, count(*) FROM part")
def read_batch_failures(spark, d):
    """A source without a separator in the middle of a batch is named as a failure; the others are loaded."""
    paths = {
        "a": _written(spark, source(spark, d, "customer"), "a", sep=";"),
        "odd": _written(spark, source(spark, d, "part").select("p_partkey").repartition(1), "odd"),
        "b": _written(spark, source(spark, d, "supplier"), "b", sep="|"),
    }
    frames, failures = I.read_batch(spark, list(paths.values()))
    rows = [f.agg(F.lit("loaded").alias("state"), F.lit(len(f.columns) - 1).cast("bigint").alias("columns"), F.count(F.lit(1)).alias("rows")) for f in frames]
    for path, reason in failures.items():
        lines = I.read_lines(spark, path)
        rows.append(lines.agg(F.lit(reason).alias("state"), F.lit(1).cast("bigint").alias("columns"), (F.count(F.lit(1)) - 1).alias("rows")))
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


@query("SELECT doc_id, md5(text) AS digest, lang, source, n_chars FROM documents")
def read_quoted_strict(spark, d):
    """Quoted line breaks in strict mode, cut into blocks like any other file."""
    path = _written(spark, source(spark, d, "documents"), "texts", escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    read = I.read_delimited(spark, path, sep=",", infer=False, mode="strict")
    return read.select(F.col("doc_id").cast("bigint"), F.md5("text").alias("digest"), "lang", "source", F.col("n_chars").cast("bigint"))


@query("""SELECT CAST(count(*) FILTER (p_partkey % 3 = 0) AS BIGINT) AS null_names, CAST(count(*) FILTER (p_partkey % 5 = 0) AS BIGINT) AS null_brands, count(*) AS rows FROM part""")
def null_tokens(spark, d):
    df = source(spark, d, "part").select(
        "p_partkey", F.when(F.col("p_partkey") % 3 == 0, "N/A").otherwise(F.col("p_name")).alias("name"),
        F.when(F.col("p_partkey") % 5 == 0, "null").otherwise(F.col("p_brand")).alias("brand"))
    read = I.read_delimited(spark, _written(spark, df, "tokens"))
    return read.agg(F.count_if(F.col("name").isNull()).alias("null_names"), F.count_if(F.col("brand").isNull()).alias("null_brands"), F.count(F.lit(1)).alias("rows"))


@query("SELECT n_nationkey AS _1_key, n_name AS n_name, n_regionkey AS n_name_2 FROM nation")
def normalize_columns(spark, d):
    return names.normalize_columns(source(spark, d, "nation").toDF("1 key!", " n name", "n name "))


@query("SELECT n AS columns, CAST(sum(rows) AS BIGINT) AS rows FROM (SELECT 5 AS n, count(*) AS rows FROM customer UNION ALL SELECT 4, count(*) FROM supplier) GROUP BY n")
def read_batch(spark, d):
    """Files of two layouts become two scans; nothing stops at the odd one."""
    paths = [_written(spark, source(spark, d, "customer"), "a", sep=";"), _written(spark, source(spark, d, "supplier"), "b", sep="|")]
    frames, _ = I.read_batch(spark, paths)
    counts = [f.agg(F.lit(len(f.columns) - 1).alias("columns"), F.count(F.lit(1)).alias("rows")) for f in frames]
    return counts[0].unionByName(counts[1])


@query("SELECT * FROM orders ORDER BY o_orderkey LIMIT 10")
def preview(spark, d):
    return I.preview(source(spark, d, "orders"), "o_orderkey")


@query("SELECT count(*) AS rows, count(*) AS keys FROM lineitem")
def row_keys(spark, d):
    keyed = tables.with_row_key(tables.read_table(spark, f"{d}/lineitem.parquet"))
    return keyed.agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("row_key").alias("keys"))


# --- writing -------------------------------------------------------------------------------
_S, _E = sql_parse("fecha_inicio"), sql_parse("fecha_fin")
_OK = f"""(fecha_inicio IS NULL OR {_S} IS NOT NULL) AND (fecha_fin IS NULL OR {_E} IS NOT NULL) AND coalesce({_E} >= {_S}, true)
AND (activo IS NULL OR {sql_boolean('activo')} IS NOT NULL)"""
_KINDS = {"fecha_inicio": M.DATE, "fecha_fin": M.DATE, "activo": M.BOOLEAN}


def _types(df):
    return [M.ColumnType(c, _KINDS.get(c, M.TEXT)) for c in df.columns]


@query(with_source("dirty_orders", f"SELECT 'REPLACE' AS strategy, {big(f'count(*) FILTER ({_OK})')} AS clean_rows, {big(f'count(*) FILTER (NOT ({_OK}))')} AS rejected_rows FROM v "
       f"UNION ALL SELECT 'APPEND', {big(f'2 * count(*) FILTER ({_OK})')}, {big(f'2 * count(*) FILTER (NOT ({_OK}))')} FROM v"))
def write_pair(spark, d):
    """Both outputs written, replaced, then appended to, and read back."""
    df = source(spark, d, "dirty_orders")
    clean, rejected = C.clean_and_quarantine(df, _types(df))
    a, b = scratch_path(spark, "clean"), scratch_path(spark, "quarantine")

    def state(label):
        """What is on disk now; a rejected row has one entry for each of its columns that failed."""
        here = f"{a}-{label}", f"{b}-{label}"
        spark.read.parquet(a).write.parquet(here[0])
        spark.read.parquet(b).write.parquet(here[1])
        kept = spark.read.parquet(here[0]).agg(F.count(F.lit(1)).alias("clean_rows"))
        entries = spark.read.parquet(here[1]).groupBy("row_json").agg(F.count(F.lit(1)).alias("entries"), F.countDistinct("column_name").alias("columns"))
        rows = entries.agg(F.coalesce(F.sum(F.col("entries") / F.col("columns")), F.lit(0)).cast("bigint").alias("rejected_rows"))
        return kept.crossJoin(rows).select(F.lit(label).alias("strategy"), "clean_rows", "rejected_rows")  # one row each

    sinks.write_pair(clean, rejected, a, b)
    sinks.write_pair(clean, rejected, a, b, "REPLACE")
    first = state("REPLACE")
    sinks.write_pair(clean, rejected, a, b, "append")
    return first.unionByName(state("APPEND"))


@query(with_source("dirty_orders", f"SELECT 'first' AS step, 1 AS version, {big(f'count(*) FILTER ({_OK})')} AS clean_rows, {big(f'count(*) FILTER (NOT ({_OK}))')} AS rejected_rows FROM v "
       f"UNION ALL SELECT 'broken', 1, {big(f'count(*) FILTER ({_OK})')}, {big(f'count(*) FILTER (NOT ({_OK}))')} FROM v "
       f"UNION ALL SELECT 'again', 2, {big(f'2 * count(*) FILTER ({_OK})')}, {big(f'2 * count(*) FILTER (NOT ({_OK}))')} FROM v"))
def commit_pair(spark, d):
    """A load whose second write breaks leaves both tables as they were; the same run loaded twice counts once."""
    df = source(spark, d, "dirty_orders")
    clean, rejected = C.clean_and_quarantine(df, _types(df))
    rejected = rejected.select("row_json", "column_name")
    root = scratch_path(spark, "pair")

    def state(step, version):
        good, bad = sinks.read_pair(spark, root)
        entries = bad.groupBy("row_json").agg(F.count(F.lit(1)).alias("entries"), F.countDistinct("column_name").alias("columns"))
        rows = entries.agg(F.coalesce(F.sum(F.col("entries") / F.col("columns")), F.lit(0)).cast("bigint").alias("rejected_rows"))
        kept = good.agg(F.count(F.lit(1)).alias("clean_rows"))
        return kept.crossJoin(rows).select(F.lit(step).alias("step"), F.lit(version).alias("version"), "clean_rows", "rejected_rows")  # one row each

    steps = [state("first", sinks.commit_pair(clean, rejected, root, run_id="a"))]
    broken = rejected.withColumn("row_json", F.when(F.col("row_json").isNotNull(), F.raise_error(F.lit("disk full"))).otherwise(F.col("row_json")).cast("string"))
    try:
        version = sinks.commit_pair(clean.limit(1), broken, root, "REPLACE", run_id="b")
    except (PySparkException, Py4JJavaError):
        version = 1
    steps.append(state("broken", version))
    sinks.commit_pair(clean, rejected, root, "APPEND", run_id="c")
    steps.append(state("again", sinks.commit_pair(clean, rejected, root, "APPEND", run_id="c")))
    return steps[0].unionByName(steps[1]).unionByName(steps[2])


@query("SELECT count(*) AS rows, count(DISTINCT o_custkey) AS keys, CAST(8 AS BIGINT) AS buckets FROM orders")
def bucketed_table(spark, d):
    """Saved as a catalog table with buckets on the business key."""
    name = f"orders_{spark.sparkContext.applicationId.replace('-', '_')}"
    df = source(spark, d, "orders").withColumnRenamed("o_custkey", "customer_id")
    sinks.save_pair(df, df.where("false"), f"{name}_clean", f"{name}_bad", buckets=8)
    saved = spark.table(f"{name}_clean")
    counts = saved.groupBy("customer_id").agg(F.count(F.lit(1)).alias("n"))
    buckets = [r["data_type"] for r in spark.sql(f"DESCRIBE EXTENDED {name}_clean").collect() if r["col_name"] == "Num Buckets"]
    return counts.agg(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("keys"), F.lit(int(buckets[0])).cast("bigint").alias("buckets"))


@query("SELECT 'l_partkey' AS key, count(*) AS rows, count(DISTINCT l_partkey) AS keys, true AS few_files FROM lineitem "
       "UNION ALL SELECT 'l_shipdate', count(*), count(DISTINCT l_shipdate), true FROM lineitem "
       "UNION ALL SELECT 'l_returnflag', count(*), count(DISTINCT l_returnflag), true FROM lineitem")
def clustered_table(spark, d):
    """A table laid out by three keys at once: a value of a selective key can lie in less than half of the files (32, or more of a large table), and no row is lost."""
    df = source(spark, d, "lineitem")
    path = scratch_path(spark, "clustered")
    keys = ["l_partkey", "l_shipdate", "l_returnflag"]
    sinks.write_clustered(df, path, keys, files=32)
    read = spark.read.parquet(path)
    rows = []
    for key, share in zip(keys, (0.5, 0.5, 0.8), strict=True):
        held = sinks.files_to_read(spark, path, key, read.select(key))
        found = held.agg(F.count(F.lit(1)).alias("keys"), (F.avg(F.col("files") / F.col("of")) < share).alias("few_files"))
        rows.append(read.agg(F.lit(key).alias("key"), F.count(F.lit(1)).alias("rows")).crossJoin(found))  # one row each
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


@query("SELECT 'run-1' AS run_id, count(*) AS columns FROM (" + union_columns("dirty_nulls", "SELECT '{c}' AS c FROM (SELECT count(*) FROM part)") + ") UNION ALL SELECT 'run-2', count(*) FROM ("
       + union_columns("dirty_nulls", "SELECT '{c}' AS c FROM (SELECT count(*) FROM part)") + ")")
def report_sink(spark, d):
    """Two runs of a report side by side, partitioned by run."""
    from clearwell.operators.profile import null_profile
    path = scratch_path(spark, "report")
    section = {"nulls": null_profile(source(spark, d, "dirty_nulls"))}
    for run in ("run-1", "run-2", "run-1"):
        sinks.write_report(section, path, run)
    return spark.read.parquet(f"{path}/nulls").groupBy("run_id").agg(F.count(F.lit(1)).alias("columns"))


@query("SELECT 'nation' AS source_name, count(*) AS rows FROM nation UNION ALL SELECT 'customer', count(*) FROM customer")
def batch_summary_csv(spark, d):
    path = scratch_path(spark, "summary")
    sinks.export_csv(A.summarize_batch(spark, {n: source(spark, d, n) for n in ("nation", "customer")}), path)
    return spark.read.csv(path, header=True, schema=A.SUMMARY_COLUMNS).select("source_name", "rows")


@query("SELECT section FROM (SELECT unnest(['summary', 'general_info', 'nulls', 'rows_and_utilization', 'row_completeness', 'duplicates', 'column_profile', "
       "'validations', 'cleaning', 'database_rules', 'normalization', 'quality', 'filters', 'issues']) AS section FROM (SELECT count(*) AS n FROM customer) WHERE n > 0)")
def report_sections(spark, d):
    """Every section has at least one row."""
    found = report_tables(A.analyze(source(spark, d, "dirty_customer")))
    parts = [df.select(F.lit(name).alias("section")).distinct() for name, df in found.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# --- streams ---------------------------------------------------------------------------------

def _drops(spark, df, label):
    """The table as files that arrive one after the other."""
    path = scratch_path(spark, label)
    df.repartition(4).write.parquet(path)
    return path


def _run(stream_query):
    stream_query.awaitTermination()
    if stream_query.exception():
        raise stream_query.exception()


@query(with_source("events", union_columns("events", """
SELECT {i} AS position, '{c}' AS column_name, count(*) AS rows, count({c}) AS non_null, count(*) - count({c}) AS null_count,
       CAST(count(*) FILTER (trim(CAST({c} AS VARCHAR)) = '') AS BIGINT) AS blank_count FROM v""")))
def incremental_profile(spark, d):
    """Metrics of micro-batches add up to those of the whole table."""
    df = source(spark, d, "events")
    out = scratch_path(spark, "stream-profile")
    stream = T.file_stream(spark, _drops(spark, df, "events"), df.schema, files_per_batch=1)
    _run(T.start_profile(stream, out, scratch_path(spark, "checkpoint")))
    return T.column_totals(spark, out).select("position", "column_name", "rows", "non_null", "null_count", "blank_count")


@query("SELECT count(*) AS rows, CAST(6 AS BIGINT) AS columns, count(*) AS complete_rows, CAST(100 AS DOUBLE) AS complete_percent FROM events")
def incremental_table(spark, d):
    df = source(spark, d, "events")
    out = scratch_path(spark, "stream-profile")
    stream = T.file_stream(spark, _drops(spark, df, "events"), df.schema, files_per_batch=1)
    _run(T.start_profile(stream, out, scratch_path(spark, "checkpoint")))
    return r6(T.table_totals(spark, out), "complete_percent").drop("batches")


_MOMENTS = """SELECT {i} AS position, '{c}' AS column_name, count(*) AS rows, count(*) - count({c}) AS null_count, CAST(min({c}) AS DOUBLE) AS min, CAST(max({c}) AS DOUBLE) AS max,
round(CAST(avg({c}) AS DOUBLE), 6) AS mean, round(stddev_samp({c}), 6) AS std FROM events"""


@query(" UNION ALL ".join(_MOMENTS.format(i=i, c=c) for i, (c, k) in enumerate(SCHEMAS["events"]) if k == "n"))
def running_profile(spark, d):
    """Extremes, mean and deviation kept over micro-batches in one state equal those of the whole table."""
    df = source(spark, d, "events")
    out = scratch_path(spark, "running-profile")
    stream = T.file_stream(spark, _drops(spark, df, "events"), df.schema, files_per_batch=1)
    _run(T.start_running_profile(stream, out, scratch_path(spark, "checkpoint")))
    found = T.running_totals(spark, out).where(F.col("mean").isNotNull())
    return r6(found, "mean", "std").select("position", "column_name", "rows", "null_count", "min", "max", "mean", "std")


@query(with_source("dirty_orders", "SELECT DISTINCT * FROM v"))
def streaming_duplicates(spark, d):
    """Rows seen in an earlier file are dropped."""
    df = source(spark, d, "dirty_orders")
    out = scratch_path(spark, "stream-distinct")
    stream = T.without_repeats(T.file_stream(spark, _drops(spark, df, "orders"), df.schema, files_per_batch=2))
    _run(stream.writeStream.format("parquet").option("checkpointLocation", scratch_path(spark, "checkpoint"))
         .option("path", out).trigger(availableNow=True).start())
    return spark.read.schema(df.schema).parquet(out)


@query(with_source("dirty_orders", f"SELECT id, {_S} AS fecha_inicio, {_E} AS fecha_fin, {sql_boolean('activo')} AS activo, total FROM v WHERE {_OK}"))
def streaming_clean(spark, d):
    df = source(spark, d, "dirty_orders")
    good, bad = scratch_path(spark, "stream-clean"), scratch_path(spark, "stream-quarantine")
    stream = T.file_stream(spark, _drops(spark, df, "orders"), df.schema, files_per_batch=2)
    _run(T.start_clean(stream, _types(df), good, bad, scratch_path(spark, "checkpoint")))
    return spark.read.parquet(good).drop("batch_id")
