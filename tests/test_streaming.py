import pytest
from pyspark.sql import functions as F

from clearwell.operators.profile import column_profile, row_completeness
from clearwell.operators.semantics import DATE, TEXT, ColumnType
from clearwell.streaming import profile as T


def _source(spark, tmp_path):
    df = spark.range(1000).selectExpr(
        "id", "if(id % 7 = 0, null, if(id % 5 = 0, '  ', cast(id % 50 as string))) AS v", "if(id % 3 = 0, 'x', '2024-01-02') AS fecha")
    path = str(tmp_path / "in")
    df.repartition(4).write.parquet(path)
    return df, path


def test_batches_add_up(spark, tmp_path):
    df, path = _source(spark, tmp_path)
    out = str(tmp_path / "out")
    T.start_profile(T.file_stream(spark, path, df.schema, 1), out, str(tmp_path / "cp")).awaitTermination()
    whole = {r["column_name"]: r for r in column_profile(df).collect()}
    got = {r["column_name"]: r for r in T.column_totals(spark, out).collect()}
    for c in df.columns:
        assert (got[c]["rows"], got[c]["null_count"]) == (1000, whole[c]["null_count"])
        assert got[c]["blank_count"] == (whole[c]["blank_count"] or 0)
        assert abs(got[c]["approx_unique"] - whole[c]["unique_count"]) <= 0.02 * whole[c]["unique_count"] + 1
    total = T.table_totals(spark, out).first()
    assert total["batches"] == 4 and total["complete_rows"] == row_completeness(df).first()["complete_rows"]


def test_a_repeated_batch_counts_once(spark, tmp_path):
    write = T.profile_writer(str(tmp_path / "out"))
    for batch_id in (0, 1, 1):
        write(spark.range(10), batch_id)
    assert T.table_totals(spark, str(tmp_path / "out")).first()["rows"] == 20


def test_repeats_across_files(spark, tmp_path):
    path = str(tmp_path / "in")
    for _ in range(3):
        spark.range(100).repartition(2).write.mode("append").parquet(path)
    stream = T.without_repeats(T.file_stream(spark, path, spark.range(1).schema, 2))
    query = (stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp"))
             .option("path", str(tmp_path / "out")).trigger(availableNow=True).start())
    query.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 100


def test_watermarked_repeats_are_planned(spark, tmp_path):
    path = str(tmp_path / "in")
    spark.range(3).withColumn("ts", F.current_timestamp()).write.parquet(path)
    schema = spark.read.parquet(path).schema
    stream = T.without_repeats(T.file_stream(spark, path, schema), ["id"], "ts", "1 hour")
    assert stream.isStreaming and stream.columns == ["id", "ts"]
    with pytest.raises(ValueError):
        T.without_repeats(T.file_stream(spark, path, schema), ["id"], "ts")


def test_stream_is_split(spark, tmp_path):
    df, path = _source(spark, tmp_path)
    good, bad = str(tmp_path / "good"), str(tmp_path / "bad")
    types = [ColumnType("id", TEXT), ColumnType("v", TEXT), ColumnType("fecha", DATE)]
    T.start_clean(T.file_stream(spark, path, df.schema, 2), types, good, bad, str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(good).count() == 666 and spark.read.parquet(bad).count() == 334


def _numbers(spark):
    df = spark.range(1000).selectExpr(
        "id", "if(id % 9 = 0, null, 1e6 + id * 0.25) AS x", "if(id % 10 = 0, double('nan'), cast(id % 13 as double)) AS y", "cast(null as int) AS none", "if(id % 4 = 0, ' ', 'v') AS t")
    return df


def _check_totals(df, found, rows):
    whole = {r["column_name"]: r for r in column_profile(df).collect()}
    got = {r["column_name"]: r for r in found.collect()}
    assert set(got) == set(whole)
    for c, w in whole.items():
        g = got[c]
        assert (g["rows"], g["null_count"], g["blank_count"], g["min"], g["max"]) == (rows, w["null_count"], w["blank_count"] or 0, w["min"], w["max"])
        for m in ("mean", "std"):
            assert g[m] == w[m] or g[m] == pytest.approx(w[m], rel=1e-9)
        assert w["median"] is None and g["approx_median"] is None or abs(g["approx_median"] - w["median"]) <= 0.02 * (w["max"] - w["min"])
    return got


def test_running_state_equals_the_whole_table(spark, tmp_path):
    df = _numbers(spark)
    path, out = str(tmp_path / "in"), tmp_path / "out"
    df.repartition(7).write.parquet(path)
    T.start_running_profile(T.file_stream(spark, path, df.schema, 1), str(out), str(tmp_path / "cp")).awaitTermination()
    got = _check_totals(df, T.running_totals(spark, str(out)), 1000)
    assert got["id"]["complete_rows"] == 0
    assert len(list(out.rglob("*.parquet"))) == 2  # seven batches came


def test_running_state_of_batches_run_again(spark, tmp_path):
    df, out = _numbers(spark), str(tmp_path / "out")
    write = T.running_writer(out)
    with pytest.raises(ValueError):
        T.running_totals(spark, out)
    for batch_id in (0, 1, 1, 2, 2, 3):
        write(df.where(f"id % 4 = {batch_id}"), batch_id)
    _check_totals(df, T.running_totals(spark, out), 1000)
    # The write of a batch breaks off: the state before it is still there, and the batch can run again.
    for f in (tmp_path / "out" / "state" / "slot=0").glob("*"):
        f.unlink()
    _check_totals(df, T.running_totals(spark, out), 1000)
    write(df, 4)
    assert T.running_totals(spark, out).first()["rows"] == 2000


def test_states_merge_in_any_grouping(spark):
    df = _numbers(spark)
    parts = [T.batch_state(df.where(f"id % 3 = {i}")) for i in range(3)]
    left = T.merge_states(T.merge_states(parts[0].union(parts[1])).union(parts[2]))
    right = T.merge_states(parts[0].union(T.merge_states(parts[1].union(parts[2]))))
    keep = lambda d: {r["column_name"]: (r["rows"], r["non_null"], r["min"], r["max"], r["mean"] and round(r["mean"], 6), r["squares"] and round(r["squares"], 3)) for r in d.collect()}
    assert keep(left) == keep(right) == keep(T.batch_state(df))


def test_a_batch_of_one_large_file_is_dealt_over_the_cores(spark):
    from clearwell.streaming.profile import _read_once
    with _read_once(spark.range(0, 2_000_000, 1, 1)) as rows:
        assert rows.rdd.getNumPartitions() > 1 and rows.count() == 2_000_000
