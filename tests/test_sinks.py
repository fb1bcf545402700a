"""Loads of two tables that take place together or not at all."""

import pytest
from pyspark.sql import functions as F

from clearwell.sources import sinks


def _state(spark, root):
    clean, bad = sinks.read_pair(spark, root)
    return sorted(r[0] for r in clean.collect()), sorted(r[0] for r in bad.collect())


def test_both_tables_change_or_neither(spark, tmp_path):
    root = str(tmp_path / "pair")
    frame = lambda *x: spark.createDataFrame([(i,) for i in x], "n int")
    with pytest.raises(ValueError):
        sinks.read_pair(spark, root)
    assert sinks.commit_pair(frame(1, 2), frame(9), root) == 1
    before = sinks.read_pair(spark, root)
    broken = frame(7).select(F.raise_error(F.lit("disk full")).cast("int").alias("n"))
    for strategy in ("REPLACE", "APPEND"):
        with pytest.raises(Exception, match="disk full"):
            sinks.commit_pair(frame(5), broken, root, strategy)
        assert _state(spark, root) == ([1, 2], [9])
    assert sinks.commit_pair(frame(3), frame(), root, "APPEND", run_id="x") == 2
    assert sinks.commit_pair(frame(3), frame(), root, "APPEND", run_id="x") == 2
    assert _state(spark, root) == ([1, 2, 3], [9])
    assert sinks.commit_pair(frame(4), frame(8), root, "REPLACE") == 3
    assert _state(spark, root) == ([4], [8])
    # A reader that began before the replacement still finds its files.
    assert sorted(r[0] for r in before[0].collect()) == [1, 2]
    with pytest.raises(ValueError):
        sinks.commit_pair(frame(1), frame(1), root, "MERGE")


def test_an_empty_load_keeps_its_columns(spark, tmp_path):
    root = str(tmp_path / "pair")
    empty = spark.createDataFrame([], "a int, b string")
    sinks.commit_pair(empty, empty, root)
    clean, bad = sinks.read_pair(spark, root)
    assert clean.columns == ["a", "b"] and clean.count() == bad.count() == 0


def test_clustered_files_can_be_skipped_by_any_key(spark, tmp_path):
    rows = [(i, (i * 7919) % 2000, f"k{(i * 31) % 50:02d}", None if i % 11 == 0 else "h") for i in range(4000)] + [(7, 7, "k07", "hot")] * 2000
    df = spark.createDataFrame(rows, "a int, b long, c string, d string").repartition(5)
    path = str(tmp_path / "t")
    sinks.write_clustered(df, path, ["a", "b"], files=16)
    back = spark.read.parquet(path)
    assert back.columns == df.columns and sorted(map(tuple, back.collect()), key=str) == sorted(rows, key=str)
    for key in ("a", "b"):
        held = sinks.files_to_read(spark, path, key, df.where("a != 7").select(key)).agg(F.avg(F.col("files") / F.col("of"))).first()[0]
        assert held < 0.5, (key, held)
    sizes = [r["n"] for r in back.groupBy("_metadata.file_path").agg(F.count(F.lit(1)).alias("n")).collect()]
    assert len(sizes) >= 12 and max(sizes) < 2.5 * sum(sizes) / len(sizes)  # the hot key is dealt out
    sinks.write_clustered(df, path, "c", files=8)
    assert sinks.files_to_read(spark, path, "c", df.select("c")).agg(F.avg("files")).first()[0] < 4
    sinks.write_clustered(df.limit(0), path, ["a", "d"])
    assert spark.read.parquet(path).count() == 0
    with pytest.raises(ValueError):
        sinks.write_clustered(df, path, "zz")


def test_a_clustered_file_is_bounded_by_its_bytes(spark, tmp_path):
    df = spark.range(4000).select("id", F.repeat(F.lit("x"), F.lit(84)).alias("t"))  # 108 bytes a row
    path = str(tmp_path / "t")
    sinks.write_clustered(df, path, "id", files=2, file_bytes=36_000)
    sizes = [r["n"] for r in spark.read.parquet(path).groupBy("_metadata.file_path").agg(F.count(F.lit(1)).alias("n")).collect()]
    assert sum(sizes) == 4000 and len(sizes) >= 10 and max(sizes) < 1000
