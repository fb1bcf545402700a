"""Tables as sources, and a key that orders their rows."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, name: str) -> DataFrame:
    """A Parquet or ORC path, or a table of the catalog."""
    if name.endswith(".orc"):
        return spark.read.orc(name)
    if "/" in name or name.endswith(".parquet"):
        return spark.read.parquet(name)
    return spark.table(name)


def with_row_key(df: DataFrame, name: str = "row_key") -> DataFrame:
    """Add the place of a row in its files, where the source knows it.

    Parquet gives the row index in the file. Text gives the block and the order
    in it. Other sources have no such place: name a key of their own instead.
    """
    for parts in (
        ["_metadata.file_path", "_metadata.row_index"],
        ["_metadata.file_path", "_metadata.file_block_start"],
    ):
        try:
            keys = [F.col(p) for p in parts]
            if "row_index" not in parts[1]:
                keys.append(F.monotonically_increasing_id().alias("id"))
            return df.select("*", F.struct(*keys).alias(name))
        except AnalysisException:
            continue
    raise ValueError("this source does not know where its rows stand; pass columns that order them as the key")
