"""Session-level helpers: checkpoints and shared scratch folders."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """Folder that every executor and the driver can reach.

    It is the one in ``spark.checkpoint.dir``; where that is unset, a folder in
    the warehouse, which is shared for the same reason. Nothing depends on the
    master, and no machine-local temporary folder is ever used.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        folder = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/scratch"
    return f"{folder.rstrip('/')}/{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder, under the run's own name."""
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


def settle(df: DataFrame) -> DataFrame:
    """Compute a small derived table once, for the many reports that read it.

    Written to the shared folder, so it survives lost executors.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)
