"""Folders for files that one query writes and reads again."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_root(spark: SparkSession) -> str:
    """The shared folder that spark.checkpoint.dir names. Where it is unset: a folder of this machine in local mode, an error on a cluster, whose executors
    would not see it."""
    if root := spark.conf.get("spark.checkpoint.dir", None):
        return root.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return f"file://{tempfile.gettempdir()}/helixtab-{spark.sparkContext.applicationId}"


def new_folder(spark: SparkSession) -> str:
    return f"{scratch_root(spark)}/{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """The table written to a folder of its own and read again: what a plan gives differently each time, such as ids by task or sampled ranges, is fixed thereby."""
    path = new_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
