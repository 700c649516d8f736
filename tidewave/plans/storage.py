"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session. Where that is unset, a folder of one's own serves a local session; on a cluster,
    whose executors would each write to their own disk, it is an error."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="tidewave-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def checkpointed(df: DataFrame) -> DataFrame:
    """Cuts the lineage of a table that later steps use more than once."""
    context = df.sparkSession.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()
