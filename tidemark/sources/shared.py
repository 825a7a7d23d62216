"""The folder that the driver and all executors share (``spark.checkpoint.dir``)."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def checkpoint_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder; where none is set one is made, but only for a local master."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        at = spark.conf.get("spark.checkpoint.dir", None)
        if not at and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(at or tempfile.mkdtemp(prefix="tidemark-checkpoint-"))
    return sc._jsc.sc().getCheckpointDir().get()


def folder(spark: SparkSession, name: str) -> str:
    """A new folder below it, for a table or a stream's checkpoint."""
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def checkpointed(df: DataFrame) -> DataFrame:
    """df written there, its lineage cut."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
