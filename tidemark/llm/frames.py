"""Helpers on DataFrames shared by the operators."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of code points outside these.
SPACE_CLASS = r"[\x20\x09-\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The session's shared checkpoint folder.  Where none is set a folder is made, but only for a local master, as in tests:
    on a cluster executors would write to their own disks."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        at = spark.conf.get("spark.checkpoint.dir", None)
        if not at and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(at or tempfile.mkdtemp(prefix="tidemark-checkpoint-"))
    return sc._jsc.sc().getCheckpointDir().get()


def apart(df: DataFrame, name: str) -> str:
    """A column name that df does not have: the given one, with as many underscores before it as it takes."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name = f"_{name}"
    return name


def cut(df: DataFrame) -> DataFrame:
    """Materialises df in the shared checkpoint folder and cuts its lineage."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def n_words(text: str = "text"):
    """The number of words of a text column, inside whole-stage code; null texts have none."""
    pieces = F.split(F.coalesce(F.col(text), F.lit("")), SPACE_CLASS + "+")
    size = F.size(pieces) - (F.element_at(pieces, 1) == "").cast("int") - ((F.size(pieces) > 1) & (F.element_at(pieces, -1) == "")).cast("int")
    return size.cast("long")
