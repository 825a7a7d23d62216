"""A training-data pipeline over ``documents``: quality, near-duplicates, contamination, personal data, mixture.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of ``docs``.  Between
stages the rows are written as Parquet into the shared checkpoint folder and read again, so that a lost executor repeats
one stage's work at most.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontaminate, frames, mixing, pii, quality, simhash


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts.  Null and empty texts get the score of an empty text; repeated rows are
    accepted or rejected together; without labels, or without documents, nothing is rejected for its words."""
    model = quality.fit(docs, frames.table(spark, sf_dir, "labels"))
    own = frames.apart(docs, "_quality")
    return quality.score(docs, model, out=own).filter(F.col(own) >= 0.5).select(*docs.columns)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity of 0.8 or more.  The smallest doc_id stays,
    null ids last; null and empty texts are one group; of rows alike in id and text one stays."""
    return simhash.near_copies(docs)


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item.  Null and empty texts have none and stay; repeated rows stay or go
    together; without items all stay."""
    own = frames.apart(docs, "_hits")
    found = decontaminate.matches(docs, frames.table(spark, sf_dir, "benchmark"), n_words=frames.apart(docs, "_words"), hits=own)
    return found.filter(F.size(own) == 0).select(*docs.columns)


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by its kind in brackets; n_chars counts the new text.  Null texts stay null, with 0 characters;
    every row stays."""
    clean = pii.redact(docs, pii.fit(docs))
    return clean.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The manifest of the mix: doc_id, source, size, source_size, target and taken (words of its copies).  Texts without
    words are in no mix; a null source is a source; repeated rows are documents of their own; ties in finish time go by id."""
    return mixing.mix(docs).filter("taken > 0")


STAGES = [
    ("quality_classifier", good),
    ("simhash_near_dedup", distinct),
    ("benchmark_decontamination", uncontaminated),
    ("personal_data", without_personal_data),
    ("source_mixing", mixture),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = frames.table(spark, sf_dir, "documents")
    at = f"{frames.checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for i, (name, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{at}/{i}-{name}")
        docs = spark.read.parquet(f"{at}/{i}-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
