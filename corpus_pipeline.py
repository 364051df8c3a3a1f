"""From documents to training sequences: filtered, without near copies and secrets, mixed by source, packed.

Every stage takes all documents that the one before it kept; its result is written as Parquet and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import jaccard, mixing, packing, secrets, toxicity
from plumbline.llm.shared import written

#: How often the mixture may read a source.
REPETITION = 1.5


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score below 0.5, by a classifier learned from the labels."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    model = toxicity.fit(toxicity.labelled(docs.select("doc_id", "text"), labels, toxicity.held_out()))
    return toxicity.score(docs, model, into="__toxicity").where(F.col("__toxicity") < 0.5).select(*docs.columns)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest id."""
    return jaccard.kept(docs)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets replaced."""
    return secrets.redact(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document at least once, small sources read again up to the limit."""
    return mixing.mixed_documents(docs, repetition=REPETITION)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 1024 ids."""
    return packing.pack_documents(docs)


STAGES = [("toxicity", without_toxic), ("near copies", without_near_copies), ("secrets", without_secrets),
          ("mixing", mixed), ("packing", packed)]

#: SQL can't express these stages; tests compare each with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {}
