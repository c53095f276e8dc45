"""A training corpus from raw documents, stage by stage.

Each stage is a function of (spark, docs, sf_dir) that returns a DataFrame; every stage is written as
Parquet and read again as the documents of the next one. All but the last return the columns of
``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from drivetrace.llm import jaccard, mixing, pieces, pii, quality
from drivetrace.llm.common import written
from drivetrace.llm.queries import PIECE_MODEL


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    machine = quality.learned(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.accepted(docs, machine)


def single(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, the one with the smallest doc_id."""
    return jaccard.distinct_texts(docs)


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and the words that give it away are replaced."""
    return pii.sanitised(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture of their sources reads them."""
    return mixing.mixed(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of every document, and whether they decode to its text."""
    vocabulary = pieces.vocabulary(PIECE_MODEL)
    rows = pieces.encoded(docs, vocabulary, decode=True)
    return rows.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", (F.col("decoded") == F.col("text")).alias("round_trip"))


STAGES = [("quality", good), ("near-duplicates", single), ("private", private), ("mixture", mixed), ("pieces", tokens)]

#: Trained models, hashed permutations and pieces have no SQL; the stages are tested one by one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
