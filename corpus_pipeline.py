"""The corpus pipeline: five stages over ``documents``, from toxicity to packing."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from libris.checkpoints import deleted, shared_folder, temporary
from libris.llm.common import OWN, table
from libris.llm.line_dedup import dedup_lines
from libris.llm.queries import packed
from libris.llm.simhash import drop_near_duplicates
from libris.llm.substring_dedup import dedup_substrings
from libris.llm.toxicity import toxicity as toxic_score
from libris.llm.toxicity import train

#: SQL can't express compression lengths, SimHash, runs of sentences or packing.
ORACLE_SQL = None


def _edited(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows with their texts as they are now, of which ``n_chars`` is told anew; texts of which nothing is left go."""
    left = after.where(F.col("text").isNull() | (F.col(f"{OWN}removed") == 0) | F.rlike("text", F.lit(r"\S")))
    if "n_chars" in before.columns:
        left = left.withColumn("n_chars", F.when(F.col(f"{OWN}removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return left.select(*before.columns)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents whose score is 0.7 or more."""
    model = train(docs, table(spark, sf_dir, "labels"))
    return docs.withColumn(f"{OWN}score", toxic_score("text", model)).where(F.col(f"{OWN}score") < 0.7).drop(f"{OWN}score")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without lines that later occurrences of three-line windows cover."""
    return _edited(docs, dedup_lines(docs).withColumnRenamed("n_removed", f"{OWN}removed"))


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five words, similarity 0.8."""
    return drop_near_duplicates(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without sentences that later occurrences of runs of sentences cover."""
    return _edited(docs, dedup_substrings(docs).withColumnRenamed("n_removed", f"{OWN}removed"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all documents' pieces in sequences of at most 4096 ids."""
    return packed(docs)


STAGES = [("toxicity", toxicity), ("line_dedup", line_dedup), ("simhash_dedup", simhash_dedup), ("substring_dedup", substring_dedup), ("packing", packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each result but the last written as Parquet in the shared folder and read again; the folder goes with the session."""
    docs = table(spark, sf_dir, "documents")
    folder = temporary(spark, f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}")
    before = None
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before:
            deleted(spark, f"{folder}/{before}")  # the stage after it is written
        before = name
    return STAGES[-1][1](spark, docs, sf_dir)
