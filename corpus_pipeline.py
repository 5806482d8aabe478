"""A training-data pipeline over `documents`: quality rules, quality classifier, near-duplicate join, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet to the shared folder and
read again as the next stage's docs. All but the last return the columns of documents. A document that a stage rejects
doesn't come back: of each near-duplicate group the row with the smallest doc_id stays. Rows of one doc_id with unlike texts all stay.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webskein.llm import jaccard_join, packing, quality_classifier, quality_rules
from webskein.llm.common import table, written
from webskein.session import ship

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Documents whose quality score is lower go.
LEAST_SCORE = 0.5
#: Words of a shingle and least percent of shared shingles of near duplicates; the op4 query has stricter ones of its own.
WORDS, PERCENT = 5, 80


def rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that no quality rule rejects."""
    ship(spark)
    return quality_rules.cascade(docs).filter("kept").select(*COLUMNS)


def classifier_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that score LEAST_SCORE or more; the model learns from the labelled rows of the whole table."""
    ship(spark)
    model = quality_classifier.learn(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return quality_classifier.score(docs, model, keep=COLUMNS).filter(F.col("score") >= LEAST_SCORE).select(*COLUMNS)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group by WORDS and PERCENT: that with the smallest doc_id (null is largest).

    Rows are told apart by their place, so unlike texts of one doc_id stay and like ones without a doc_id are one group.
    """
    ship(spark)
    placed = docs.withColumn("place", F.monotonically_increasing_id())
    groups = jaccard_join.near_duplicates(placed.select(F.col("place").alias("doc_id"), "text"), words=WORDS, percent=PERCENT).select(F.col("doc_id").alias("place"), "component_id")
    first = groups.join(placed.select("place", "doc_id"), "place").groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "place")).alias("first"))
    return placed.join(first.select(F.col("first.place").alias("place")), "place", "left_semi").select(*COLUMNS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents in sequences."""
    ship(spark)
    return packing.pack(docs)


STAGES = [
    ("quality rules", rules_stage),
    ("quality classifier", classifier_stage),
    ("near-duplicate join", near_duplicate_stage),
    ("packing", packing_stage),
]

#: The classifier and the ids of the tokenizer can't be written in SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs, _ = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
