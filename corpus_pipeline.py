"""The corpus pipeline: each stage takes what its predecessor kept and returns it without what it decides against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.llm.common import in_small_batches, saved, table
from kinfold.llm.exact_dedup import drop_exact_copies
from kinfold.llm.jaccard import keep_one_of_each
from kinfold.llm.packing import pack_documents
from kinfold.llm.quality import learn, with_score
from kinfold.llm.substrings import without_repeats

#: A document goes if its probability of being a good one is lower.
LEAST_QUALITY = 0.5


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject; it learns from the labels of documents that are here."""
    in_small_batches(spark)
    model = learn(docs, table(spark, sf_dir, "labels"))
    return with_score(docs, model, score="_quality").where(F.col("_quality") >= LEAST_QUALITY).select(*docs.columns)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts: that with the largest id."""
    return drop_exact_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of texts whose 5-word shingles are alike by 4/5 or more: that with the smallest id."""
    in_small_batches(spark)
    return keep_one_of_each(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without words of windows that start earlier too; n_chars follows the text."""
    in_small_batches(spark)
    return without_repeats(docs).withColumns({"n_chars": F.length("text").cast("long")} if "n_chars" in docs.columns else {})


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in the sequences."""
    in_small_batches(spark)
    return pack_documents(docs)


STAGES = [("quality", quality), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("substring_dedup", substring_dedup), ("packing", packing)]

#: No SQL: a trained model and a tokenizer are part of it; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the last stage returns for the documents of sf_dir; the others' results are written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
