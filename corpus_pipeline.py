"""The corpus pipeline: documents pass from stage to stage, each stage a table on disk."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tunelake.llm import exact_dedup, mixing, ngram_join, packing, quality
from tunelake.llm.common import fresh, read, stored


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject, by a model of the table's labels."""
    model = quality.fitted(docs, read(spark, sf_dir, "labels"))
    score = fresh(docs, "__score")
    return quality.scored(docs, model, score=score).where(F.col(score) >= quality.CUT).drop(score)


def unique_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal texts, the one with the largest doc_id stays."""
    return exact_dedup.without_duplicates(docs, keep="largest")


def distinct_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents connected by a similarity of 0.8 or more, the one with the smallest doc_id
    stays."""
    return ngram_join.without_near_duplicates(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often, and as far, as the mix takes them."""
    return mixing.mixed_documents(docs)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies in the training sequences."""
    return packing.packed(docs)


STAGES = [
    ("quality classifier", good_quality),
    ("exact dedup", unique_texts),
    ("n-gram Jaccard join", distinct_texts),
    ("mixing", mixed),
    ("best-fit packing", sequences),
]

#: Random draws and a trained classifier have no SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
