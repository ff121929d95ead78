"""Corpus pipeline over ``documents``: the STAGES in order, each written as Parquet
and reread as the next one's input.

Every stage but the last returns the columns of its input, rows unchanged; the first
two fit their classifier on the labels of the training folds.  Null texts are scored
as empty texts, have no shingles and hold no benchmark item."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from logsift.llm import decontaminate, neardup, packing, quality, toxicity
from logsift.llm.common import stage, table
from logsift.llm.queries import training_labels


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: documents scored under 0.5 for quality go."""
    stats = stage(quality.features(docs), "quality-stats")
    model = quality.fit(stats, training_labels(spark, sf_dir, "quality", 3, 1))
    return quality.keep_good(docs, model, 0.5)


def clean_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: documents scored 0.3 or more for toxicity go."""
    model = toxicity.fit(docs, training_labels(spark, sf_dir, "toxic", 4, 2))
    return toxicity.keep_clean(docs, model, 0.3)


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: of each group of near-duplicates the document with the least id stays."""
    return neardup.keep_one(docs)


def uncontaminated_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: documents that hold a benchmark item go."""
    return decontaminate.keep_uncontaminated(docs, table(spark, sf_dir, "benchmark"))


def packed_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: pieces of the kept documents in sequences along the curve."""
    return packing.pack(docs)


STAGES = [
    ("quality", good_documents),
    ("toxicity", clean_documents),
    ("near_duplicates", distinct_documents),
    ("decontamination", uncontaminated_documents),
    ("packing", packed_documents),
]

ORACLE_SQL = None  # learned scores, minima of hashes and tokens have no SQL form


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
