"""The corpus pipeline: five stages, each a function of the documents that its predecessor kept.

Counted as part of the training-data subpackage. Every stage but the last returns the columns of ``documents``; the
last returns the pieces of packed training sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tonequarry.llm import lines, packing, quality, secrets, shingles
from tonequarry.llm.common import saved, table
from tonequarry.llm.queries import VOCABULARY


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that repeat earlier ones go, exactly or nearly; no document goes."""
    return lines.dedup_lines(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates, by five-word shingles at Jaccard 0.8, the document of the smallest id stays."""
    return shingles.keep_first(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked; no document goes."""
    return secrets.redact(docs)


#: Words that a packing worker remembers: its executor's memory holds what the stages before have grown to.
PACKING_ENTRIES = 200_000


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What remains is cut into sequences."""
    return packing.pack(docs, VOCABULARY, entries=PACKING_ENTRIES)


STAGES = [("quality classifier", quality_classifier), ("line dedup", line_dedup), ("near dedup", near_dedup), ("secret scan", secret_scan), ("packing", pack)]

#: A trained classifier and a vocabulary can't be expressed in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole of ``documents``; what one returns is written before the next reads it."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
