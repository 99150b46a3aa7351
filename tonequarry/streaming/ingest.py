"""Incremental ingest of filings: an extension; the study itself resumes a batch by skipping what is done.

Files that arrive in a folder are read once each, deduplicated by accession, and upserted into a state table whose
latest row per key counts. A repeated batch gives the same state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tonequarry.operators.rows import first_by

RECORD = "accession string, cik long, status string, size long, completed_at timestamp"


def arrivals(spark: SparkSession, folder: str, late: str = "1 day") -> DataFrame:
    """New records, each accession and time once; the state of the deduplication is bounded by the watermark."""
    rows = spark.readStream.schema(RECORD).json(folder)
    return rows.withWatermark("completed_at", late).dropDuplicatesWithinWatermark(["accession", "status"])


def store(rows: DataFrame, log: str, checkpoint: str) -> StreamingQuery:
    """Appends each batch to a log, partitioned by batch, so that a repeated batch replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{log}/batch={number}")

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def state(spark: SparkSession, log: str) -> DataFrame:
    """The latest record of each accession in the log."""
    return first_by(spark.read.parquet(log), ["accession"], [F.desc("completed_at"), F.desc("batch"), F.asc("status")]).drop("batch")
