"""Incremental ingest: file streams with checkpoints, in place of hand-kept scan states."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def first_user_turns(spark: SparkSession, path: str, schema, fraction: float = 1.0) -> DataFrame:
    """O-S15: a stream of first user turns that pass the hash gate."""
    from quarry.operators.sampling import hash_gate

    turns = spark.readStream.schema(schema).parquet(path)
    return turns.filter("role = 'user' AND turn <= 1 AND text IS NOT NULL AND text <> ''").filter(hash_gate(F.col("conv_id").cast("string"), fraction))


def run_once(stream: DataFrame, target: str, checkpoint: str) -> None:
    """Everything new since the checkpoint, then stop; a repeated run adds nothing twice."""
    stream.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def windowed_counts(events: DataFrame, late: str = "1 hour", size: str = "1 hour") -> DataFrame:
    """Of an append-only event log: counts by event-time window and type, late rows within the watermark."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
