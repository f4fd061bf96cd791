"""Structured Streaming extensions: incremental ingest, windows with watermarks, task status with state."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from repolith import schemas


def methods_stream(spark: SparkSession, folder: str) -> DataFrame:
    """New methods.jsonl files of a folder as they arrive."""
    return spark.readStream.schema(schemas.METHODS).option("maxFilesPerTrigger", 100).json(folder)


def tumbling(events: DataFrame, length: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Counts and sums by window and type; what is later than ``late`` is left out."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", length), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions of users: start, end and number of events."""
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def run_available(stream: DataFrame, sink: str, checkpoint: str, mode: str = "append", each: Callable[[DataFrame, int], None] | None = None) -> None:
    """Processes all that has arrived and stops; a run again continues from ``checkpoint``."""
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    job = writer.foreachBatch(each).start() if each else writer.format("parquet").start(sink)
    job.awaitTermination()
