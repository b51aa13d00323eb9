"""Structured Streaming: incremental ingest, and windows over event time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import ingest


def ingest_new_files(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str) -> StreamingQuery:
    """Chunks the documents of files that have come since the last run and appends them to ``target``.

    The checkpoint remembers which files are done, so a run that dies is taken up where it was.
    """
    docs = spark.readStream.schema(schema).parquet(source)
    chunked = ingest.chunks(ingest.articles(docs))
    return chunked.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_windows(events: DataFrame, *, size: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """``event_type, start, n, total`` over tumbling or sliding windows; for batch and streams alike."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    return timed.groupBy(w, "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select("event_type", F.col("window.start").alias("start"), "n", "total")


def sessions(events: DataFrame, *, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """``user_id, start, end, n``: runs of a user's events with no longer pause than ``gap``."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
