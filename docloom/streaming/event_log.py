"""The event log as a stream: events once each, counted by window and kept by span."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def read_events(spark: SparkSession, path: str, schema: str = SCHEMA, files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def once_each(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Events without those whose id came within the watermark; state is bounded by it."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def counts_by_window(events: DataFrame, width: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Events by window and kind; needs a watermark on ``ts`` (see ``once_each``)."""
    window = F.window("ts", width, slide) if slide else F.window("ts", width)
    counted = events.groupBy(window, "event_type").agg(F.count("*").alias("n"))
    return counted.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "event_type", "n")


def span_sessions(events: DataFrame, gap: str = "30 minutes", span: str = "user_id") -> DataFrame:
    """Sessions of each span: events no further apart than the gap."""
    counted = events.groupBy(F.session_window("ts", gap), F.col(span).alias("span_id")).agg(F.count("*").alias("n"))
    return counted.select("span_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def append_to(events: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Everything that is there now, appended as Parquet; exactly once across restarts with the same checkpoint."""
    return events.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
