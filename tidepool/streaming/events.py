"""Streams over the serving event log: rates by window, dedupe with state, running popularity."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepool.sources.tables import EVENT


def read_log(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """The log's files as a stream, with ``event_time``."""
    df = spark.readStream.schema(EVENT).option("maxFilesPerTrigger", files_per_trigger).json(path)
    return df.withColumn("event_time", F.timestamp_seconds("ts"))


def distinct_requests(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Each request once; state is kept for as long as rows may be late."""
    return events.withWatermark("event_time", late).dropDuplicatesWithinWatermark(["request_id", "event_type"])


def rates(events: DataFrame, width: str = "5 minutes", late: str = "10 minutes", slide: str | None = None) -> DataFrame:
    """Events and mean latency by window and type."""
    w = F.window("event_time", width, slide) if slide else F.window("event_time", width)
    return events.withWatermark("event_time", late).groupBy(w, "event_type").agg(F.count(F.lit(1)).alias("n"), F.avg("latency_ms").alias("mean_latency_ms"))


def item_impressions(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """How often each item was recommended, by window."""
    shown = events.withWatermark("event_time", late).select("event_time", F.explode("app_ids").alias("app_id"))
    return shown.groupBy(F.window("event_time", width), "app_id").agg(F.count(F.lit(1)).alias("n"))


def run_to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Process what is there and stop; a later run goes on from the checkpoint."""
    stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start().awaitTermination()
