"""Streaming twins of batch operators. The engine's tables are batch; these extend it to files that keep arriving."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def event_stream(spark: SparkSession, folder: str, schema: T.StructType, files_per_batch: int = 8) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def distinct_events(events: DataFrame, key: list[str], at: str, delay: str = "1 hour") -> DataFrame:
    """First sighting of each key; state is kept for the delay only."""
    return events.withWatermark(at, delay).dropDuplicatesWithinWatermark(key)


def activity(events: DataFrame, at: str, window: str = "5 minutes", delay: str = "10 minutes") -> DataFrame:
    """Events by kind and window; late ones count until the watermark has passed."""
    return events.withWatermark(at, delay).groupBy(F.window(at, window), "event_type").agg(F.count("*").alias("n"))


def idle_sessions(events: DataFrame, at: str, who: str, gap: str = "15 minutes", delay: str = "30 minutes") -> DataFrame:
    """Sessions that end after a gap, for idle reviews."""
    return events.withWatermark(at, delay).groupBy(F.session_window(at, gap), who).agg(F.count("*").alias("turns"))


def newest_figures(usage: DataFrame) -> DataFrame:
    """Latest known figures by source sequence, for outputMode update: the same aggregation as in batch, whose state is one
    row for each producer, attempt, stage and provenance."""
    from ..operators.usage import observations

    return observations(usage)
