"""Streaming ingest of observations: the batch scans applied to a stream, and windowed counts with late data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.observations import from_events

EVENT_SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def observation_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Observations from Parquet files as they arrive, with the time of the event for watermarks."""
    events = spark.readStream.schema(EVENT_SCHEMA).parquet(folder)
    return from_events(events).withColumn("time", F.timestamp_micros((F.col("t") * 86_400_000_000 + F.lit(19723 * 86_400_000_000)).cast("long")))


def mission_day_counts(stream: DataFrame, late: str = "2 days") -> DataFrame:
    """Observations and mean level by mission and day; a day is final once it is ``late`` behind."""
    return stream.withWatermark("time", late).groupBy(F.window("time", "1 day"), "mission").agg(F.count(F.lit(1)).alias("n"), F.avg("sla").alias("mean_sla"))
