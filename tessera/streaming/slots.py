"""Demand by 15-minute slot over a stream of events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """Parquet files of events as they arrive."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).parquet(path)


def slot_demand(events: DataFrame, late: str = "1 hour", width: str = "15 minutes") -> DataFrame:
    """Mean value and count by tumbling slot and type; works on a batch frame alike."""
    timed = events.withColumn("at", F.col("ts").cast("timestamp"))
    if timed.isStreaming:
        timed = timed.withWatermark("at", late)
    slots = timed.groupBy(F.window("at", width), "event_type").agg(F.avg("value").alias("mean_value"), F.count("*").alias("n"))
    return slots.select(F.col("window.start").alias("slot_start"), "event_type", "mean_value", "n")
