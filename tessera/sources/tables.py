"""Readers, writers, and the view of events as a demand panel."""

from __future__ import annotations

import json
import logging

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

log = logging.getLogger(__name__)

RAW_SCHEMA = T.StructType(
    [
        T.StructField("Index", T.LongType()),
        T.StructField("geohash", T.StringType()),
        T.StructField("day", T.IntegerType()),
        T.StructField("timestamp", T.StringType()),
        T.StructField("demand", T.DoubleType()),
        T.StructField("RoadType", T.StringType()),
        T.StructField("NumberofLanes", T.DoubleType()),
        T.StructField("LargeVehicles", T.StringType()),
        T.StructField("Landmarks", T.StringType()),
        T.StructField("Temperature", T.DoubleType()),
        T.StructField("Weather", T.StringType()),
    ]
)


def read_csv(spark: SparkSession, path: str, schema: T.StructType = RAW_SCHEMA, encoding: str = "UTF-8") -> DataFrame:
    """CSV with a header, matched to the schema by name; no inference, so no extra pass over the file."""
    names = spark.read.option("header", True).option("encoding", encoding).csv(path).columns
    fields = {f.name: f for f in schema.fields}
    typed = T.StructType([fields.get(n, T.StructField(n, T.StringType())) for n in names])
    return spark.read.schema(typed).option("header", True).option("encoding", encoding).csv(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Names of the raw files' columns in the panel.
_PANEL = {"Index": "idx", "timestamp": "ts_hm", "RoadType": "road_raw", "NumberofLanes": "lanes", "Temperature": "temperature", "Weather": "weather_raw", "LargeVehicles": "vehicles_raw", "Landmarks": "landmarks_raw"}


def panel_of_raw(raw: DataFrame) -> DataFrame:
    """A raw file under the panel's names; a missing Index is the row's number in its file's order."""
    if "Index" not in raw.columns:
        raw = raw.withColumn("Index", F.monotonically_increasing_id())
    return raw.withColumnsRenamed({a: b for a, b in _PANEL.items() if a in raw.columns})


def save(df: DataFrame, path: str, save_format: str = "parquet") -> str:
    """Parquet or CSV, replacing what is there; what Parquet refuses is written as CSV beside it.  Returns the path written."""
    if save_format not in ("parquet", "csv"):
        raise ValueError(f"unknown format {save_format!r}")
    if save_format == "parquet":
        try:
            df.write.mode("overwrite").parquet(path)
            return path
        except PySparkException as e:
            path = path.removesuffix(".parquet") + ".csv"
            log.warning("Parquet failed (%s); writing %s", e, path)
    df.write.mode("overwrite").option("header", True).csv(path)
    return path


def load(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """What ``save`` wrote; CSV files are typed by the schema, or by a look at their values."""
    if not path.rstrip("/").endswith(".csv"):
        return spark.read.parquet(path)
    reader = spark.read.option("header", True)
    return reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)


def save_submission(predictions: DataFrame, path: str, order: tuple[str, ...] = ("day", "time_slot", "Index")) -> None:
    """(Index, demand) in chronological order, as CSV; every key of the order must be there."""
    missing = [c for c in order if c not in predictions.columns]
    if missing:
        raise ValueError(f"no columns {missing} to order a submission by")
    predictions.orderBy(*order).select("Index", "demand").write.mode("overwrite").option("header", True).csv(path)


def save_submission_pair(predictions: DataFrame, folder: str, stamp: str) -> tuple[str, str]:
    """The submission under the time's name, and the same rows as the latest one."""
    paths = f"{folder}/submission_{stamp}.csv", f"{folder}/submission_latest.csv"
    save_submission(predictions, paths[0])
    spark = predictions.sparkSession
    # a file of the first is a range of the order, and files are read back in the order of their names
    spark.read.schema("Index long, demand double").option("header", True).csv(paths[0]).write.mode("overwrite").option("header", True).csv(paths[1])
    return paths


def matches_sample(spark: SparkSession, predictions: DataFrame, sample_path: str) -> bool:
    """Whether the sample submission has as many rows; warns where it has not."""
    mine, theirs = predictions.count(), spark.read.option("header", True).csv(sample_path).count()
    if mine != theirs:
        log.warning("the submission has %d rows, the sample %d", mine, theirs)
    return mine == theirs


def save_text(spark: SparkSession, text: str, path: str) -> None:
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def save_json(spark: SparkSession, facts: dict, path: str) -> None:
    save_text(spark, json.dumps(facts, sort_keys=True), path)


_ALPHABET = "0123456789bcdefghjkmnpqrstuvwxyz"


def demand_obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as a panel: 24 cells, 30 days, 96 slots, with dirty attributes."""
    e = table(spark, sf_dir, "events")
    cell, k = (F.col("user_id") % 24).cast("int"), F.get_json_object("props", "$.k").cast("int")
    b = e.select(
        F.col("event_id").alias("idx"), cell.alias("cell"), F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date")).alias("day"),
        F.hour("ts").cast("int").alias("hour"), F.minute("ts").cast("int").alias("minute"), "event_type", "value", k.alias("k"),
    )
    pick = lambda at: F.substr(F.lit(_ALPHABET), at.cast("int"), F.lit(1))
    kind = F.col("event_type")
    return b.select(
        "idx",
        F.concat(F.lit("qp0"), pick(10 + F.floor(F.col("cell") / 12)), pick(4 + F.floor((F.col("cell") % 12) / 4)), pick(F.col("cell") % 4 + 1)).alias("geohash"),
        "day",
        F.concat(F.col("hour").cast("string"), F.lit(":"), F.col("minute").cast("string")).alias("ts_hm"),
        "hour", "minute",
        (F.col("hour") * 4 + F.floor(F.col("minute") / 15)).cast("int").alias("time_slot"),
        F.least(F.col("value") / 600.0, F.lit(1.0)).alias("demand"),
        F.when(kind == "purchase", " HIGHWAY ").when(kind == "view", "residential").when(kind == "click", "Street").when(kind == "signup", "None").alias("road_raw"),
        F.when(F.col("k") % 30 == 0, None).otherwise((1 + F.col("cell") % 5).cast("int")).alias("lanes"),
        F.when(F.col("k") % 11 == 0, None).otherwise(F.col("k").cast("double") / 4).alias("temperature"),
        F.when(F.col("k") % 4 == 0, "sunny").when(F.col("k") % 4 == 1, "RAINY").when(F.col("k") % 4 == 2, "foggy").alias("weather_raw"),
    )
