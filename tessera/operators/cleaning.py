"""Cleaning and fitted imputation."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions import exprs as E


@dataclass(frozen=True)
class Medians:
    """Exact interpolated medians of a frame; only ``fit_medians`` makes one."""

    values: dict[str, float]

    def transform(self, df: DataFrame) -> DataFrame:
        have = {c: float(v) for c, v in self.values.items() if c in df.columns and v is not None}
        return df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(v)) for c, v in have.items()}) if have else df


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def fit_medians(df: DataFrame, exclude: tuple[str, ...] = ("Index", "idx", "demand", "day")) -> Medians:
    """One aggregation for all numeric columns."""
    columns = [c for c in numeric_columns(df) if c not in exclude]
    row = df.agg(*[F.median(c).alias(c) for c in columns]).first() if columns else None
    return Medians({c: row[c] for c in columns} if row else {})


def clean_categories(df: DataFrame, columns: dict[str, str], fill: str | None = "Unknown") -> DataFrame:
    """{new: raw}: each raw column cleaned under its new name."""
    return df.withColumns({new: E.clean_category(raw, fill) for new, raw in columns.items()})


def fit_mode(df: DataFrame, key: str, value: str) -> DataFrame:
    """(key, mode): most frequent non-null value of each key, the smallest on ties."""
    return df.filter(F.col(value).isNotNull()).groupBy(key).agg(F.mode(value, True).alias("mode"))


def impute_mode(df: DataFrame, modes: DataFrame, key: str, value: str) -> DataFrame:
    """Nulls of ``value`` from the key's mode; Spark broadcasts the modes if they are small."""
    return df.join(modes, key, "left").withColumn(value, F.coalesce(value, "mode")).drop("mode")


def decode_coordinates(df: DataFrame, geohash: str = "geohash", known: DataFrame | None = None) -> DataFrame:
    """latitude and longitude of the cell's centre; each distinct geohash is decoded once, and Spark broadcasts them if they are few.

    With a table of ``known`` cells (geohash, latitude, longitude) only rows of other cells are decoded.
    """
    if known is not None:
        found = known.select(F.col("geohash").alias("_g"), F.col("latitude").alias("_lat"), F.col("longitude").alias("_lon"))
        joined = df.drop("latitude", "longitude").join(found, F.col(geohash) == F.col("_g"), "left")
        return joined.withColumns({"latitude": F.coalesce("_lat", E.geohash_lat(geohash)), "longitude": F.coalesce("_lon", E.geohash_lon(geohash))}).drop("_g", "_lat", "_lon")
    cells = df.select(F.col(geohash).alias("_g")).distinct().select("_g", E.geohash_lat("_g").alias("latitude"), E.geohash_lon("_g").alias("longitude"))
    kept = df.drop("latitude", "longitude")
    return kept.join(cells, kept[geohash].eqNullSafe(cells["_g"]), "left").drop("_g")


def coordinate_fallback(df: DataFrame, default: tuple[float, float] = (0.0, 0.0)) -> DataFrame:
    """Null coordinates from this frame's own medians, else the default."""
    middle = df.agg(F.median("latitude").alias("mlat"), F.median("longitude").alias("mlon"))
    filled = df.crossJoin(F.broadcast(middle))  # one row
    return filled.withColumns({"latitude": F.coalesce("latitude", "mlat", F.lit(default[0])), "longitude": F.coalesce("longitude", "mlon", F.lit(default[1]))}).drop("mlat", "mlon")


def time_features(df: DataFrame, ts: str = "ts_hm") -> DataFrame:
    hour, minute = E.hour_minute(ts)
    df = df.withColumns({"hour": hour, "minute": minute})
    sin, cos = E.cyclic("time_slot")
    return df.withColumn("time_slot", E.slot("hour", "minute")).withColumns({"sin_time": sin, "cos_time": cos, "day_of_week": E.day_of_week(), "is_weekend": E.is_weekend()})


#: Narrowest integer types by their strict bounds, and the largest float.
_WIDTHS = ((1 << 7, "byte"), (1 << 15, "short"), (1 << 31, "int"))
_FLOAT = 3.4028234663852886e38


def downcast_plan(df: DataFrame) -> dict[str, str]:
    """Types that hold each numeric column's values, from one pass over the data."""
    fields = [f for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]
    if not fields:
        return {}
    row = df.agg(*[F.struct(F.min(f.name).alias("a"), F.max(f.name).alias("b")).alias(f.name) for f in fields]).first()
    plan = {}
    for f in fields:
        low, high = row[f.name]
        if low is None:
            plan[f.name] = "double" if isinstance(f.dataType, T.IntegralType) else "float"
        elif not isinstance(f.dataType, T.IntegralType):
            # infinite and undefined values survive either way
            finite = [abs(float(x)) for x in (low, high) if abs(float(x)) != float("inf") and x == x]
            plan[f.name] = "float" if max(finite, default=0.0) < _FLOAT else "double"
        else:
            plan[f.name] = next((t for w, t in _WIDTHS if -w < low and high < w - 1), "long")
    return plan


def apply_downcast(df: DataFrame, plan: dict[str, str]) -> DataFrame:
    return df.withColumns({c: F.col(c).cast(t) for c, t in plan.items() if c in df.columns}) if plan else df
