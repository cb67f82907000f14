"""The whole exploration of a panel: every table, and a report of them in sections."""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import exprs as E
from tessera.operators import cleaning, profile, spatial, timeseries
from tessera.plans import features
from tessera.sources import tables

log = logging.getLogger(__name__)
_NUMBERS = ("lanes", "temperature", "time_slot", "hour", "latitude", "longitude", "day", "month", "day_of_week", "is_weekend", "sin_time", "cos_time")


def derive(panel: DataFrame) -> DataFrame:
    """The panel with cleaned categories, time features, month and coordinates."""
    df = cleaning.time_features(features.prepare(panel))
    return cleaning.decode_coordinates(df.withColumn("month", E.month()))


def explore(df: DataFrame, clusters: int = 6, seed: int = 42) -> dict[str, DataFrame]:
    """Every table by name; ``df`` as from ``derive``."""
    numbers = [c for c in _NUMBERS if c in df.columns]
    centers = spatial.kmeans_centers(spatial.centroids(df), clusters, seed)
    clustered = spatial.nearest_center(df, centers)
    found = {
        "chronology": timeseries.chronology_breaks(df),
        "nulls": profile.null_counts(df),
        "duplicates": profile.duplicate_rows(df, ("idx",)),
        "summary": profile.describe(df, ["demand"]),
        "moments": profile.moments(df, "demand"),
        "quantiles": profile.quantiles(df, "demand"),
        "outliers": profile.iqr_outliers(df, "demand"),
        "histogram": profile.histogram(df, "demand", 0.0, 1.0),
        "hours": profile.mean_by(df, "hour").orderBy("hour"),
        "weekdays": profile.mean_by(df, "day_of_week").orderBy("day_of_week"),
        "weekend": profile.mean_by(df, "is_weekend").orderBy("is_weekend"),
        "hour_by_weekday": profile.pivot_mean(df, "hour", "day_of_week", list(range(7)), "dow").orderBy("hour"),
        "bounds": spatial.bounds(df),
        "clusters": clustered.groupBy("spatial_cluster").agg(F.avg("demand").alias("mean_demand"), F.count("*").alias("n")).orderBy("spatial_cluster"),
        "hottest": profile.hot_spots(df, 10, True),
        "coldest": profile.hot_spots(df, 10, False),
        "heat_map": df.dropna(subset=["latitude", "longitude"]).groupBy("latitude", "longitude").agg(F.avg("demand").alias("mean_demand")),
        "correlations": profile.target_correlations(df, numbers),
    }
    for category in ("road_type", "weather", "vehicles", "landmarks"):
        if category in df.columns:
            found[f"by_{category}"] = profile.mean_by(df, category).orderBy(F.desc("mean"), category)
    return found


#: Sections of the report and their tables, in order; the larger tables are written as data alone.
SECTIONS = {
    "Risks": ("chronology", "bounds"),
    "Basic statistics": ("duplicates", "nulls", "summary"),
    "Distribution and outliers": ("moments", "outliers", "quantiles"),
    "Time": ("hours", "weekdays", "weekend"),
    "Places": ("clusters", "hottest", "coldest"),
    "Correlations": ("correlations", "by_road_type", "by_weather", "by_vehicles", "by_landmarks"),
}


def notes(found: dict[str, DataFrame]) -> list[str]:
    """What a reader should be warned of; reads a few rows."""
    out = []
    breaks = found["chronology"].first()["breaks"]
    if breaks:
        out.append(f"Rows are not in order of time ({breaks} steps back): order each place by day and slot before any lag.")
    constant = [r["column"] for r in found["correlations"].collect() if r["corr"] is None]
    if constant:
        out.append(f"Constant columns, without a correlation: {', '.join(constant)}.")
    if not found["bounds"].first()["in_fence"]:
        out.append("Coordinates lie outside the fence: they are shifted or anonymous, and real maps do not fit them.")
    return out


def report(found: dict[str, DataFrame], title: str = "Exploration of demand") -> str:
    """Markdown of the notes and of every section's small tables."""
    out = [f"# {title}", "", *[f"* {note}" for note in notes(found)], ""]
    for section, names in SECTIONS.items():
        shown = {name: found[name] for name in names if name in found}
        out.append(profile.report(section, shown, 100).replace("# ", "## ", 1).replace("\n## ", "\n### "))
    return "\n".join(out)


def run_all(panel: DataFrame, out: str, seed: int = 42) -> dict[str, DataFrame]:
    """Derive, explore, write every table and the report below ``out``; returns the tables."""
    df = derive(panel).persist()
    try:
        found = explore(df, seed=seed)
        for name, table in found.items():
            log.info("table %s", name)
            tables.save(table, f"{out}/tables/{name}")
        spark = panel.sparkSession
        written = {name: spark.read.parquet(f"{out}/tables/{name}") for name in found}
        tables.save_text(spark, report(written), f"{out}/report")
        return written
    finally:
        df.unpersist()
