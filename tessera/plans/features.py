"""The feature pipeline: fit on train, transform any frame against a reference frame."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.config import FeatureConfig
from tessera.functions import exprs as E
from tessera.operators import cleaning, encoding, spatial, timeseries
from tessera.sources.scratch import staged

_NOT_FEATURES = {"idx", "Index", "geohash", "ts_hm", "timestamp", "demand", "road_raw", "weather_raw", "vehicles_raw", "landmarks_raw", "road_type", "weather", "vehicles", "landmarks", "fold", "row_id"}


def feature_columns(df: DataFrame, exclude: tuple[str, ...] = ()) -> list[str]:
    return [c for c in df.columns if c not in _NOT_FEATURES and c not in exclude]


def interactions(df: DataFrame, cfg: FeatureConfig = FeatureConfig()) -> DataFrame:
    h = F.col("hour")
    df = df.withColumns(
        {
            "is_morning_peak": E.between(h, cfg.morning_hours).cast("int"), "is_evening_peak": E.between(h, cfg.evening_hours).cast("int"),
            "is_night": ((h >= 23) | (h <= 5)).cast("int"), "lanes_x_hour": F.col("lanes") * h, "is_highway": E.is_highway().cast("int"),
        }
    )
    df = df.withColumn("highway_x_slot", F.col("is_highway") * F.col("time_slot"))
    if "spatial_cluster" in df.columns:
        df = df.withColumns({"cluster_x_dow": F.col("spatial_cluster") * 7 + F.col("day_of_week"), "cluster_x_slot": F.col("spatial_cluster") * 96 + F.col("time_slot")})
    if "geohash_id" in df.columns:
        df = df.withColumn("gh_x_slot", F.col("geohash_id") * 96 + F.col("time_slot"))
    return df


@dataclass(frozen=True)
class FeatureModel:
    """What fitting leaves: scalars, and small tables that are staged, so no use of one computes it again.  Only ``fit`` makes one."""

    cfg: FeatureConfig
    medians: cleaning.Medians
    roads: DataFrame
    cells: DataFrame
    centers: DataFrame
    edges: DataFrame
    codes: dict[str, DataFrame]
    unseen: dict[str, int]
    means: dict[str, DataFrame]
    slots: DataFrame  # mean demand of every cell, day and slot
    train: DataFrame
    mean: float

    def _common(self, df: DataFrame) -> DataFrame:
        df = cleaning.time_features(prepare(df))
        df = cleaning.impute_mode(self.medians.transform(df), self.roads, "geohash", "road_type")
        df = spatial.nearest_center(cleaning.decode_coordinates(df, known=self.cells), self.centers)
        for column, table in self.codes.items():
            df = encoding.apply_labels(df, table, column, "geohash_id" if column == "geohash" else f"{column}_enc", fallback=self.unseen[column])
        return df

    def _fill(self, df: DataFrame, train: bool) -> DataFrame:
        value = 0.0 if train and self.cfg.fill_policy == "reference" else self.mean
        lagged = [c for c in df.columns if "_lag_9" in c or c.startswith(("demand_yesterday_mean_5", "demand_yesterday_std_5", "knn_lag96_mean", "demand_yesterday_rolling_mean", "yesterday_peak"))]
        return df.fillna(value, lagged).fillna(0.0, [c for c in ("knn_lag96_std", "demand_yesterday_rolling_std_9") if c in df.columns])

    def _lagged(self, df: DataFrame) -> DataFrame:
        # staged, as the regional means join it with its own aggregates
        df = staged(timeseries.lag_stats(timeseries.positional_lags(df, self.cfg.lags), self.cfg.lags), "lagged")
        return timeseries.regional_lags(df, self.cfg.regional_lags)

    def _looked_up(self, df: DataFrame) -> DataFrame:
        df = spatial.knn_lag(df, self.slots, self.edges)
        return timeseries.diurnal(timeseries.today_lags(df, self.slots, self.cfg.today_slots), self.slots, self.cfg.half_window)

    def transform_train(self) -> DataFrame:
        """Train features; its target encodings leave the row's own fold out."""
        df = self._fill(self._looked_up(self._lagged(self._common(self.train))), True)
        df = staged(timeseries.contiguous_folds(df, self.cfg.folds), "folded")
        for c in self.codes:
            df = encoding.oof_encode(df, c, f"{c}_te")
        return interactions(df, self.cfg)

    def transform(self, df: DataFrame) -> DataFrame:
        """Features of other rows, with train as their past."""
        known = self._common(self.train)
        mine = self._common(df.drop("demand"))
        df = timeseries.with_history(known, mine, self._lagged).drop("demand")
        df = self._fill(self._looked_up(df), False)
        for c, means in self.means.items():
            df = encoding.apply_means(df, means, self.mean, c, f"{c}_te")
        return interactions(df, self.cfg)


def prepare(df: DataFrame) -> DataFrame:
    """Cleaned categories; missing road types stay null for the modal imputation."""
    if "road_type" in df.columns:
        return df
    others = {new: raw for new, raw in (("weather", "weather_raw"), ("vehicles", "vehicles_raw"), ("landmarks", "landmarks_raw")) if raw in df.columns}
    return cleaning.clean_categories(cleaning.clean_categories(df, {"road_type": "road_raw"}, None), others)


def fit(train: DataFrame, cfg: FeatureConfig = FeatureConfig()) -> FeatureModel:
    """Everything that transforming needs, each table read from train once and staged."""
    clean = prepare(train)
    columns = ["geohash", *[c for c in cfg.categories if c in clean.columns]]
    cells = staged(spatial.centroids(clean), "cells")
    codes = {c: staged(encoding.label_codes(clean, c), "codes") for c in columns}
    slots = clean.groupBy("geohash", "day", "time_slot").agg(F.avg("demand").alias("demand"))
    return FeatureModel(
        cfg, cleaning.fit_medians(clean.select("lanes", "temperature")), staged(cleaning.fit_mode(clean, "geohash", "road_type"), "roads"), cells, spatial.kmeans_centers(cells, cfg.clusters, cfg.seed),
        staged(spatial.knn_edges(cells, cfg.neighbours), "edges"), codes, {c: encoding.unseen_code(t) for c, t in codes.items()},
        {c: staged(encoding.target_means(clean, c), "means") for c in columns}, staged(slots, "slots"), train, train.agg(F.avg("demand")).first()[0] or 0.0,
    )
