"""The ordered correction rules; each is a projection over small joined means."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.config import PostConfig
from tessera.functions import exprs as E


def highway_calibration(df: DataFrame, train: DataFrame, cfg: PostConfig = PostConfig(), p: str = "p") -> DataFrame:
    """Highway rows scaled to the training mean of highways, at most by ``cap_scale``."""
    own = train.agg(F.avg(F.when(E.is_highway(), F.col("demand"))).alias("_y"))
    theirs = df.agg(F.avg(F.when(E.is_highway(), F.col(p))).alias("_q"))
    scale = F.when(F.col("_y").isNull() | F.col("_q").isNull() | (F.col("_q") <= 0), 1.0).otherwise(F.least(E.ratio("_y", "_q"), F.lit(cfg.cap_scale)))
    both = df.crossJoin(F.broadcast(own)).crossJoin(F.broadcast(theirs))  # one row each
    return both.withColumn(p, F.when(E.is_highway() & F.col("_y").isNotNull() & F.col("_q").isNotNull(), E.clip(F.col(p) * scale)).otherwise(F.col(p))).drop("_y", "_q")


def midrange_shrink(df: DataFrame, cfg: PostConfig = PostConfig(), p: str = "p") -> DataFrame:
    return df.withColumn(p, F.when(E.is_highway() & (F.col(p) < cfg.shrink_below), F.col(p) * cfg.shrink).otherwise(F.col(p)))


def lag_means(train: DataFrame, day: int) -> DataFrame:
    return train.filter(F.col("day") == day).groupBy("geohash", "time_slot").agg(F.avg("demand").alias("_lag"))


def _blended(cfg: PostConfig, p: str) -> Column:
    return E.clip(F.coalesce(cfg.lag_weight * F.col("_lag") + (1 - cfg.lag_weight) * F.col(p), F.col(p)))


def _corrected(cfg: PostConfig, p: str, factor: Column) -> Column:
    moved = E.clip(F.col(p) * F.coalesce(factor, F.lit(1.0)))
    return E.clip((1 - cfg.trend_weight) * F.col(p) + cfg.trend_weight * moved)


def _surged(cfg: PostConfig, p: str, ratio: Column) -> Column:
    hit = F.col("geohash").isin(*cfg.surge) & F.col("_lag").isNotNull() & ratio.isNotNull()
    return F.when(hit, F.least(F.col("_lag") * ratio, F.lit(1.0))).otherwise(F.col(p))


def _trend(cfg: PostConfig) -> Column:
    return F.when(F.col("m_fit").isNotNull() & F.col("m_val").isNotNull(), E.clip(E.ratio("m_val", "m_fit"), cfg.trend_low, cfg.trend_high))


def lag_blend(df: DataFrame, train: DataFrame, cfg: PostConfig = PostConfig(), p: str = "p") -> DataFrame:
    """Mixed with the cell's own mean at the slot on the fit day, where there is one."""
    joined = df.join(lag_means(train, cfg.fit_day), ["geohash", "time_slot"], "left")
    return joined.withColumn(p, _blended(cfg, p)).drop("_lag")


def day_means(train: DataFrame, cfg: PostConfig = PostConfig()) -> DataFrame:
    """(geohash, m_fit, m_val): both days' means in one aggregate."""
    on = lambda d: F.avg(F.when(F.col("day") == d, F.col("demand")))
    return train.filter(F.col("day").isin(cfg.fit_day, cfg.val_day)).groupBy("geohash").agg(on(cfg.fit_day).alias("m_fit"), on(cfg.val_day).alias("m_val"))


def trend_factors(train: DataFrame, cfg: PostConfig = PostConfig()) -> DataFrame:
    return day_means(train, cfg).dropna(subset=["m_fit", "m_val"]).select("geohash", _trend(cfg).alias("sf"))


def trend_correct(df: DataFrame, train: DataFrame, cfg: PostConfig = PostConfig(), p: str = "p") -> DataFrame:
    joined = df.join(day_means(train, cfg), "geohash", "left")
    return joined.withColumn(p, _corrected(cfg, p, _trend(cfg))).drop("m_fit", "m_val")


def surge_override(df: DataFrame, train: DataFrame, cfg: PostConfig = PostConfig(), p: str = "p") -> DataFrame:
    """Listed cells take their fit-day mean at the slot times the unclipped day ratio."""
    joined = df.join(lag_means(train, cfg.fit_day), ["geohash", "time_slot"], "left").join(day_means(train, cfg), "geohash", "left")
    return joined.withColumn(p, _surged(cfg, p, E.ratio("m_val", "m_fit"))).drop("_lag", "m_fit", "m_val")


def bias_subtract(df: DataFrame, cfg: PostConfig = PostConfig(), p: str = "p") -> DataFrame:
    return df.withColumn(p, E.clip(F.col(p) - cfg.bias))


def all_rules(df: DataFrame, train: DataFrame, cfg: PostConfig = PostConfig(), p: str = "p") -> DataFrame:
    """The six rules in their order; the lag and day means are joined once for the three rules that use them."""
    df = midrange_shrink(highway_calibration(df, train, cfg, p), cfg, p)
    df = df.join(lag_means(train, cfg.fit_day), ["geohash", "time_slot"], "left").join(day_means(train, cfg), "geohash", "left")
    df = df.withColumn(p, _blended(cfg, p)).withColumn(p, _corrected(cfg, p, _trend(cfg))).withColumn(p, _surged(cfg, p, E.ratio("m_val", "m_fit")))
    return bias_subtract(df.drop("_lag", "m_fit", "m_val"), cfg, p)
