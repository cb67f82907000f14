"""Label and target encodings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def label_codes(df: DataFrame, column: str, null_class: str = "nan") -> DataFrame:
    """(value, code): lexicographic index of every distinct value; null is a class of its own name."""
    values = df.select(F.coalesce(F.col(column).cast("string"), F.lit(null_class)).alias("value")).distinct()
    return values.withColumn("code", (F.dense_rank().over(Window.orderBy("value")) - 1).cast("int"))


def unseen_code(codes: DataFrame, unknown: str = "Unknown") -> int:
    """The code of ``unknown``, else 0."""
    return codes.filter(F.col("value") == unknown).agg(F.max("code")).first()[0] or 0


def apply_labels(df: DataFrame, codes: DataFrame, column: str, name: str, unknown: str = "Unknown", null_class: str = "nan", fallback: int | None = None) -> DataFrame:
    """Codes of ``column``; what is unseen takes ``fallback``, or if that is not given the code of ``unknown``, else 0."""
    fallback = unseen_code(codes, unknown) if fallback is None else fallback
    seen = codes.select(F.col("value").alias("_v"), F.col("code").alias("_c"))
    joined = df.join(seen, F.coalesce(F.col(column).cast("string"), F.lit(null_class)) == F.col("_v"), "left")
    return joined.withColumn(name, F.coalesce("_c", F.lit(fallback))).drop("_v", "_c")


def target_means(df: DataFrame, column: str, target: str = "demand") -> DataFrame:
    return df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.avg(target).alias("_te"))


def oof_encode(df: DataFrame, column: str, name: str, fold: str = "fold", target: str = "demand") -> DataFrame:
    """Mean target of the category over the other folds; else the global mean.

    Sums per (category, fold) are subtracted from sums per category: two small
    aggregates, however many folds.
    """
    per = df.groupBy(column, fold).agg(F.sum(target).alias("_s"), F.count(target).alias("_n"))
    whole = Window.partitionBy(column)
    out = per.withColumn("_te", F.try_divide(F.sum("_s").over(whole) - F.coalesce("_s", F.lit(0.0)), F.sum("_n").over(whole) - F.col("_n")))
    out = out.filter(F.col(column).isNotNull()).select(F.col(column).alias("_k"), F.col(fold).alias("_f"), "_te")
    joined = df.join(out, (F.col(column) == F.col("_k")) & (F.col(fold) == F.col("_f")), "left")
    mean = df.agg(F.avg(target).alias("_m"))
    return joined.crossJoin(F.broadcast(mean)).withColumn(name, F.coalesce("_te", "_m")).drop("_k", "_f", "_te", "_m")


def apply_target_means(df: DataFrame, train: DataFrame, column: str, name: str, target: str = "demand") -> DataFrame:
    mean = train.agg(F.avg(target).alias("_m"))
    joined = df.join(target_means(train, column, target), column, "left").crossJoin(F.broadcast(mean))  # one row
    return joined.withColumn(name, F.coalesce("_te", "_m")).drop("_te", "_m")


def apply_means(df: DataFrame, means: DataFrame, mean: float, column: str, name: str) -> DataFrame:
    """The same from means that are fitted already."""
    return df.join(means, column, "left").withColumn(name, F.coalesce("_te", F.lit(mean))).drop("_te")
