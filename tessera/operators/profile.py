"""Exploratory tables; each is one small aggregate over the frame."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

QUANTILES = (0.01, 0.05, 0.10, 0.25, 0.50, 0.75, 0.90, 0.95, 0.99)


def null_counts(df: DataFrame) -> DataFrame:
    """(column, nulls), all columns in one pass."""
    row = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    return row.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("long").alias("nulls")) for c in df.columns])).alias("e")).select("e.*")


def duplicate_rows(df: DataFrame, exclude: tuple[str, ...] = ()) -> DataFrame:
    """Rows beyond the first of each set of equal rows."""
    kept = df.drop(*exclude)
    return kept.groupBy(*kept.columns).count().agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).cast("long").alias("duplicates"))


def describe(df: DataFrame, columns: list[str]) -> DataFrame:
    """count, mean, sample deviation, minimum, exact quartiles and maximum of each column."""
    q = {c: F.percentile(F.col(c).cast("double"), F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))) for c in columns}
    row = df.agg(*[F.struct(F.count(c).alias("n"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"), F.min(c).cast("double").alias("min"), q[c].alias("q"), F.max(c).cast("double").alias("max")).alias(c) for c in columns])
    return row.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("s")) for c in columns])).alias("e")).select(
        "e.column", "e.s.n", "e.s.mean", "e.s.std", "e.s.min", F.get("e.s.q", F.lit(0)).alias("q25"), F.get("e.s.q", F.lit(1)).alias("median"), F.get("e.s.q", F.lit(2)).alias("q75"), "e.s.max"
    )


def moments(df: DataFrame, column: str) -> DataFrame:
    """Population skewness and excess kurtosis."""
    return df.agg(F.skewness(column).alias("skewness"), F.kurtosis(column).alias("kurtosis"))


def quantiles(df: DataFrame, column: str, qs=QUANTILES) -> DataFrame:
    """(q, value): exact, interpolated."""
    row = df.agg(F.percentile(column, F.array(*map(F.lit, qs))).alias("v"))
    return row.select(F.posexplode("v").alias("i", "value")).select(F.get(F.array(*map(F.lit, qs)), F.col("i")).alias("q"), "value")


def percentile_curve(df: DataFrame, column: str, points: int = 100) -> DataFrame:
    row = df.agg(F.percentile(column, F.array(*[F.lit(i / (points - 1)) for i in range(points)])).alias("v"))
    return row.select(F.posexplode("v").alias("point", "value"))


def iqr_outliers(df: DataFrame, column: str, k: float = 1.5) -> DataFrame:
    fences = df.agg(F.percentile(column, F.lit(0.25)).alias("q1"), F.percentile(column, F.lit(0.75)).alias("q3"))
    fences = fences.select("q1", "q3", (F.col("q1") - k * (F.col("q3") - F.col("q1"))).alias("low"), (F.col("q3") + k * (F.col("q3") - F.col("q1"))).alias("high"))
    marked = df.select(column).crossJoin(F.broadcast(fences))  # one row
    out = marked.groupBy("q1", "q3", "low", "high").agg(F.count_if((F.col(column) < F.col("low")) | (F.col(column) > F.col("high"))).alias("outliers"), F.count(column).alias("n"))
    return out.select("q1", "q3", "low", "high", "outliers", (100.0 * F.col("outliers") / F.col("n")).alias("percent"))


def mean_by(df: DataFrame, key: str, value: str = "demand") -> DataFrame:
    """Mean, deviation and half-width of its 95 % interval by key, null keys left out."""
    return df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.avg(value).alias("mean"), F.count(value).alias("n"), (1.96 * F.stddev_samp(value) / F.sqrt(F.count(value))).alias("ci95"))


def pivot_mean(df: DataFrame, row: str, column: str, values: list[int], prefix: str, value: str = "demand") -> DataFrame:
    """One pass with a conditional mean for each listed value."""
    return df.groupBy(row).agg(*[F.avg(F.when(F.col(column) == v, F.col(value))).alias(f"{prefix}{v}") for v in values])


def histogram(df: DataFrame, column: str, low: float, high: float, bins: int = 50) -> DataFrame:
    """(bin, n) over equal bins of [low, high]; the last bin is closed."""
    at = F.least(F.floor((F.col(column) - low) / ((high - low) / bins)), F.lit(bins - 1)).cast("int")
    return df.filter(F.col(column).between(low, high)).groupBy(at.alias("bin")).agg(F.count("*").alias("n"))


def density(df: DataFrame, column: str, points: list[float], bandwidth: float) -> DataFrame:
    """Gaussian kernel density at fixed points, as one aggregate."""
    scale = 1 / (bandwidth * (2 * 3.141592653589793) ** 0.5)
    each = [F.avg(scale * F.exp(-F.pow((F.col(column) - p) / bandwidth, 2) / 2)) for p in points]
    row = df.agg(F.array(*each).alias("v"))
    return row.select(F.posexplode("v").alias("i", "density")).select(F.get(F.array(*map(F.lit, points)), F.col("i")).alias("point"), "density")


def box_stats(df: DataFrame, key: str, value: str = "demand") -> DataFrame:
    q = F.percentile(value, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    return df.filter(F.col(key).isNotNull()).groupBy(key).agg(q.alias("q")).select(key, *[F.get("q", F.lit(i)).alias(n) for i, n in enumerate(("q25", "median", "q75"))])


def safe_corr(a: str, b: str):
    """Pearson correlation over rows where both are present; null where one is constant."""
    x, y = F.when(F.col(b).isNotNull(), F.col(a).cast("double")), F.when(F.col(a).isNotNull(), F.col(b).cast("double"))
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """(a, b, corr) of every pair a <= b, in one pass."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    row = df.agg(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), safe_corr(a, b).alias("corr")) for a, b in pairs]).alias("p"))
    return row.select(F.explode("p").alias("e")).select("e.*")


def target_correlations(df: DataFrame, columns: list[str], target: str = "demand") -> DataFrame:
    row = df.agg(F.array(*[F.struct(F.lit(c).alias("column"), safe_corr(c, target).alias("corr")) for c in columns]).alias("p"))
    return row.select(F.explode("p").alias("e")).select("e.*").orderBy(F.desc_nulls_last("corr"), "column")


def hot_spots(df: DataFrame, n: int = 10, descending: bool = True) -> DataFrame:
    """Cells by mean demand: a take-ordered plan, no full sort."""
    stats = df.groupBy("geohash").agg(F.avg("demand").alias("mean_demand"), F.count("*").alias("n"))
    key = F.desc("mean_demand") if descending else F.asc("mean_demand")
    return stats.orderBy(key, "geohash").limit(n)


def report(title: str, tables: dict[str, DataFrame], rows: int = 20) -> str:
    """Markdown of small tables; each is shown up to ``rows`` rows."""
    out = [f"# {title}", ""]
    for name, df in tables.items():
        out += [f"## {name}", "", "| " + " | ".join(df.columns) + " |", "|" + "-|" * len(df.columns)]
        out += ["| " + " | ".join(f"{v:.6g}" if isinstance(v, float) else str(v) for v in r) + " |" for r in df.limit(rows).collect()]
        out.append("")
    return "\n".join(out)


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
