"""Lags, regional and neighbour aggregates, and yesterday's windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import exprs as E

ORDER = ("day", "time_slot", "idx")


def _panel():
    return Window.partitionBy("geohash").orderBy(*ORDER)


def positional_lags(df: DataFrame, lags=(94, 95, 96, 97, 98), value: str = "demand") -> DataFrame:
    """The value so many rows before in its cell; one exchange and sort for all lags."""
    return df.withColumns({f"{value}_lag_{n}": F.lag(value, n).over(_panel()) for n in lags})


def lag_stats(df: DataFrame, lags=(94, 95, 96, 97, 98), value: str = "demand") -> DataFrame:
    mean, std = E.array_mean_std([F.col(f"{value}_lag_{n}") for n in lags])
    return df.withColumns({"demand_yesterday_mean_5": mean, "demand_yesterday_std_5": std})


def calendar_lag(df: DataFrame, ref: DataFrame, days: int = 1, name: str = "calendar_lag") -> DataFrame:
    """Mean value of the cell at the same slot so many days before."""
    past = ref.groupBy("geohash", (F.col("day") + days).alias("day"), "time_slot").agg(F.avg("demand").alias(name))
    return df.join(past, ["geohash", "day", "time_slot"], "left")


def regional_means(df: DataFrame) -> DataFrame:
    """reg5 and reg4: mean over cells of a common prefix at the same day and slot, own row included."""
    df = df.withColumns({"p5": E.prefix("geohash", 1), "p4": E.prefix("geohash", 2)})
    for name, p in (("reg5", "p5"), ("reg4", "p4")):
        means = df.groupBy("day", "time_slot", p).agg(F.avg("demand").alias(name))
        df = df.join(means, ["day", "time_slot", p], "left")
    return df.drop("p5", "p4")


def regional_lags(df: DataFrame, lags=(95, 96, 97)) -> DataFrame:
    named = {f"{r}_demand_lag_{n}": F.lag(r, n).over(_panel()) for r in ("reg5", "reg4") for n in lags}
    return regional_means(df).withColumns(named).drop("reg5", "reg4")


def with_history(train: DataFrame, test: DataFrame, operator) -> DataFrame:
    """``operator`` over train and test together; only the test rows come back, whatever their order."""
    both = train.withColumn("is_test", F.lit(False)).unionByName(test.withColumn("is_test", F.lit(True)), allowMissingColumns=True)
    return operator(both).filter("is_test").drop("is_test")


def today_lags(df: DataFrame, ref: DataFrame, slots: int = 9) -> DataFrame:
    """demand_today_lag_k: the same day's mean at slot k, known to rows of later slots alone."""
    pivot = ref.filter(F.col("time_slot") < slots).groupBy("day", "geohash").agg(*[F.avg(F.when(F.col("time_slot") == k, F.col("demand"))).alias(f"t{k}") for k in range(slots)])
    joined = df.join(pivot, ["day", "geohash"], "left")
    return joined.withColumns({f"demand_today_lag_{k}": F.when(F.col("time_slot") > k, F.col(f"t{k}")) for k in range(slots)}).drop(*[f"t{k}" for k in range(slots)])


def diurnal(df: DataFrame, ref: DataFrame, half: int = 4) -> DataFrame:
    """Yesterday's mean and population deviation over the slots around the row's, and the peak means.

    The reference's slot means, moved a day ahead, and the rows are one ordered
    sequence per cell and day, so the band is a range frame and no row is multiplied.
    """
    slots = ref.groupBy("geohash", (F.col("day") + 1).alias("day"), "time_slot").agg(F.avg("demand").alias("_v"))
    both = df.withColumn("_mine", F.lit(True)).unionByName(slots.withColumn("_mine", F.lit(False)), allowMissingColumns=True)
    band = Window.partitionBy("geohash", "day").orderBy("time_slot").rangeBetween(-half, half)
    seen = both.withColumns({"demand_yesterday_rolling_mean_9": F.avg("_v").over(band), "demand_yesterday_rolling_std_9": F.stddev_pop("_v").over(band)}).filter("_mine").drop("_mine", "_v")
    return seen.join(peak_means(ref).withColumn("day", F.col("day") + 1), ["geohash", "day"], "left")


def peak_means(ref: DataFrame, morning=(28, 40), evening=(68, 80)) -> DataFrame:
    """(geohash, day, means over the morning and evening slots of slot means)."""
    slots = ref.groupBy("geohash", "day", "time_slot").agg(F.avg("demand").alias("v"))
    over = lambda b: F.avg(F.when(F.col("time_slot").between(*b), F.col("v")))
    return slots.groupBy("geohash", "day").agg(over(morning).alias("yesterday_peak_morning_mean"), over(evening).alias("yesterday_peak_evening_mean"))


#: Ids that share a bucket of the chronology check.
BUCKET = 1 << 16


def chronology_breaks(df: DataFrame, key: str = "idx") -> DataFrame:
    """Rows whose slot lies before that of the row before, in the order of an integer ``key``.

    The comparison needs only neighbours, so it is made per bucket of the key:
    each bucket's own steps, and one step between buckets.  A bucket is a function
    of the key alone, so no two exchanges can differ about it; the last window
    holds one row for each bucket.
    """
    within, step = Window.partitionBy("_b").orderBy(key), F.col("day") * 100 + F.col("time_slot")
    rows = df.select(F.col(key), step.alias("_s"), F.floor(F.col(key) / BUCKET).alias("_b")).withColumn("_before", F.lag("_s").over(within))
    ends = rows.groupBy("_b").agg(F.count_if(F.col("_s") < F.col("_before")).alias("_n"), F.min_by("_s", key).alias("_first"), F.max_by("_s", key).alias("_last"))
    both = ends.withColumn("_prior", F.lag("_last").over(Window.orderBy("_b")))
    breaks = F.coalesce(F.sum(F.col("_n") + F.coalesce((F.col("_first") < F.col("_prior")).cast("long"), F.lit(0))), F.lit(0))
    return both.agg(breaks.cast("long").alias("breaks")).withColumn("chronological", F.col("breaks") == 0)


def contiguous_folds(df: DataFrame, k: int = 5, order=ORDER, name: str = "fold") -> DataFrame:
    """Fold 0..k-1 by position in the order: the first n % k folds are one row longer.

    A row's position is the number of rows under lesser leading columns of the
    order (day and slot), counted once by an aggregate with a row for each, and
    its number among those that share them.  Both depend on the row alone, not on
    how a range exchange happened to cut; the window over the counts holds a row
    for each slot of the calendar.  Null keys come first and are kept.
    """
    if k == 1:
        return df.withColumn(name, F.lit(0))
    lead = list(order[:-1])
    counts = df.groupBy(*[F.col(c).alias(f"_k_{c}") for c in lead]).agg(F.count("*").alias("_n"))
    upto = Window.orderBy(*[f"_k_{c}" for c in lead])
    offsets = counts.select("*", (F.sum("_n").over(upto) - F.col("_n")).alias("_off"), F.sum("_n").over(Window.partitionBy()).alias("_all")).drop("_n")
    on = F.lit(True)
    for c in lead:
        on = on & F.col(c).eqNullSafe(F.col(f"_k_{c}"))
    among = F.row_number().over(Window.partitionBy(*lead).orderBy(order[-1]))
    placed = df.withColumn("_i", among - 1).join(offsets, on).withColumn("_i", F.col("_i") + F.col("_off"))
    size, extra = F.floor(F.col("_all") / k), F.col("_all") % k
    long_rows = extra * (size + 1)
    fold = F.when(F.col("_i") < long_rows, F.floor(F.col("_i") / (size + 1))).otherwise(extra + F.floor((F.col("_i") - long_rows) / F.greatest(size, F.lit(1))))
    return placed.withColumn(name, fold.cast("int")).drop("_off", "_all", "_i", *[f"_k_{c}" for c in lead])
