"""Every panel query by name, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.config import FeatureConfig, PostConfig
from tessera.functions import exprs as E
from tessera.operators import cleaning, encoding, models, postprocess, profile, spatial, timeseries
from tessera.plans import features, scoring
from tessera.sources.tables import demand_obs
from tessera.streaming.slots import slot_demand

#: The corrections, for the days and cells of the test tables' panel.
POST = PostConfig(fit_day=28, val_day=29, surge=("qp0b40", "qp0b41", "qp0b50", "qp0c40", "qp0c51", "qp0c62"))

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# The panel in the oracle's dialect.
OBS_SQL = """WITH b AS (
  SELECT event_id AS idx, CAST(user_id % 24 AS INT) AS cell, CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS INT) AS day,
         CAST(hour(ts) AS INT) AS hh, CAST(minute(ts) AS INT) AS mm, CAST(hour(ts) * 4 + floor(minute(ts) / 15) AS INT) AS time_slot,
         event_type, value, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events),
raw AS (
  SELECT idx, concat('qp0', substr('0123456789bcdefghjkmnpqrstuvwxyz', CAST(10 + floor(cell / 12) AS INT), 1), substr('0123456789bcdefghjkmnpqrstuvwxyz', CAST(4 + floor((cell % 12) / 4) AS INT), 1), substr('0123456789bcdefghjkmnpqrstuvwxyz', cell % 4 + 1, 1)) AS geohash,
         day, concat(CAST(hh AS VARCHAR), ':', CAST(mm AS VARCHAR)) AS ts_hm, hh AS hour, mm AS minute, time_slot, least(value / 600.0, 1.0) AS demand,
         CASE event_type WHEN 'purchase' THEN ' HIGHWAY ' WHEN 'view' THEN 'residential' WHEN 'click' THEN 'Street' WHEN 'signup' THEN 'None' ELSE NULL END AS road_raw,
         CASE WHEN k % 30 = 0 THEN NULL ELSE CAST(1 + cell % 5 AS INT) END AS lanes, CASE WHEN k % 11 = 0 THEN NULL ELSE CAST(k AS DOUBLE) / 4 END AS temperature,
         CASE k % 4 WHEN 0 THEN 'sunny' WHEN 1 THEN 'RAINY' WHEN 2 THEN 'foggy' ELSE NULL END AS weather_raw FROM b),
obs AS (
  SELECT *, CASE WHEN trim(road_raw) = 'None' THEN NULL ELSE upper(substr(trim(road_raw), 1, 1)) || lower(substr(trim(road_raw), 2)) END AS road_type,
         coalesce(upper(substr(weather_raw, 1, 1)) || lower(substr(weather_raw, 2)), 'Unknown') AS weather, 0.02 + (idx % 97) / 120.0 AS p,
         substr(geohash, 1, 5) AS p5, substr(geohash, 1, 4) AS p4 FROM raw),
train AS (SELECT * FROM obs WHERE day < 29 OR time_slot <= 8),
test AS (SELECT * FROM obs WHERE day = 29 AND time_slot BETWEEN 9 AND 55),
slots AS (SELECT geohash, day, time_slot, avg(demand) AS v FROM obs GROUP BY ALL)"""


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = f"{OBS_SQL}\n{sql.strip()}" if not sql.lstrip().startswith(("WITH", ",")) else OBS_SQL + sql if sql.lstrip().startswith(",") else sql
        return f

    return add


def obs(spark: SparkSession, d: str) -> DataFrame:
    """The panel with cleaned categories and a deterministic stand-in prediction."""
    return features.prepare(demand_obs(spark, d)).withColumn("p", 0.02 + (F.col("idx") % 97) / 120.0)


def train_test(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    o = obs(spark, d)
    return o.filter("day < 29 or time_slot <= 8"), o.filter("day = 29 and time_slot between 9 and 55")


def r6(*columns: str) -> list:
    return [F.round(F.col(c).cast("double"), 6).alias(c) for c in columns]


def rr(*columns: str) -> str:
    """The same rounding for the oracle."""
    return ", ".join(f"round(CAST({c} AS DOUBLE), 6) AS {c}" for c in columns)


def f32(*columns: str) -> list:
    """For results whose last bits depend on the order of a sum: rounded to floats, which no tie of decimal values can tip."""
    return [F.col(c).cast("float").cast("double").alias(c) for c in columns]


def d32(*columns: str) -> list:
    """The same for deviations; below 1e-9 they are none."""
    return [F.when(F.col(c) < 1e-9, 0.0).otherwise(F.col(c)).cast("float").cast("double").alias(c) for c in columns]


def ff(*columns: tuple[str, str]) -> str:
    """f32 for the oracle, from (expression, name)."""
    return ", ".join(f"CAST(CAST({e} AS FLOAT) AS DOUBLE) AS {n}" for e, n in columns)


def dd(*columns: tuple[str, str]) -> str:
    return ", ".join(f"CAST(CAST(CASE WHEN {e} < 1e-9 THEN 0 ELSE {e} END AS FLOAT) AS DOUBLE) AS {n}" for e, n in columns)


# ---- scalars ---------------------------------------------------------------


@query("hourly_mean", "SELECT hour, round(avg(demand), 6) AS mean_demand, count(*) AS n FROM obs GROUP BY hour")
def hourly_mean(spark, d):
    return profile.mean_by(obs(spark, d), "hour").select("hour", F.round("mean", 6).alias("mean_demand"), "n")


@query("time_features", "SELECT idx, hour, minute, time_slot, round(sin(2 * pi() * time_slot / 96), 6) + 0.0 AS sin_time, round(cos(2 * pi() * time_slot / 96), 6) + 0.0 AS cos_time, CAST(day % 7 AS INT) AS day_of_week, CAST(day % 7 IN (5, 6) AS INT) AS is_weekend FROM obs")
def time_features(spark, d):
    return cleaning.time_features(obs(spark, d).drop("hour", "minute", "time_slot")).select("idx", "hour", "minute", "time_slot", *[(c + 0.0).alias(n) for c, n in zip(r6("sin_time", "cos_time"), ("sin_time", "cos_time"))], "day_of_week", "is_weekend")


@query("clean_categories", "SELECT idx, coalesce(road_type, 'Unknown') AS road_type, coalesce(weather, 'Unknown') AS weather FROM obs")
def clean_categories(spark, d):
    return cleaning.clean_categories(demand_obs(spark, d), {"road_type": "road_raw", "weather": "weather_raw"}).select("idx", "road_type", "weather")


_DECODE = """, chars AS (SELECT geohash, i, strpos('0123456789bcdefghjkmnpqrstuvwxyz', substr(geohash, i, 1)) - 1 AS v FROM (SELECT DISTINCT geohash FROM obs), range(1, 7) r(i)),
bits AS (SELECT geohash, (i - 1) * 5 + j AS pos, (v >> (4 - j)) & 1 AS bit FROM chars, range(0, 5) s(j)),
cells AS (SELECT geohash, -90 + sum(CASE WHEN pos % 2 = 1 THEN bit * 180.0 / pow(2, (pos + 1) / 2) ELSE 0 END) + 90.0 / pow(2, 15) AS latitude,
                 -180 + sum(CASE WHEN pos % 2 = 0 THEN bit * 360.0 / pow(2, pos / 2 + 1) ELSE 0 END) + 180.0 / pow(2, 15) AS longitude FROM bits GROUP BY geohash)
"""
_DECODE = _DECODE.replace("(pos + 1) / 2)", "(pos + 1) // 2)").replace("pos / 2 + 1", "pos // 2 + 1")


@query("geohash_decode", _DECODE + "SELECT geohash, round(latitude, 9) AS latitude, round(longitude, 9) AS longitude FROM cells")
def geohash_decode(spark, d):
    cells = spatial.centroids(obs(spark, d))
    return cells.select("geohash", F.round("latitude", 9).alias("latitude"), F.round("longitude", 9).alias("longitude"))


@query("geohash_prefix", "SELECT DISTINCT geohash, p5, p4 FROM obs")
def geohash_prefix(spark, d):
    return obs(spark, d).select("geohash", E.prefix("geohash", 1).alias("p5"), E.prefix("geohash", 2).alias("p4")).distinct()


@query("month_weekend", "SELECT DISTINCT day, CAST((day // 30) % 12 + 1 AS INT) AS month, CAST(day % 7 IN (5, 6) AS INT) AS is_weekend FROM obs")
def month_weekend(spark, d):
    return obs(spark, d).select("day", E.month().alias("month"), E.is_weekend().alias("is_weekend")).distinct()


@query("interactions", """SELECT idx, CAST(hour BETWEEN 7 AND 10 AS INT) AS is_morning_peak, CAST(hour BETWEEN 17 AND 20 AS INT) AS is_evening_peak, CAST(hour >= 23 OR hour <= 5 AS INT) AS is_night,
 lanes * hour AS lanes_x_hour, CAST(coalesce(road_type = 'Highway', false) OR coalesce(lanes >= 4, false) AS INT) AS is_highway,
 CAST(coalesce(road_type = 'Highway', false) OR coalesce(lanes >= 4, false) AS INT) * time_slot AS highway_x_slot FROM obs""")
def interactions(spark, d):
    return features.interactions(obs(spark, d)).select("idx", "is_morning_peak", "is_evening_peak", "is_night", "lanes_x_hour", "is_highway", "highway_x_slot")


@query("clip_weights", "SELECT idx, round(least(greatest(p * 3 - 0.5, 0), 1), 6) AS clipped, round(1 + p * p, 6) AS weight FROM obs")
def clip_weights(spark, d):
    return obs(spark, d).select("idx", F.round(E.clip(F.col("p") * 3 - 0.5), 6).alias("clipped"), F.round(E.sample_weight("p"), 6).alias("weight"))


# ---- imputation ------------------------------------------------------------


@query("median_impute", "SELECT idx, coalesce(CAST(lanes AS DOUBLE), (SELECT median(lanes) FROM train)) AS lanes, coalesce(temperature, (SELECT median(temperature) FROM train)) AS temperature FROM obs")
def median_impute(spark, d):
    train, _ = train_test(spark, d)
    return cleaning.fit_medians(train.select("lanes", "temperature")).transform(obs(spark, d)).select("idx", "lanes", "temperature")


_MODE = ", counts AS (SELECT geohash, road_type, count(*) AS c FROM train WHERE road_type IS NOT NULL GROUP BY ALL), modes AS (SELECT geohash, road_type AS mode FROM counts QUALIFY row_number() OVER (PARTITION BY geohash ORDER BY c DESC, road_type) = 1) "


@query("mode_fit", _MODE + "SELECT geohash, mode FROM modes")
def mode_fit(spark, d):
    return cleaning.fit_mode(train_test(spark, d)[0], "geohash", "road_type")


@query("mode_impute", _MODE + "SELECT idx, coalesce(road_type, mode) AS road_type FROM obs LEFT JOIN modes USING (geohash)")
def mode_impute(spark, d):
    modes = cleaning.fit_mode(train_test(spark, d)[0], "geohash", "road_type")
    return cleaning.impute_mode(obs(spark, d), modes, "geohash", "road_type").select("idx", "road_type")


@query("coord_fallback", _DECODE + ", c AS (SELECT idx, CASE WHEN idx % 10 > 0 THEN latitude END AS latitude, CASE WHEN idx % 10 > 0 THEN longitude END AS longitude FROM obs JOIN cells USING (geohash)) SELECT idx, round(coalesce(latitude, (SELECT median(latitude) FROM c)), 6) AS latitude, round(coalesce(longitude, (SELECT median(longitude) FROM c)), 6) AS longitude FROM c")
def coord_fallback(spark, d):
    o = obs(spark, d)
    bad = o.withColumn("geohash", F.when(F.col("idx") % 10 > 0, F.col("geohash")).otherwise("qp!a"))
    return cleaning.coordinate_fallback(cleaning.decode_coordinates(bad)).select("idx", *r6("latitude", "longitude"))


_NULLABLE = ["road_type", "weather", "lanes", "temperature", "demand"]


@query("null_counts", "SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) - count({c}) AS nulls FROM obs" for c in _NULLABLE) + ")")
def null_counts(spark, d):
    return profile.null_counts(obs(spark, d).select(*_NULLABLE))


# ---- profile ---------------------------------------------------------------


@query("describe", "SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count({c}) AS n, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std, round(CAST(min({c}) AS DOUBLE), 6) AS min, round(CAST(quantile_cont(CAST({c} AS DOUBLE), 0.25) AS DOUBLE), 6) AS q25, round(CAST(quantile_cont(CAST({c} AS DOUBLE), 0.5) AS DOUBLE), 6) AS median, round(CAST(quantile_cont(CAST({c} AS DOUBLE), 0.75) AS DOUBLE), 6) AS q75, round(CAST(max({c}) AS DOUBLE), 6) AS max FROM obs" for c in ("demand", "temperature", "lanes")) + ")")
def describe(spark, d):
    return profile.describe(obs(spark, d), ["demand", "temperature", "lanes"]).select("column", "n", *r6("mean", "std", "min", "q25", "median", "q75", "max"))


@query("moments", ", m AS (SELECT avg(demand) AS mu, stddev_pop(demand) AS sd FROM obs) SELECT round(avg(pow((demand - mu) / sd, 3)), 6) AS skewness, round(avg(pow((demand - mu) / sd, 4)) - 3, 6) AS kurtosis FROM obs, m")
def moments(spark, d):
    return profile.moments(obs(spark, d), "demand").select(*r6("skewness", "kurtosis"))


@query("quantiles", "SELECT CAST(q AS DOUBLE) AS q, round(value, 6) AS value FROM (SELECT unnest([0.01,0.05,0.10,0.25,0.50,0.75,0.90,0.95,0.99]) AS q, unnest(quantile_cont(demand, [0.01,0.05,0.10,0.25,0.50,0.75,0.90,0.95,0.99])) AS value FROM obs)")
def quantiles(spark, d):
    return profile.quantiles(obs(spark, d), "demand").select("q", *r6("value"))


@query("percentile_curve", "SELECT CAST(generate_subscripts(v, 1) - 1 AS INT) AS point, round(unnest(v), 6) AS value FROM (SELECT quantile_cont(demand, [" + ",".join(repr(i / 99) for i in range(100)) + "]) AS v FROM obs)")
def percentile_curve(spark, d):
    return profile.percentile_curve(obs(spark, d), "demand").select("point", *r6("value"))


@query("iqr_outliers", ", q AS (SELECT quantile_cont(demand, 0.25) AS q1, quantile_cont(demand, 0.75) AS q3 FROM obs), f AS (SELECT *, q1 - 1.5 * (q3 - q1) AS low, q3 + 1.5 * (q3 - q1) AS high FROM q) SELECT round(any_value(q1), 6) AS q1, round(any_value(q3), 6) AS q3, round(any_value(low), 6) AS low, round(any_value(high), 6) AS high, count(*) FILTER (demand < low OR demand > high) AS outliers, round(100.0 * count(*) FILTER (demand < low OR demand > high) / count(*), 6) AS percent FROM obs, f")
def iqr_outliers(spark, d):
    return profile.iqr_outliers(obs(spark, d), "demand").select(*r6("q1", "q3", "low", "high"), "outliers", *r6("percent"))


@query("dup_count", "SELECT CAST(count(*) - count(DISTINCT (geohash, day, time_slot, coalesce(road_raw, '~'))) AS BIGINT) AS duplicates FROM obs")
def dup_count(spark, d):
    return profile.duplicate_rows(obs(spark, d).select("idx", "geohash", "day", "time_slot", "road_raw"), ("idx",))


def _mean(name: str, key: str, sql_key: str):
    @query(name, f"SELECT {sql_key} AS {key}, round(avg(demand), 6) AS mean, count(*) AS n, round(1.96 * stddev_samp(demand) / sqrt(count(*)), 6) AS ci95 FROM obs WHERE {sql_key} IS NOT NULL GROUP BY 1")
    def run(spark, d):
        o = obs(spark, d).withColumns({"day_of_week": E.day_of_week(), "is_weekend": E.is_weekend()})
        return profile.mean_by(o, key).select(key, *r6("mean"), "n", *r6("ci95"))


_mean("weekly_mean", "day_of_week", "CAST(day % 7 AS INT)")
_mean("weekend_mean", "is_weekend", "CAST(day % 7 IN (5, 6) AS INT)")
_mean("weather_mean", "weather", "weather")
_mean("slot_mean", "time_slot", "time_slot")


@query("weather_order", "SELECT weather, round(avg(demand), 6) AS mean, CAST(row_number() OVER (ORDER BY avg(demand) DESC, weather) AS INT) AS place FROM obs WHERE weather IS NOT NULL GROUP BY weather")
def weather_order(spark, d):
    means = profile.mean_by(obs(spark, d), "weather")
    return means.select("weather", *r6("mean"), F.row_number().over(Window.orderBy(F.desc("mean"), "weather")).alias("place"))


@query("hour_dow_pivot", "SELECT hour, " + ", ".join(f"round(avg(demand) FILTER (day % 7 = {k}), 6) AS dow{k}" for k in range(7)) + " FROM obs GROUP BY hour")
def hour_dow_pivot(spark, d):
    out = profile.pivot_mean(obs(spark, d).withColumn("dow", E.day_of_week()), "hour", "dow", list(range(7)), "dow")
    return out.select("hour", *r6(*[f"dow{k}" for k in range(7)]))


@query("box_stats", "SELECT hour, " + ", ".join(f"round(quantile_cont(demand, {q}), 6) AS {n}" for q, n in ((0.25, "q25"), (0.5, "median"), (0.75, "q75"))) + " FROM obs GROUP BY hour")
def box_stats(spark, d):
    return profile.box_stats(obs(spark, d), "hour").select("hour", *r6("q25", "median", "q75"))


@query("geohash_stats", _DECODE + "SELECT geohash, round(any_value(latitude), 6) AS latitude, round(any_value(longitude), 6) AS longitude, round(avg(demand), 6) AS mean_demand, count(*) AS n FROM obs JOIN cells USING (geohash) GROUP BY geohash")
def geohash_stats(spark, d):
    o = cleaning.decode_coordinates(obs(spark, d))
    return o.groupBy("geohash").agg(F.first("latitude").alias("latitude"), F.first("longitude").alias("longitude"), F.avg("demand").alias("mean_demand"), F.count("*").alias("n")).select("geohash", *r6("latitude", "longitude", "mean_demand"), "n")


@query("heat_map", _DECODE + "SELECT round(latitude, 6) AS latitude, round(longitude, 6) AS longitude, round(avg(demand), 6) AS mean_demand FROM obs JOIN cells USING (geohash) GROUP BY latitude, longitude")
def heat_map(spark, d):
    o = cleaning.decode_coordinates(obs(spark, d)).dropna(subset=["latitude", "longitude"])
    return o.groupBy("latitude", "longitude").agg(F.avg("demand").alias("mean_demand")).select(*r6("latitude", "longitude", "mean_demand"))


for _name, _dir in (("top_hot", True), ("top_cold", False)):

    def _hot(descending):
        return lambda spark, d: profile.hot_spots(obs(spark, d), 10, descending).select("geohash", *r6("mean_demand"), "n")

    query(_name, f"SELECT geohash, round(avg(demand), 6) AS mean_demand, count(*) AS n FROM obs GROUP BY geohash ORDER BY avg(demand) {'DESC' if _dir else 'ASC'}, geohash LIMIT 10")(_hot(_dir))

_CORR = ["demand", "hour", "time_slot", "day", "lanes", "temperature"]
_flat = "SELECT * FROM ({})"


@query("corr_target", _flat.format(" UNION ALL ".join(f"SELECT '{c}' AS \"column\", round(corr({c}, demand), 6) AS corr FROM obs" for c in _CORR[1:])) + " UNION ALL SELECT 'month', NULL")
def corr_target(spark, d):
    o = obs(spark, d).withColumn("month", F.lit(1))
    return profile.target_correlations(o, [*_CORR[1:], "month"]).select("column", *r6("corr"))


@query("corr_matrix", _flat.format(" UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS corr FROM obs" for i, a in enumerate(_CORR) for b in _CORR[i:])))
def corr_matrix(spark, d):
    return profile.correlations(obs(spark, d), _CORR).select("a", "b", *r6("corr"))


@query("bbox", _DECODE + "SELECT round(min(latitude), 6) AS min_lat, round(max(latitude), 6) AS max_lat, round(min(longitude), 6) AS min_lon, round(max(longitude), 6) AS max_lon, min(latitude) BETWEEN 12 AND 14 AND min(longitude) BETWEEN 77 AND 78.5 AS in_fence FROM cells")
def bbox(spark, d):
    return spatial.bounds(cleaning.decode_coordinates(obs(spark, d))).select(*r6("min_lat", "max_lat", "min_lon", "max_lon"), "in_fence")


@query("chrono_check", ", s AS (SELECT day * 100 + time_slot AS k, lag(day * 100 + time_slot) OVER (ORDER BY idx) AS b FROM obs) SELECT count(*) FILTER (k < b) AS breaks, count(*) FILTER (k < b) = 0 AS chronological FROM s")
def chrono_check(spark, d):
    return timeseries.chronology_breaks(obs(spark, d))


@query("histogram", "SELECT CAST(least(floor(demand / (1.0 / 50)), 49) AS INT) AS bin, count(*) AS n FROM obs WHERE demand BETWEEN 0 AND 1 GROUP BY 1")
def histogram(spark, d):
    return profile.histogram(obs(spark, d), "demand", 0.0, 1.0)


@query("density", _flat.format(" UNION ALL ".join(f"SELECT CAST({i / 10} AS DOUBLE) AS point, round(avg(exp(-pow((demand - {i / 10}) / 0.05, 2) / 2)) / (0.05 * sqrt(2 * pi())), 6) AS density FROM obs" for i in range(11))))
def density(spark, d):
    return profile.density(obs(spark, d), "demand", [i / 10 for i in range(11)], 0.05).select("point", *r6("density"))


# ---- time series -----------------------------------------------------------

_W = "OVER (PARTITION BY geohash ORDER BY day, time_slot, idx)"
_LAGS = ", ".join(f"lag(demand, {n}) {_W} AS demand_lag_{n}" for n in FeatureConfig.lags)
_LAG_NAMES = [f"demand_lag_{n}" for n in FeatureConfig.lags]


@query("lags", f", l AS (SELECT idx, {_LAGS} FROM obs) SELECT idx, {rr(*_LAG_NAMES)} FROM l")
def lags(spark, d):
    return timeseries.positional_lags(obs(spark, d)).select("idx", *r6(*_LAG_NAMES))


_ANY = f"[{', '.join(_LAG_NAMES)}]"


@query("lag_stats", f", l AS (SELECT idx, {_LAGS} FROM obs) SELECT idx, {ff((f'list_avg({_ANY})', 'demand_yesterday_mean_5'))}, {dd((f'list_stddev_samp({_ANY})', 'demand_yesterday_std_5'))} FROM l")
def lag_stats(spark, d):
    return timeseries.lag_stats(timeseries.positional_lags(obs(spark, d))).select("idx", *f32("demand_yesterday_mean_5"), *d32("demand_yesterday_std_5"))


@query("calendar_lag", "SELECT idx, round(v, 6) AS calendar_lag FROM obs o LEFT JOIN slots s ON s.geohash = o.geohash AND s.day = o.day - 1 AND s.time_slot = o.time_slot")
def calendar_lag(spark, d):
    o = obs(spark, d)
    return timeseries.calendar_lag(o, o).select("idx", *r6("calendar_lag"))


_REG = [f"{r}_demand_lag_{n}" for r in ("reg5", "reg4") for n in FeatureConfig.regional_lags]


@query("regional_lags", ", g AS (SELECT *, avg(demand) OVER (PARTITION BY day, time_slot, p5) AS reg5, avg(demand) OVER (PARTITION BY day, time_slot, p4) AS reg4 FROM obs), l AS (SELECT idx, " + ", ".join(f"lag({c[:4]}, {c[-2:]}) {_W} AS {c}" for c in _REG) + f" FROM g) SELECT idx, {ff(*[(c, c) for c in _REG])} FROM l")
def regional_lags(spark, d):
    return timeseries.regional_lags(obs(spark, d)).select("idx", *f32(*_REG))


_TODAY = [f"demand_today_lag_{k}" for k in range(9)]


@query("today_lags", "SELECT idx, " + ", ".join(f"round((SELECT v FROM slots s WHERE s.geohash = o.geohash AND s.day = o.day AND s.time_slot = {k} AND o.time_slot > {k}), 6) AS {c}" for k, c in enumerate(_TODAY)) + " FROM obs o")
def today_lags(spark, d):
    o = obs(spark, d)
    return timeseries.today_lags(o, o).select("idx", *r6(*_TODAY))


@query("diurnal_window", f"SELECT idx, {ff(('avg(v)', 'demand_yesterday_rolling_mean_9'))}, {dd(('stddev_pop(v)', 'demand_yesterday_rolling_std_9'))} FROM obs o LEFT JOIN slots s ON s.geohash = o.geohash AND s.day = o.day - 1 AND s.time_slot BETWEEN o.time_slot - 4 AND o.time_slot + 4 GROUP BY idx")
def diurnal_window(spark, d):
    o = obs(spark, d)
    return timeseries.diurnal(o, o).select("idx", *f32("demand_yesterday_rolling_mean_9"), *d32("demand_yesterday_rolling_std_9"))


@query("peak_means", f"SELECT geohash, day, {ff(('avg(v) FILTER (time_slot BETWEEN 28 AND 40)', 'yesterday_peak_morning_mean'), ('avg(v) FILTER (time_slot BETWEEN 68 AND 80)', 'yesterday_peak_evening_mean'))} FROM slots GROUP BY ALL")
def peak_means(spark, d):
    return timeseries.peak_means(obs(spark, d)).select("geohash", "day", *f32("yesterday_peak_morning_mean", "yesterday_peak_evening_mean"))


@query("test_lags", f", u AS (SELECT *, false AS is_test FROM train UNION ALL SELECT *, true FROM test), l AS (SELECT idx, is_test, {_LAGS} FROM u) SELECT idx, {rr(*_LAG_NAMES)} FROM l WHERE is_test")
def test_lags(spark, d):
    train, test = train_test(spark, d)
    return timeseries.with_history(train, test, timeseries.positional_lags).select("idx", *r6(*_LAG_NAMES))


# ---- encodings -------------------------------------------------------------


@query("label_codes", ", v AS (SELECT DISTINCT coalesce(road_type, 'nan') AS value FROM train) SELECT value, CAST(row_number() OVER (ORDER BY value) - 1 AS INT) AS code FROM v")
def label_codes(spark, d):
    return encoding.label_codes(train_test(spark, d)[0], "road_type")


@query("label_apply_unseen", ", v AS (SELECT DISTINCT weather AS value FROM train WHERE weather IN ('Foggy', 'Rainy')), c AS (SELECT value, CAST(row_number() OVER (ORDER BY value) - 1 AS INT) AS code FROM v) SELECT idx, coalesce(code, 0) AS weather_enc FROM obs LEFT JOIN c ON weather = value")
def label_apply_unseen(spark, d):
    codes = encoding.label_codes(train_test(spark, d)[0].filter(F.col("weather").isin("Foggy", "Rainy")), "weather")
    return encoding.apply_labels(obs(spark, d), codes, "weather", "weather_enc").select("idx", "weather_enc")


@query("kfold_sizes", "SELECT CAST(fold AS INT) AS fold, count(*) AS n, min(idx) AS first_idx FROM (SELECT idx, ntile(5) OVER (ORDER BY day, time_slot, idx) - 1 AS fold FROM train) GROUP BY fold")
def kfold_sizes(spark, d):
    return timeseries.contiguous_folds(train_test(spark, d)[0], 5).groupBy("fold").agg(F.count("*").alias("n"), F.min("idx").alias("first_idx"))


@query("oof_target_encode", ", f AS (SELECT *, ntile(2) OVER (ORDER BY day, time_slot, idx) AS fold FROM train), g AS (SELECT road_type, fold, sum(demand) AS s, count(*) AS n FROM f WHERE road_type IS NOT NULL GROUP BY ALL), h AS (SELECT road_type, fold, (sum(s) OVER w - s) / nullif(sum(n) OVER w - n, 0) AS te FROM g WINDOW w AS (PARTITION BY road_type)) SELECT idx, round(coalesce(te, (SELECT avg(demand) FROM train)), 6) AS road_type_te FROM f LEFT JOIN h USING (road_type, fold)")
def oof_target_encode(spark, d):
    folded = timeseries.contiguous_folds(train_test(spark, d)[0], 2)
    return encoding.oof_encode(folded, "road_type", "road_type_te").select("idx", *r6("road_type_te"))


@query("target_encode_apply", ", m AS (SELECT geohash, avg(demand) AS te FROM train GROUP BY geohash) SELECT idx, round(coalesce(te, (SELECT avg(demand) FROM train)), 6) AS geohash_te FROM test LEFT JOIN m USING (geohash)")
def target_encode_apply(spark, d):
    train, test = train_test(spark, d)
    return encoding.apply_target_means(test, train, "geohash", "geohash_te").select("idx", *r6("geohash_te"))


# ---- spatial ---------------------------------------------------------------

_KNN = _DECODE + """, pairs AS (SELECT a.geohash, b.geohash AS nbr, round(2 * asin(sqrt(pow(sin(radians(b.latitude - a.latitude) / 2), 2) + cos(radians(a.latitude)) * cos(radians(b.latitude)) * pow(sin(radians(b.longitude - a.longitude) / 2), 2))), 12) AS dist FROM cells a, cells b WHERE a.geohash <> b.geohash),
edges AS (SELECT geohash, nbr, dist, row_number() OVER (PARTITION BY geohash ORDER BY dist, nbr) AS rank FROM pairs QUALIFY rank <= 5) """


@query("knn_edges", _KNN + "SELECT geohash, nbr, CAST(rank AS INT) AS rank, round(dist, 9) AS dist FROM edges")
def knn_edges(spark, d):
    return spatial.knn_edges(spatial.centroids(obs(spark, d))).select("geohash", "nbr", "rank", F.round("dist", 9).alias("dist"))


@query("knn_lag", _KNN + f"SELECT idx, {ff(('avg(v)', 'knn_lag96_mean'))}, {dd(('stddev_pop(v)', 'knn_lag96_std'))} FROM obs o LEFT JOIN (SELECT e.geohash, s.day, s.time_slot, s.v FROM edges e JOIN slots s ON s.geohash = e.nbr) n ON n.geohash = o.geohash AND n.day = o.day - 1 AND n.time_slot = o.time_slot GROUP BY idx")
def knn_lag(spark, d):
    o = obs(spark, d)
    return spatial.knn_lag(o, o, spatial.knn_edges(spatial.centroids(o))).select("idx", *f32("knn_lag96_mean"), *d32("knn_lag96_std"))


_CENTERS = [(0, -5.47, 90.63), (1, -5.44, 90.66), (2, -5.42, 90.70)]


@query("dist_to_centroid", _DECODE + ", k AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, CAST({a} AS DOUBLE), CAST({b} AS DOUBLE))" for i, a, b in _CENTERS) + ") t(cluster, clat, clon)), n AS (SELECT geohash, cluster, sqrt(pow(latitude - clat, 2) + pow(longitude - clon, 2)) AS dd FROM cells, k QUALIFY row_number() OVER (PARTITION BY geohash ORDER BY dd, cluster) = 1) SELECT idx, cluster AS spatial_cluster, round(dd, 6) AS dist_to_centroid FROM obs JOIN n USING (geohash)")
def dist_to_centroid(spark, d):
    centers = spark.createDataFrame(_CENTERS, "cluster int, clat double, clon double")
    return spatial.nearest_center(cleaning.decode_coordinates(obs(spark, d)), centers).select("idx", "spatial_cluster", *r6("dist_to_centroid"))


@query("kmeans_clusters")
def kmeans_clusters(spark, d):
    o = cleaning.decode_coordinates(obs(spark, d))
    return spatial.nearest_center(o, spatial.kmeans_centers(spatial.centroids(o))).groupBy("spatial_cluster").agg(F.avg("demand").alias("mean_demand"), F.count("*").alias("n"))


# ---- corrections -----------------------------------------------------------

_HW = "(coalesce(road_type = 'Highway', false) OR coalesce(lanes >= 4, false))"
_LAG = ", lagm AS (SELECT geohash, time_slot, avg(demand) AS lg FROM train WHERE day = 28 GROUP BY ALL), dm AS (SELECT geohash, avg(demand) FILTER (day = 28) AS mf, avg(demand) FILTER (day = 29) AS mv FROM train WHERE day IN (28, 29) GROUP BY geohash), sf AS (SELECT geohash, least(greatest(mv / nullif(mf, 0), 0.3), 3.0) AS sf FROM dm WHERE mf IS NOT NULL AND mv IS NOT NULL)"
_SURGE = "geohash IN (" + ", ".join(f"'{g}'" for g in POST.surge) + ")"


def _rule(name: str, sql: str, f):
    @query(name, _LAG + sql)
    def run(spark, d):
        train, test = train_test(spark, d)
        return f(test, train).select("idx", *r6("p"))


_rule("highway_calibration", f", s AS (SELECT (SELECT avg(demand) FROM train WHERE {_HW}) AS y, (SELECT avg(p) FROM test WHERE {_HW}) AS q) SELECT idx, round(CASE WHEN {_HW} AND y IS NOT NULL AND q IS NOT NULL THEN least(greatest(p * CASE WHEN q <= 0 THEN 1 ELSE least(y / q, 2.5) END, 0), 1) ELSE p END, 6) AS p FROM test, s", lambda t, tr: postprocess.highway_calibration(t, tr, POST))
_rule("midrange_shrink", f" SELECT idx, round(CASE WHEN {_HW} AND p < 0.5 THEN p * 0.95 ELSE p END, 6) AS p FROM test", lambda t, tr: postprocess.midrange_shrink(t, POST))
_rule("lag96_blend", " SELECT idx, round(least(greatest(coalesce(0.3 * lg + 0.7 * p, p), 0), 1), 6) AS p FROM test LEFT JOIN lagm USING (geohash, time_slot)", lambda t, tr: postprocess.lag_blend(t, tr, POST))
_rule("trend_correct", " SELECT idx, round(least(greatest(0.95 * p + 0.05 * least(greatest(p * coalesce(sf, 1), 0), 1), 0), 1), 6) AS p FROM test LEFT JOIN sf USING (geohash)", lambda t, tr: postprocess.trend_correct(t, tr, POST))
_rule("surge_override", f" SELECT idx, round(CASE WHEN {_SURGE} AND lg IS NOT NULL AND mv / nullif(mf, 0) IS NOT NULL THEN least(lg * mv / mf, 1.0) ELSE p END, 6) AS p FROM test LEFT JOIN lagm USING (geohash, time_slot) LEFT JOIN dm USING (geohash)", lambda t, tr: postprocess.surge_override(t, tr, POST))
_rule("bias_sub", " SELECT idx, round(least(greatest(p - 0.008, 0), 1), 6) AS p FROM test", lambda t, tr: postprocess.bias_subtract(t, POST))
_rule(
    "postprocess_all",
    f""", s AS (SELECT (SELECT avg(demand) FROM train WHERE {_HW}) AS y, (SELECT avg(p) FROM test WHERE {_HW}) AS q),
r1 AS (SELECT * EXCLUDE (p), CASE WHEN {_HW} AND y IS NOT NULL AND q IS NOT NULL THEN least(greatest(p * CASE WHEN q <= 0 THEN 1 ELSE least(y / q, 2.5) END, 0), 1) ELSE p END AS p FROM test, s),
r2 AS (SELECT * EXCLUDE (p), CASE WHEN {_HW} AND p < 0.5 THEN p * 0.95 ELSE p END AS p FROM r1),
r3 AS (SELECT r2.* EXCLUDE (p), lg, least(greatest(coalesce(0.3 * lg + 0.7 * p, p), 0), 1) AS p FROM r2 LEFT JOIN lagm USING (geohash, time_slot)),
r4 AS (SELECT r3.* EXCLUDE (p), least(greatest(0.95 * p + 0.05 * least(greatest(p * coalesce(sf, 1), 0), 1), 0), 1) AS p FROM r3 LEFT JOIN sf USING (geohash)),
r5 AS (SELECT r4.* EXCLUDE (p), CASE WHEN {_SURGE} AND lg IS NOT NULL AND mv / nullif(mf, 0) IS NOT NULL THEN least(lg * mv / mf, 1.0) ELSE p END AS p FROM r4 LEFT JOIN dm USING (geohash))
SELECT idx, round(least(greatest(p - 0.008, 0), 1), 6) AS p FROM r5""",
    lambda t, tr: postprocess.all_rules(t, tr, POST),
)


@query("trend_factor", _LAG + " SELECT geohash, round(sf, 6) AS sf FROM sf")
def trend_factor(spark, d):
    return postprocess.trend_factors(train_test(spark, d)[0], POST).select("geohash", *r6("sf"))


# ---- models ----------------------------------------------------------------


@query("rmse_r2", "SELECT round(sqrt(avg(pow(demand - p, 2))), 6) AS rmse, round(1 - sum(pow(demand - p, 2)) / (var_pop(demand) * count(*)), 6) AS r2, count(*) AS n FROM obs")
def rmse_r2(spark, d):
    return models.rmse_r2(obs(spark, d), "demand", "p").select(*r6("rmse", "r2"), "n")


_P = ["p", "q"]


def _two(spark, d):
    return obs(spark, d).withColumn("q", (F.col("time_slot") + 1) / 200.0)


@query("blend_gram", ", t AS (SELECT demand, p, (time_slot + 1) / 200.0 AS q FROM obs) SELECT round(sum(p * p), 4) AS g_p_p, round(sum(p * q), 4) AS g_p_q, round(sum(q * q), 4) AS g_q_q, round(sum(p * demand), 4) AS c_p, round(sum(q * demand), 4) AS c_q, round(sum(demand), 4) AS sy, round(sum(demand * demand), 4) AS syy, count(*) AS n FROM t")
def blend_gram(spark, d):
    g = models.gram(_two(spark, d), "demand", _P)
    return g.select(*[F.round(c, 4).alias(c) for c in g.columns if c != "n"], "n")


#: Of two predictions the best share is a quotient, held within 0 and 1.
@query("blend_weights", """, t AS (SELECT demand AS y, p, (time_slot + 1) / 200.0 AS q FROM obs),
s AS (SELECT sum(p * p) AS pp, sum(p * q) AS pq, sum(q * q) AS qq, sum(p * y) AS py, sum(q * y) AS qy, sum(y * y) AS yy, sum(y) AS y, count(*) AS n FROM t),
w AS (SELECT *, least(greatest((py - qy + qq - pq) / (pp - 2 * pq + qq), 0), 1) AS w FROM s)
SELECT round(w, 6) AS w_p, round(1 - w, 6) AS w_q, round(1 - (w * w * pp + 2 * w * (1 - w) * pq + (1 - w) * (1 - w) * qq - 2 * w * py - 2 * (1 - w) * qy + yy) / (yy - y * y / n), 6) AS r2 FROM w""")
def blend_weights(spark, d):
    weights, r2 = models.blend_weights(_two(spark, d), "demand", _P)
    return spark.createDataFrame([(weights["p"], weights["q"], r2)], "w_p double, w_q double, r2 double").select(*r6("w_p", "w_q", "r2"))


@query("time_split", "SELECT CAST(day AS INT) AS day, count(*) AS n FROM train WHERE day IN (28, 29) GROUP BY day")
def time_split(spark, d):
    fit_part, val_part = models.time_split(train_test(spark, d)[0], 28, 29)
    return fit_part.unionByName(val_part).groupBy("day").agg(F.count("*").alias("n"))


@query("feature_matrix")
def feature_matrix(spark, d):
    train, test = (x.drop("p", "road_type", "weather") for x in train_test(spark, d))
    return features.fit(train).transform(test)


@query("train_score")
def train_score(spark, d):
    train, test = (x.drop("p", "road_type", "weather") for x in train_test(spark, d))
    # on these tables the validation error is least after one round
    return scoring.train_score(train, test, pcfg=POST, rounds=10).predictions


@query("downcast_plan", "SELECT * FROM (VALUES ('demand', 'float'), ('hour', 'byte'), ('lanes', 'byte'), ('time_slot', 'byte'), ('temperature', 'float')) t(\"column\", type)")
def downcast_plan(spark, d):
    plan = cleaning.downcast_plan(obs(spark, d).select("demand", "hour", "lanes", "time_slot", "temperature"))
    return spark.createDataFrame(list(plan.items()), T.StructType([T.StructField("column", T.StringType()), T.StructField("type", T.StringType())]))


@query("slot_stream", "SELECT time_bucket(INTERVAL 15 MINUTES, ts) AS slot_start, event_type, round(avg(value), 6) AS mean_value, count(*) AS n FROM events GROUP BY ALL")
def slot_stream(spark, d):
    out = slot_demand(spark.read.parquet(f"{d}/events.parquet"))
    return out.select(F.col("slot_start").cast("timestamp_ntz").alias("slot_start"), "event_type", *r6("mean_value"), "n")
