"""Hand-computed cases of the traps in the panel semantics."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import exprs as E
from tessera.operators import cleaning, encoding, models, profile, timeseries
from tessera.sources import tables


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()[0]


def test_geohash(spark):
    rows = spark.createDataFrame([("ezs42",), ("qp03xw",), ("qa",), (None,)], "g string").select(E.geohash_lat("g").alias("a"), E.geohash_lon("g").alias("b")).collect()
    assert tuple(rows[0]) == pytest.approx((42.60498046875, -5.60302734375))
    assert tuple(rows[1]) == pytest.approx((-5.32562255859375, 90.6866455078125))
    assert tuple(rows[2]) == tuple(rows[3]) == (None, None)


def test_categories(spark):
    raw = ["don't new-york 4lane ABC", " nan ", "none", "", None]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in raw], "c string").select(E.clean_category("c")).collect()]
    assert got == ["Don'T New-York 4Lane Abc", "Unknown", "Unknown", "Unknown", "Unknown"]


def test_scalars(spark):
    assert one(spark, E.clip(F.lit(None).cast("double"))) is None
    assert [one(spark, E.clip(F.lit(x))) for x in (-1.0, 0.5, 2.0)] == [0.0, 0.5, 1.0]
    assert one(spark, E.day_of_week(F.lit(-3))) == 4
    assert one(spark, E.ratio(F.lit(1.0), F.lit(0.0))) is None
    times = spark.createDataFrame([("2:15",), ("0:0",), (None,), ("23:59",)], "ts_hm string").withColumn("day", F.lit(5))
    assert [r.time_slot for r in cleaning.time_features(times).collect()] == [9, 0, 0, 95]


def test_mode_and_medians(spark):
    df = spark.createDataFrame([("a", "x", 1.0), ("a", "y", 2.0), ("a", None, None), ("b", None, 5.0)], "k string, v string, n double")
    modes = cleaning.fit_mode(df, "k", "v")
    assert [tuple(r) for r in modes.collect()] == [("a", "x")]
    assert sorted(cleaning.impute_mode(df, modes, "k", "v").select("v").collect(), key=str) == sorted([("x",), ("y",), ("x",), (None,)], key=str)
    assert cleaning.fit_medians(df).values == {"n": 2.0}


def test_lags_count_rows_and_days(spark):
    rows = [(i, "g", d, s, float(i)) for i, (d, s) in enumerate([(0, 0), (0, 1), (1, 1), (2, 1)])]
    df = spark.createDataFrame(rows, "idx long, geohash string, day int, time_slot int, demand double")
    got = {r.idx: (r.demand_lag_1, r.calendar_lag) for r in timeseries.calendar_lag(timeseries.positional_lags(df, (1,)), df).collect()}
    assert got == {0: (None, None), 1: (0.0, None), 2: (1.0, 1.0), 3: (2.0, 2.0)}


def test_folds_and_leave_out(spark):
    df = spark.createDataFrame([(i, 0, i, "c" if i < 4 else "d", float(i)) for i in range(11)], "idx long, day int, time_slot int, cat string, demand double")
    folded = timeseries.contiguous_folds(df, 3)
    assert sorted(r["count"] for r in folded.groupBy("fold").count().collect()) == [3, 4, 4]
    te = {r.idx: r.te for r in encoding.oof_encode(folded, "cat", "te").collect()}
    assert te[0] == pytest.approx(5.0)  # its category is in its own fold alone: global mean
    assert te[4] == pytest.approx((8 + 9 + 10) / 3)


def test_unseen_label(spark):
    codes = encoding.label_codes(spark.createDataFrame([("b",), ("a",), (None,)], "c string"), "c")
    assert {r.value: r.code for r in codes.collect()} == {"a": 0, "b": 1, "nan": 2}
    got = encoding.apply_labels(spark.createDataFrame([("z",), ("b",), (None,)], "c string"), codes, "c", "k")
    assert sorted(r.k for r in got.collect()) == [0, 1, 2]


def test_constant_correlation_is_null(spark):
    df = spark.range(5).select(F.col("id").cast("double").alias("a"), F.lit(1.0).alias("b"))
    assert df.agg(profile.safe_corr("a", "b")).first()[0] is None
    assert df.agg(profile.safe_corr("a", "a")).first()[0] == pytest.approx(1.0)


def test_simplex_weights_beat_a_grid():
    rng = np.random.default_rng(0)
    for _ in range(20):
        p, y = rng.random((30, 3)), rng.random(30)
        w = models.simplex_weights(p.T @ p, p.T @ y)
        assert w.min() >= 0 and w.sum() == pytest.approx(1)
        grid = [np.array([a, b, 1 - a - b]) for a in np.arange(0, 1.01, 0.1) for b in np.arange(0, 1.01 - a, 0.1)]
        assert ((p @ w - y) ** 2).sum() <= min(((p @ g - y) ** 2).sum() for g in grid) + 1e-9


def test_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, "qp03xw", 3, "2:15", 0.5)], "Index long, geohash string, day int, timestamp string, demand double")
    tables.save(df, f"{tmp_path}/x", "csv")
    assert [tuple(r) for r in tables.read_csv(spark, f"{tmp_path}/x").collect()] == [(1, "qp03xw", 3, "2:15", 0.5)]
    with pytest.raises(ValueError):
        tables.save_submission(df, f"{tmp_path}/s")
    tables.save_submission(df.withColumn("time_slot", F.lit(9)), f"{tmp_path}/s")
    assert spark.read.option("header", True).csv(f"{tmp_path}/s").columns == ["Index", "demand"]
    with pytest.raises(ValueError):
        tables.save(df, f"{tmp_path}/y", "xml")


def test_folds_are_exact_over_many_partitions(spark):
    names = ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")
    before = [spark.conf.get(n) for n in names]
    try:
        for n, v in zip(names, ("8", "false")):
            spark.conf.set(n, v)
        rows = spark.range(5003).select(
            F.col("id").alias("idx"), (F.col("id") % 7).cast("int").alias("day"), (F.col("id") % 13).cast("int").alias("time_slot"), F.repeat(F.col("id").cast("string"), 40).alias("wide"), F.sha2(F.col("id").cast("string"), 512).alias("w2")
        )
        folded = timeseries.contiguous_folds(rows.repartition(4, "w2"), 5)
        want = sorted(range(5003), key=lambda i: (i % 7, i % 13, i))
        fold = {i: k for k, part in enumerate(np.array_split(np.array(want), 5)) for i in part.tolist()}
        assert {r.idx: r.fold for r in folded.select("idx", "fold").collect()} == fold
        slots = [(i, i // 96 + (5 if i % 70_000 == 7 else 0), i % 96) for i in [*range(300), *range(65_500, 65_600), *range(140_000, 140_050)]]
        table = spark.createDataFrame(slots, "idx long, day int, time_slot int").repartition(4)
        breaks = sum(a[1] * 100 + a[2] > b[1] * 100 + b[2] for a, b in zip(slots, slots[1:]))
        assert timeseries.chronology_breaks(table).first()["breaks"] == breaks == 2
        assert timeseries.chronology_breaks(table.limit(0)).first()["breaks"] == 0
    finally:
        for n, v in zip(names, before):
            spark.conf.set(n, v)


def test_downcast_keeps_what_a_float_cannot_hold(spark):
    df = spark.createDataFrame([(1e300, 1.5, 200), (None, -2.0, -3)], "a double, b double, c long")
    assert cleaning.downcast_plan(df) == {"a": "double", "b": "float", "c": "short"}


def test_jobs_from_raw_files_to_submission(spark, tmp_path):
    from tessera import cli

    cells = ["qp03xw", "qp03w9", "qp03wz", "qp09d9", "qp03zy", "qp03xn"]
    header = "Index,geohash,day,timestamp,demand,RoadType,NumberofLanes,LargeVehicles,Landmarks,Temperature,Weather\n"
    rows = {"train": [], "test": [], "sample": []}
    for k, cell in enumerate(cells):
        for day, slots in ((48, range(0, 96, 4)), (49, range(0, 20, 2))):
            for s in slots:
                part = "test" if day == 49 and s > 8 else "train"
                n = len(rows[part])
                rows[part].append(f"{n},{cell},{day},{s // 4}:{s % 4 * 15},{'' if part == 'test' else (k + 1) * (s + 1) / 1000},{['highway', '', 'Street'][k % 3]},{k % 5 + 1},{['yes', 'no'][k % 2]},{['mall', ''][s % 2]},{'' if n % 9 == 0 else 20 + s / 10},{['Sunny', 'rainy'][s % 3 % 2]}")
    rows["sample"] = [f"{n},0.0" for n in range(len(rows["test"]))]
    for name, lines in rows.items():
        (tmp_path / f"{name}.csv").write_text(("Index,demand\n" if name == "sample" else header) + "\n".join(lines) + "\n")
    log = ["--log-dir", f"{tmp_path}/logs"]
    raw = ["--train-path", f"{tmp_path}/train.csv", "--test-path", f"{tmp_path}/test.csv"]
    made = cli.main(["preprocess", *raw, "--output-dir", f"{tmp_path}/p", "--run-eda", *log])
    assert spark.read.parquet(made["train"]).filter("temperature is null or latitude is null").count() == 0
    text = "".join(p.read_text() for p in (tmp_path / "p/eda/report").glob("part-*"))
    assert all(f"## {section}" in text for section in ("Risks", "Basic statistics", "Distribution and outliers", "Time", "Places", "Correlations")) and "month" in text
    args = ["--train-path", made["train"], "--test-path", made["test"], "--submission-path", f"{tmp_path}/sample.csv", "--output-dir", f"{tmp_path}/out", "--rounds", "2", "--models", "deep", "linear", *log]
    facts = cli.main(["train-tuned", *args])
    assert set(facts["blend_weights"]) == {"deep", "linear"} == set(facts["cv_scores"]) and abs(sum(facts["blend_weights"].values()) - 1) < 1e-9
    latest = spark.read.option("header", True).csv(f"{tmp_path}/out/submission_latest.csv")
    assert latest.columns == ["Index", "demand"] and latest.count() == len(rows["test"])
    assert latest.filter("cast(demand as double) not between 0 and 1 or demand is null").count() == 0
    assert not tables.matches_sample(spark, latest.limit(3), f"{tmp_path}/sample.csv")
    assert list((tmp_path / "logs").glob("run_*.log"))


def test_presets_reach_the_estimator():
    learner = models.Learner("deep", ["a"])
    pytest.importorskip("pyspark.ml")
    assert models.PRESETS["deep"]["depth"] == 7 and learner.boosted and not models.Learner("forest", ["a"]).boosted
