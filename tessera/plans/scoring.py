"""Train, blend and correct: the whole scoring job."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.config import FeatureConfig, PostConfig
from tessera.functions import exprs as E
from tessera.operators import models, postprocess
from tessera.plans import features


@dataclass
class Scored:
    predictions: DataFrame
    weights: dict[str, float]
    r2: float
    rounds: dict[str, int]
    scores: dict[str, float]
    features: int


#: Features that the tuned job leaves out.
TUNED_EXCLUDES = ("knn_lag96_mean", "knn_lag96_std")


def train_score(train: DataFrame, test: DataFrame, kinds: tuple[str, ...] = ("boosted", "forest", "linear"), fcfg: FeatureConfig = FeatureConfig(), pcfg: PostConfig = PostConfig(), rounds: int = models.ROUNDS, rules: bool = True, exclude: tuple[str, ...] = ()) -> Scored:
    """Learners validated on one later day, blended exactly, refitted on all of train, and corrected."""
    model = features.fit(train, fcfg)
    data = model.transform_train().withColumn("_w", E.sample_weight()).persist()
    columns = [c for c in features.feature_columns(data, exclude) if c != "_w"]
    fit_part, val_part = models.time_split(data, pcfg.fit_day, pcfg.val_day)
    out, held, best = model.transform(test), val_part, {}
    for kind in kinds:
        learner = models.Learner(kind, columns, weight="_w", rounds=rounds, seed=fcfg.seed)
        fitted = learner.fit(fit_part, val_part)
        best[kind] = fitted.best
        held = fitted.predict(held, kind)
        out = learner.refit(data, fitted.best).predict(out, kind)
    held = held.select("demand", *kinds).persist()
    weights, r2 = models.blend_weights(held, "demand", list(kinds))
    scores = {kind: models.rmse_r2(held, "demand", kind).first()["rmse"] for kind in kinds}
    out = models.blend(out, weights, "p")
    if rules:
        out = postprocess.all_rules(out, features.prepare(train), pcfg)
    return Scored(out.select("idx", "geohash", "day", "time_slot", F.col("p").alias("demand")), weights, r2, best, scores, len(columns))
