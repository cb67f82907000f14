"""Splits, learners, metrics and the convex blend."""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import exprs as E


def time_split(df: DataFrame, fit_day: int, val_day: int) -> tuple[DataFrame, DataFrame]:
    return df.filter(F.col("day") == fit_day), df.filter(F.col("day") == val_day)


def rmse_r2(df: DataFrame, y: str, p: str) -> DataFrame:
    """Both metrics from one aggregate."""
    d = df.filter(F.col(y).isNotNull() & F.col(p).isNotNull())
    sse, n = F.sum(F.pow(F.col(y) - F.col(p), 2)), F.count("*")
    return d.agg(F.sqrt(sse / n).alias("rmse"), (1 - F.try_divide(sse, F.var_pop(y) * n)).alias("r2"), n.alias("n"))


def gram(df: DataFrame, y: str, predictions: list[str]) -> DataFrame:
    """One row: products of predictions with each other and with y, and the sums of y."""
    sums = [F.sum(F.col(a) * F.col(b)).alias(f"g_{a}_{b}") for i, a in enumerate(predictions) for b in predictions[i:]]
    return df.agg(*sums, *[F.sum(F.col(a) * F.col(y)).alias(f"c_{a}") for a in predictions], F.sum(y).alias("sy"), F.sum(F.col(y) * F.col(y)).alias("syy"), F.count("*").alias("n"))


def simplex_weights(g: np.ndarray, c: np.ndarray) -> np.ndarray:
    """argmin of w'Gw - 2c'w over convex weights, exactly, by trying every support."""
    m = len(c)
    best, best_value = np.full(m, 1 / m), np.inf
    for k in range(1, m + 1):
        for support in combinations(range(m), k):
            s = list(support)
            system = np.zeros((k + 1, k + 1))
            system[:k, :k], system[:k, k], system[k, :k] = 2 * g[np.ix_(s, s)], 1, 1
            w = np.zeros(m)
            w[s] = np.linalg.lstsq(system, np.r_[2 * c[s], 1.0], rcond=None)[0][:k]
            if (w < -1e-9).any():
                continue
            w = np.maximum(w, 0)
            w /= w.sum()
            value = w @ g @ w - 2 * c @ w
            if value < best_value - 1e-15:
                best, best_value = w, value
    return best


def blend_weights(df: DataFrame, y: str, predictions: list[str]) -> tuple[dict[str, float], float]:
    """Weights and R2; only the Gram matrix reaches the driver."""
    row = gram(df, y, predictions).first()
    m = len(predictions)
    g = np.zeros((m, m))
    for i, a in enumerate(predictions):
        for j in range(i, m):
            g[i, j] = g[j, i] = row[f"g_{a}_{predictions[j]}"] or 0.0
    c = np.array([row[f"c_{a}"] or 0.0 for a in predictions])
    w = simplex_weights(g, c)
    total = row["syy"] - row["sy"] ** 2 / row["n"] if row["n"] else 0.0
    error = w @ g @ w - 2 * c @ w + (row["syy"] or 0.0)
    return dict(zip(predictions, map(float, w), strict=True)), float(1 - error / total) if total else float("nan")


def blend(df: DataFrame, weights: dict[str, float], name: str = "prediction") -> DataFrame:
    total = F.lit(0.0)
    for p, w in weights.items():
        total = total + w * F.col(p)
    return df.withColumn(name, E.clip(total))


#: Boosting rounds at most.
ROUNDS = 2000
#: Fixed values of three boosted learners: depth, step, share of rows and of columns, rows of a leaf at least.
PRESETS = {
    "leafy": {"depth": 6, "rate": 0.03, "rows": 0.85, "columns": 0.85, "leaf": 20},
    "deep": {"depth": 7, "rate": 0.03, "rows": 0.85, "columns": 0.85, "leaf": 5},
    "smooth": {"depth": 8, "rate": 0.03, "rows": 0.85, "columns": 1.0, "leaf": 1},
}
_BOOSTED = {"depth": 5, "rate": 0.1, "rows": 0.85, "columns": 1.0, "leaf": 1}


@dataclass
class Learner:
    """A boosted (``boosted`` or a preset), forest or linear regressor over assembled features.

    Nulls become a sentinel with a flag beside it, as these learners have no
    missing values of their own.
    """

    kind: str
    features: list[str]
    label: str = "demand"
    weight: str | None = None
    rounds: int = 20
    depth: int = 5
    seed: int = 42

    @property
    def boosted(self) -> bool:
        return self.kind == "boosted" or self.kind in PRESETS

    def _assemble(self, df: DataFrame) -> DataFrame:
        from pyspark.ml.feature import VectorAssembler

        filled = df.withColumns({f"_x_{c}": F.coalesce(F.col(c).cast("double"), F.lit(-1.0)) for c in self.features} | {f"_m_{c}": F.col(c).isNull().cast("double") for c in self.features})
        return VectorAssembler(inputCols=[f"_x_{c}" for c in self.features] + [f"_m_{c}" for c in self.features], outputCol="_features").transform(filled)

    def _estimator(self, rounds: int):
        from pyspark.ml import regression as R

        common = {"featuresCol": "_features", "labelCol": self.label, "predictionCol": "_p"} | ({"weightCol": self.weight} if self.weight else {})
        if self.boosted:
            how = PRESETS.get(self.kind, _BOOSTED | {"depth": self.depth})
            return R.GBTRegressor(
                maxIter=rounds, maxDepth=how["depth"], stepSize=how["rate"], subsamplingRate=how["rows"], minInstancesPerNode=how["leaf"],
                featureSubsetStrategy="all" if how["columns"] == 1 else str(how["columns"]), seed=self.seed, **common,
            )
        if self.kind == "forest":
            return R.RandomForestRegressor(numTrees=rounds, maxDepth=self.depth, seed=self.seed, **common)
        if self.kind == "linear":
            return R.LinearRegression(regParam=0.01, **common)
        raise ValueError(f"unknown learner {self.kind!r}")

    def fit(self, train: DataFrame, validation: DataFrame | None = None) -> "Fitted":
        """With a validation frame a boosted learner keeps its best number of rounds, 10 at least."""
        data = self._assemble(train)
        model = self._estimator(self.rounds).fit(data)
        best = self.rounds
        if validation is not None and self.boosted:
            errors = model.evaluateEachIteration(self._assemble(validation), "squared")
            best = int(np.argmin(errors)) + 1
        return Fitted(self, model, best)

    def refit(self, train: DataFrame, best: int) -> "Fitted":
        return Fitted(self, self._estimator(max(10, best)).fit(self._assemble(train)), best)


@dataclass
class Fitted:
    learner: Learner
    model: object
    best: int

    def predict(self, df: DataFrame, name: str) -> DataFrame:
        out = self.model.transform(self.learner._assemble(df)).withColumn(name, E.clip("_p"))
        return out.drop("_p", "_features", *[c for c in out.columns if c.startswith(("_x_", "_m_"))])
