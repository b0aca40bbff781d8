"""Stacking, weighted blending and voting over base models, and cross-validation."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from itertools import combinations

import numpy as np
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from zonecast.functions import measures as ms
from zonecast.operators import folds as fd
from zonecast.operators.modeling import Booster
from zonecast.operators.trials import side_by_side


def _names(models: Sequence[Booster]) -> list[str]:
    return [f"pred_{i}" for i in range(len(models))]


def base_predictions(models: Sequence[Booster], df: DataFrame) -> DataFrame:
    """One prediction column per model, added side by side without joins."""
    for model, name in zip(models, _names(models)):
        df = model.predict(df, name)
    return df


def out_of_fold(models: Sequence[Booster], assigned: DataFrame, n_folds: int, features: Sequence[str],
                label: str = "demand") -> DataFrame:
    """Predictions of each fold's validation rows by models fitted on its training rows."""
    parts = []
    for fold in range(1, n_folds + 1):
        train = assigned.where((F.col("fold") == fold) & (F.col("role") == "train"))
        val = assigned.where((F.col("fold") == fold) & (F.col("role") == "val"))
        fitted = [m.unfitted().fit(train, features, label) for m in models]
        parts.append(base_predictions(fitted, val))
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


@dataclass
class Linear:
    """The meta model's numbers, as they are stored."""

    intercept: float
    coefficients: list[float]


class Stacking:
    """Ridge regression on out-of-fold predictions of the base models.

    `mode` is "kfold" (unshuffled blocks; trains on later rows too) or
    "walk_forward" (each fold trains on earlier rows only).
    """

    def __init__(self, models: Sequence[Booster], alpha: float = 1.0, n_folds: int = 5, mode: str = "walk_forward",
                 **fold_options: int):
        self.models, self.alpha, self.n_folds, self.mode = list(models), alpha, n_folds, mode
        self.fold_options = fold_options

    def fit(self, indexed: DataFrame, features: Sequence[str], label: str = "demand") -> "Stacking":
        """`indexed` holds `row_id` (see folds.row_index); keep it stored or cached, it is read per fold."""
        def plan(n: Column) -> list[fd.Fold]:
            if self.mode == "kfold":
                return fd.unshuffled_kfold(n, self.n_folds)
            return fd.walk_forward(n, self.n_folds, **self.fold_options)

        oof = out_of_fold(self.models, fd.assign(indexed, plan), self.n_folds, features, label)
        names = _names(self.models)
        rows = VectorAssembler(inputCols=names, outputCol="base").transform(oof.select(*names, label)).persist()
        try:
            # alpha / n makes Spark's penalty equal to alpha * |w|^2 over the summed squares.
            ridge = LinearRegression(featuresCol="base", labelCol=label, regParam=self.alpha / rows.count(),
                                     elasticNetParam=0.0, standardization=False, predictionCol="stacked")
            fit = ridge.fit(rows)
            self.meta = Linear(float(fit.intercept), [float(c) for c in fit.coefficients])
        finally:
            rows.unpersist()
        self.fitted = [m.unfitted().fit(indexed, features, label) for m in self.models]
        return self

    def predict(self, df: DataFrame, out: str = "prediction") -> DataFrame:
        names = _names(self.models)
        total = F.lit(float(self.meta.intercept))
        for name, weight in zip(names, self.meta.coefficients):
            total = total + float(weight) * F.col(name)
        return base_predictions(self.fitted, df).withColumn(out, F.greatest(total, F.lit(0.0))).drop(*names)

    def weights(self, spark: SparkSession) -> DataFrame:
        rows = [(m.kind, round(float(w), 4)) for m, w in zip(self.models, self.meta.coefficients)]
        return spark.createDataFrame(rows, "model string, weight double")


def simplex_weights(gram: np.ndarray, cross: np.ndarray) -> np.ndarray:
    """Weights >= 0 with sum 1 that minimise w'Gw - 2 c'w.

    Tries every set of models that may carry weight, so it is exact; meant for
    the few models of a blend.
    """
    size = len(cross)
    best, best_value = None, np.inf
    for count in range(1, size + 1):
        for used in combinations(range(size), count):
            picked = list(used)
            system = np.zeros((count + 1, count + 1))
            system[:count, :count] = gram[np.ix_(picked, picked)]
            system[:count, count] = system[count, :count] = 1.0
            solution = np.linalg.lstsq(system, np.append(cross[picked], 1.0), rcond=None)[0][:count]
            if solution.min() < -1e-12 or abs(solution.sum() - 1) > 1e-6:
                continue
            weights = np.zeros(size)
            weights[picked] = np.clip(solution, 0, None)
            value = weights @ gram @ weights - 2 * cross @ weights
            if value < best_value - 1e-12:
                best, best_value = weights / weights.sum(), value
    return best


def blend_weights(df: DataFrame, names: Sequence[str], label: str = "demand") -> np.ndarray:
    """Blend weights from the cross products of the predictions: one pass, m x m numbers to the driver."""
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i:]]
    sums = [F.avg(F.col(a) * F.col(b)) for a, b in pairs] + [F.avg(F.col(a) * F.col(label)) for a in names]
    values = [float(v) for v in df.agg(*sums).first()]
    gram = np.zeros((len(names), len(names)))
    for (a, b), value in zip(pairs, values):
        i, j = names.index(a), names.index(b)
        gram[i, j] = gram[j, i] = value
    return simplex_weights(gram, np.array(values[len(pairs):]))


class Blending:
    """Weighted mean of the base models; weights minimise the validation RMSE."""

    def __init__(self, models: Sequence[Booster]):
        self.models = list(models)

    def fit(self, train: DataFrame, val: DataFrame, features: Sequence[str], label: str = "demand",
            fitted: Sequence[Booster] | None = None) -> "Blending":
        """`fitted` reuses models that were already fitted on `train`."""
        self.fitted = list(fitted) if fitted else [m.unfitted().fit(train, features, label) for m in self.models]
        names = _names(self.models)
        self.weights_ = blend_weights(base_predictions(self.fitted, val), names, label)
        return self

    def predict(self, df: DataFrame, out: str = "prediction") -> DataFrame:
        names = _names(self.models)
        total = F.lit(0.0)
        for name, weight in zip(names, self.weights_):
            total = total + float(weight) * F.col(name)
        return base_predictions(self.fitted, df).withColumn(out, F.greatest(total, F.lit(0.0))).drop(*names)

    def weights(self, spark: SparkSession) -> DataFrame:
        rows = [(m.kind, round(float(w), 4)) for m, w in zip(self.models, self.weights_)]
        return spark.createDataFrame(rows, "model string, weight double")


def vote(df: DataFrame, names: Sequence[str], out: str = "prediction") -> DataFrame:
    """Mean of the prediction columns, never below 0."""
    total = sum((F.col(n) for n in names[1:]), F.col(names[0]))
    return df.withColumn(out, F.greatest(total / len(names), F.lit(0.0)))


class Voting:
    def __init__(self, models: Sequence[Booster]):
        self.models = list(models)

    def fit(self, train: DataFrame, features: Sequence[str], label: str = "demand",
            fitted: Sequence[Booster] | None = None) -> "Voting":
        self.fitted = list(fitted) if fitted else [m.unfitted().fit(train, features, label) for m in self.models]
        return self

    def predict(self, df: DataFrame, out: str = "prediction") -> DataFrame:
        names = _names(self.models)
        return vote(base_predictions(self.fitted, df), names, out).drop(*names)


def cross_validate(make: Callable[[], Booster], indexed: DataFrame, plan: fd.Plan, features: Sequence[str],
                   label: str = "demand", parallel: int = 1) -> DataFrame:
    """Metrics and sizes per fold: fit on the fold's training rows, score its validation rows; `parallel` folds at a time."""
    spark = indexed.sparkSession
    assigned = fd.assign(indexed, plan)
    sizes = {(r["fold"], r["role"]): r["n_rows"] for r in fd.fold_sizes(assigned).collect()}  # two rows per fold
    folds = [f for f in range(1, fd.fold_count(plan) + 1) if sizes.get((f, "train")) and sizes.get((f, "val"))]

    def fitted(fold: int) -> Booster:
        return make().fit(assigned.where((F.col("fold") == fold) & (F.col("role") == "train")), features, label)

    models = side_by_side(spark, [lambda f=f: fitted(f) for f in folds], parallel, "fold")
    parts = []
    for fold, model in zip(folds, models):
        scored = model.predict(assigned.where((F.col("fold") == fold) & (F.col("role") == "val")), "prediction")
        parts.append(scored.agg(
            F.lit(fold).cast("long").alias("fold"), *ms.error_aggregates(label, "prediction"),
            F.lit(sizes[fold, "train"]).alias("train_size"), F.lit(sizes[fold, "val"]).alias("val_size"),
        ))
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole.orderBy("fold")
