"""Boosted trees with dropout: each new tree is fitted without a random part of the earlier ones.

Round t leaves out each earlier tree i with a chance of `drop_rate`, decided by a
hash of (seed, t, i), fits a tree to the gradient of the absolute error of the
rest, and then weighs: with k trees left out, they come back times k / (k + step)
and the new tree has the weight step / (k + step); with none it has `step`. The
first tree has the weight 1. So with a rate of 0 this is plain boosting.

Each row carries the weighted sum of all its trees; a round evaluates only the
trees it leaves out and the new one, whatever the number of trees. The rows are
stored every `CUT` rounds, so no plan grows with the rounds. The result is an
ordinary model of the library with changed weights: it is saved, loaded, scored
and explained like any other.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.ml.regression import DecisionTreeRegressionModel, GBTRegressionModel, RandomForestRegressor
from pyspark.ml.util import Identifiable
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from zonecast.session import checkpointed

CUT = 5
SCALE = 1_000_000


def is_dropped(seed: int, round_: int, tree: int, rate: float) -> bool:
    digest = hashlib.md5(f"{seed}:{round_}:{tree}".encode()).hexdigest()
    return int(digest[:12], 16) % SCALE < round(rate * SCALE)


def dropped(seed: int, round_: int, rate: float) -> list[int]:
    """The earlier trees that a round leaves out."""
    return [i for i in range(round_) if is_dropped(seed, round_, i, rate)]


def reweighted(weights: Sequence[float], out: Sequence[int], step: float) -> list[float]:
    """The weights after a round that left the trees `out` out, the new tree's last."""
    k, gone = len(out), set(out)
    new = 1.0 if not weights else step / (k + step) if k else step
    return [w * k / (k + step) if i in gone else w for i, w in enumerate(weights)] + [new]


def weighted_trees(spark: SparkSession, trees: Sequence[DecisionTreeRegressionModel], weights: Sequence[float], out: str = "prediction") -> GBTRegressionModel:
    """A model of these trees with these weights."""
    jvm, gateway = spark._jvm, spark.sparkContext._gateway
    kinds = gateway.new_array(jvm.org.apache.spark.ml.regression.DecisionTreeRegressionModel, len(trees))
    numbers = gateway.new_array(jvm.double, len(trees))
    for i, (tree, weight) in enumerate(zip(trees, weights)):
        kinds[i], numbers[i] = tree._java_obj, float(weight)
    uid = Identifiable()._randomUID() if not hasattr(GBTRegressionModel, "_randomUID") else GBTRegressionModel._randomUID()
    model = GBTRegressionModel(jvm.org.apache.spark.ml.regression.GBTRegressionModel(uid, kinds, numbers))
    model._resetUid(uid)
    return model.setFeaturesCol("features").setPredictionCol(out)


def fit_dropout(rows: DataFrame, label: str, rounds: int, step: float, drop_rate: float = 0.1, seed: int = 42,
                validation: str | None = None, patience: int = 50, **tree: object) -> GBTRegressionModel:
    """`rows` hold a vector `features`, the label and maybe a boolean `validation`; `tree` are settings of a single tree.

    Rows of the validation part train nothing; after `patience` rounds without a
    smaller absolute error on them, the model is the one of the best round.
    """
    spark = rows.sparkSession
    held = F.col(validation) if validation else F.lit(False)
    data = checkpointed(spark, rows.select("features", F.col(label).cast("double").alias("y"), held.alias("held"), F.lit(0.0).alias("sum")))
    trees: list[DecisionTreeRegressionModel] = []
    weights: list[float] = []
    best, best_error, best_weights = 0, float("inf"), []
    forest = RandomForestRegressor(featuresCol="features", labelCol="_goal", predictionCol="_new", numTrees=1, bootstrap=False, **tree)
    for t in range(rounds):
        out = dropped(seed, t, drop_rate)
        if out:
            data = weighted_trees(spark, [trees[i] for i in out], [weights[i] for i in out], "_out").transform(data)
        else:
            data = data.withColumn("_out", F.lit(0.0))
        rest = F.col("sum") - F.col("_out")
        goal = F.when(F.col("y") >= rest, 1.0).otherwise(-1.0) if trees else F.col("y")
        fitted = forest.setSeed(seed + t).fit(data.where("NOT held").select("features", goal.alias("_goal")))
        trees.append(fitted.trees[0].setFeaturesCol("features").setPredictionCol("_new"))
        back = len(out) / (len(out) + step)
        weights = reweighted(weights, out, step)
        data = trees[-1].transform(data).select("features", "y", "held", (rest + F.col("_out") * back + F.col("_new") * weights[-1]).alias("sum"))
        if (t + 1) % CUT == 0:
            data = checkpointed(spark, data)
        if validation:
            error = data.where("held").agg(F.avg(F.abs(F.col("y") - F.col("sum")))).first()[0]
            if error is not None and error < best_error:
                best, best_error, best_weights = t, error, list(weights)
            elif error is not None and t - best >= patience:
                break
    if validation and best_weights:
        trees, weights = trees[:best + 1], best_weights
    return weighted_trees(spark, trees, weights)
