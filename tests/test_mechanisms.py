"""Dropout trees, ordered target statistics and pooling, each against a plain version."""

import hashlib

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import functions as F

from zonecast.operators import calibrate as cal
from zonecast.operators import categories as ct
from zonecast.operators import dropout as dp
from zonecast.operators import modeling as mo


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(2)
    n = 500
    pdf = pd.DataFrame({"id": np.arange(n), "a": rng.normal(size=n), "b": rng.normal(size=n)})
    pdf["demand"] = 10 + 4 * pdf.a + np.abs(pdf.b) * 3 + rng.normal(0, 0.3, n)
    pdf["is_val"] = rng.random(n) < 0.3
    return spark.createDataFrame(pdf).repartition(3).cache()


TREE = {"maxDepth": 3, "minInstancesPerNode": 1, "maxBins": 32, "featureSubsetStrategy": "all", "subsamplingRate": 1.0}


def test_a_rate_of_zero_is_plain_boosting(data):
    rows = VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(data)
    plain = GBTRegressor(labelCol="demand", lossType="absolute", maxIter=7, stepSize=0.3, seed=1, **TREE).fit(rows)
    ours = dp.fit_dropout(rows, "demand", 7, 0.3, 0.0, seed=1, **TREE)
    assert list(ours.treeWeights) == list(plain.treeWeights)
    both = ours.transform(plain.transform(rows).withColumnRenamed("prediction", "want"))
    assert both.where("abs(prediction - want) > 1e-9").count() == 0


def test_rounds_leave_trees_out_and_weights_follow(data):
    rows = VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(data)
    model = dp.fit_dropout(rows, "demand", 9, 0.3, 0.4, seed=3, **TREE)
    weights = []
    for t in range(9):
        gone = [i for i in range(t) if int(hashlib.md5(f"3:{t}:{i}".encode()).hexdigest()[:12], 16) % 1_000_000 < 400_000]
        weights = [w * len(gone) / (len(gone) + 0.3) if i in gone else w for i, w in enumerate(weights)]
        weights.append(1.0 if t == 0 else 0.3 / (len(gone) + 0.3) if gone else 0.3)
    assert list(model.treeWeights) == pytest.approx(weights)
    # The first rounds by hand: what is fitted is the sign of what the kept trees miss.
    sums = rows
    for i, tree in enumerate(model.trees[:3]):
        sums = tree.setFeaturesCol("features").setPredictionCol(f"t{i}").transform(sums)
    first = sums.select("demand", "features", F.when(F.col("demand") >= (0.0 if 0 in dp.dropped(3, 1, 0.4) else F.col("t0")), 1.0).otherwise(-1.0).alias("goal"), "t1")
    again = dp.RandomForestRegressor(labelCol="goal", predictionCol="p", numTrees=1, bootstrap=False, seed=4, **TREE).fit(first)
    assert again.transform(first).where("abs(p - t1) > 1e-9").count() == 0


def test_the_booster_with_dropout_stops_saves_and_explains(spark, data, tmp_path):
    from zonecast.operators import tree_shap as ts

    model = mo.Booster("gbt_alt", {"maxIter": 12, "maxDepth": 3, "stepSize": 0.4, "dropRate": 0.3}).fit(data, ["a", "b"], validation="is_val")
    assert 1 <= len(model.model.stages[-1].trees) <= 12
    model.save(str(tmp_path / "m"))
    again = mo.Booster.load(str(tmp_path / "m"), "gbt_alt", ["a", "b"])
    assert again.predict(model.predict(data, "x"), "y").where("abs(x - y) > 1e-9").count() == 0
    sums = ts.attributions(data, model, ["id"]).groupBy("id").agg(F.sum("attribution").alias("s"), F.max("base_value").alias("b"))
    raw = model.model.transform(data).select("id", "prediction")
    assert raw.join(sums, "id").where("abs(s + b - prediction) < 1e-9").count() == 500


# Ordered target statistics ------------------------------------------------------


def test_ordered_statistics_see_earlier_rows_only(spark):
    rng = np.random.default_rng(1)
    rows = [(i, None if rng.random() < 0.1 else "hot" if rng.random() < 0.4 else f"c{rng.integers(6)}", None if i == 7 else float(rng.integers(0, 20))) for i in range(400)]
    df = spark.createDataFrame(rows, "id bigint, kind string, demand double").repartition(5)
    stats = ct.OrderedTargets("kind", keys=["id"], weight=2.0, seed=9)
    got = {r["id"]: r["code"] for r in stats.fit_transform(df, "code").collect()}
    place = {i: int(hashlib.md5(f"9|{i}".encode()).hexdigest()[:15], 16) for i, _, _ in rows}
    sums, counts, total, n = {}, {}, 0.0, 0
    for i, kind, y in sorted(rows, key=lambda r: place[r[0]]):
        if y is None:
            assert got[i] is None
            continue
        assert got[i] == pytest.approx((sums.get(kind, 0.0) + 2 * (total / n if n else 0.0)) / (counts.get(kind, 0) + 2))
        sums[kind], counts[kind], total, n = sums.get(kind, 0.0) + y, counts.get(kind, 0) + 1, total + y, n + 1
    new = spark.createDataFrame([(1, "hot"), (2, None), (3, "unseen")], "id bigint, kind string")
    coded = {r["id"]: r["code"] for r in stats.transform(new, "code").collect()}
    assert coded == pytest.approx({1: (sums["hot"] + 2 * total / n) / (counts["hot"] + 2), 2: (sums[None] + 2 * total / n) / (counts[None] + 2), 3: total / n})


def test_changing_a_row_leaves_its_own_statistic(spark):
    df = spark.createDataFrame([(i, "ab"[i % 2], float(i)) for i in range(50)], "id bigint, kind string, demand double")
    code = lambda d: {r["id"]: r["code"] for r in ct.OrderedTargets("kind", keys=["id"]).fit_transform(d, "code").collect()}
    before, after = code(df), code(df.withColumn("demand", F.when(F.col("id") == 20, 1000.0).otherwise(F.col("demand"))))
    assert before[20] == after[20] and before != after


# Pooling ------------------------------------------------------------------------


def plain_pool(x, y):
    """Blocks [mean, weight, low, high] by pooling one value after the other."""
    out = []
    for v in sorted(set(x)):
        own = [b for a, b in zip(x, y) if a == v]
        out.append([sum(own) / len(own), len(own), v, v])
        while len(out) > 1 and out[-2][0] >= out[-1][0] - 1e-12:
            m, w, _, high = out.pop()
            out[-1] = [(out[-1][0] * out[-1][1] + m * w) / (out[-1][1] + w), out[-1][1] + w, out[-1][2], high]
    return out


@pytest.mark.parametrize("shape", ["noisy", "falling", "rising", "saw", "flat"])
def test_pooling_equals_the_plain_one(spark, shape):
    rng = np.random.default_rng(6)
    x = rng.integers(0, 400, 900).astype(float) / 4
    y = {"noisy": x * 0.2 + rng.normal(0, 5, 900), "falling": -x, "rising": x * 2, "saw": x % 25, "flat": np.ones(900)}[shape].round(3)
    df = spark.createDataFrame(pd.DataFrame({"pred": x, "demand": y}))
    got = [(r["low"], r["high"], r["mean"]) for r in cal.isotonic_blocks(df).orderBy("low").collect()]
    want = [(low, high, m) for m, _, low, high in plain_pool(x.tolist(), y.tolist())]
    levels = lambda blocks: {v: next(m for low, high, m in blocks if low <= v <= high) for v in set(x.tolist())}
    assert levels(got) == pytest.approx(levels(want))
    assert all(a[2] <= b[2] + 1e-9 and a[1] < b[0] for a, b in zip(got, got[1:]))


def test_isotonic_map_is_flat_outside_and_linear_between(spark):
    df = spark.createDataFrame([(1.0, 3.0), (2.0, 1.0), (4.0, 6.0), (None, 5.0), (5.0, None)], "pred double, demand double")
    fit = cal.Isotonic().fit(df)
    asked = spark.createDataFrame([(v,) for v in (-9.0, 1.5, 3.0, 9.0, None)], "pred double")
    assert [r["calibrated"] for r in fit.transform(asked).collect()] == [2.0, 2.0, 4.0, 6.0, None]
    assert cal.Isotonic().fit(df.limit(0)).transform(asked).where("calibrated IS NOT NULL").count() == 0
