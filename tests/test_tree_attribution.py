"""Exact tree attributions against sums over all subsets of features."""

from itertools import combinations
from math import factorial

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from zonecast.operators import modeling as mo
from zonecast.operators import tree_shap as ts

NAMES = ["a", "b", "c", "d"]


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(5)
    n = 400
    pdf = pd.DataFrame({k: rng.normal(size=n).round(1) for k in NAMES})
    pdf["kind"] = rng.choice(["x", "y", "z", "w"], n)
    pdf["demand"] = 5 + 2 * pdf.a * (pdf.b > 0) + pdf.c + (pdf.kind == "x") * pdf.a + rng.normal(0, 0.1, n)
    pdf["timestamp"] = pd.date_range("2024-01-01", periods=n, freq="h")
    pdf["zone"] = (np.arange(n) % 3).astype(str)
    return spark.createDataFrame(pdf).repartition(4).cache()


@pytest.fixture(scope="module")
def booster(data):
    return mo.Booster("gbt_l1", {"maxIter": 4, "maxDepth": 4, "stepSize": 0.4}).fit(data, NAMES)


@pytest.fixture(scope="module")
def mixed(data):
    return mo.Booster("gbt_categorical", {"maxIter": 4, "maxDepth": 4, "stepSize": 0.4}).fit(data, ["a", "b", "c", "kind"])


def stored(spark, booster, tmp_path):
    booster.model.stages[-1].write().overwrite().save(str(tmp_path / "t"))
    trees = {}
    for r in spark.read.parquet(str(tmp_path / "t" / "data")).collect():
        trees.setdefault(r["treeID"], {})[r["nodeData"]["id"]] = r["nodeData"]
    return list(zip(booster.model.stages[-1].treeWeights, (trees[i] for i in sorted(trees))))


def expected(tree, at, x, known):
    """The score of a tree when only some features are known, by walking it."""
    node = tree[at]
    if node["leftChild"] < 0:
        return node["prediction"]
    split = node["split"]
    f, cut = split["featureIndex"], split["leftCategoriesOrThreshold"]
    if f in known:
        left = x[f] <= cut[0] if split["numCategories"] < 0 else x[f] in cut
        return expected(tree, node["leftChild"] if left else node["rightChild"], x, known)
    sides = [node["leftChild"], node["rightChild"]]
    rows = [tree[s]["impurityStats"][0] for s in sides]
    return sum(r * expected(tree, s, x, known) for r, s in zip(rows, sides)) / sum(rows)


def brute(trees, x):
    m = len(x)
    v = {s: sum(w * expected(t, 0, x, set(s)) for w, t in trees) for k in range(m + 1) for s in combinations(range(m), k)}
    at = lambda *parts: v[tuple(sorted(set().union(*parts)))]
    phi, both = np.zeros(m), np.zeros((m, m))
    for i in range(m):
        rest = [j for j in range(m) if j != i]
        for k in range(m):
            for s in combinations(rest, k):
                phi[i] += factorial(k) * factorial(m - k - 1) / factorial(m) * (at(s, {i}) - at(s))
        for j in rest:
            for k in range(m - 1):
                for s in combinations([r for r in rest if r != j], k):
                    weight = factorial(k) * factorial(m - k - 2) / factorial(m - 1) / 2
                    both[i, j] += weight * (at(s, {i, j}) - at(s, {i}) - at(s, {j}) + at(s))
        both[i, i] = phi[i] - both[i].sum()
    return at(()), phi, both


@pytest.mark.parametrize("which", ["booster", "mixed"])
def test_equals_the_sum_over_all_subsets(spark, data, tmp_path, request, which):
    model = request.getfixturevalue(which)
    trees, leaves = stored(spark, model, tmp_path), ts.tree_leaves(spark, model)
    x = np.array([r["_x"] for r in ts._inputs(data, model, []).limit(25).collect()])
    phi, both = ts.attributions_of(leaves, x), ts.interactions_of(leaves, x)
    for row, p, b in zip(x, phi, both):
        base, want, pairs = brute(trees, row)
        assert ts.base_value(leaves) == pytest.approx(base)
        np.testing.assert_allclose(p, want, atol=1e-9)
        np.testing.assert_allclose(b, pairs, atol=1e-9)


@pytest.mark.parametrize("which", ["booster", "mixed"])
def test_adds_up_on_all_rows(data, request, which):
    model = request.getfixturevalue(which)
    found = ts.attributions(data, model)
    sums = found.groupBy("timestamp", "zone").agg(F.sum("attribution").alias("s"), F.max("base_value").alias("base"), F.count("*").alias("n"), F.max("prediction").alias("p"))
    raw = model.model.transform(data).select("timestamp", "zone", "prediction")
    both = raw.join(sums, ["timestamp", "zone"])
    assert both.count() == 400 and both.where(f"n = {len(model.inputs)} AND abs(s + base - prediction) < 1e-9 AND abs(p - prediction) < 1e-9").count() == 400


def test_interactions_sum_to_the_attribution_and_name_the_partner(data, booster):
    sums = ts.interactions(data, booster, ["a", "d"]).groupBy("timestamp", "zone", "feature").agg(F.sum("interaction").alias("s"), F.count("*").alias("n"))
    both = ts.attributions(data, booster).join(sums, ["timestamp", "zone", "feature"])
    assert both.count() == 800 and both.where("n = 4 AND abs(s - attribution) < 1e-9").count() == 800
    strength = ts.interaction_strength(data, booster)
    pairs = {(r["feature"], r["partner"]): r["strength"] for r in strength.collect()}
    assert len(pairs) == 12 and all(pairs[p] == pytest.approx(pairs[p[::-1]]) for p in pairs)
    best = {r["feature"]: r["partner"] for r in ts.strongest_partners(strength).collect()}
    assert best["a"] == "b" and best["b"] == "a"
    points = ts.dependence(data, booster, ["a"]).toPandas()
    assert len(points) == 400 and set(points.partner) == {"b"}
    assert np.abs(points.interaction).mean() == pytest.approx(pairs["a", "b"])


def test_empty_and_one_leaf_trees(spark, data):
    flat = mo.Booster("gbt_l1", {"maxIter": 2, "maxDepth": 0}).fit(data, NAMES)
    rows = ts.attributions(data.limit(3), flat).collect()
    assert len(rows) == 12 and all(r["attribution"] == 0 and r["prediction"] == pytest.approx(r["base_value"]) for r in rows)
    assert ts.attributions(data.limit(0), flat).count() == 0 and ts.interaction_strength(data.limit(0), flat).where("strength <> 0").count() == 0
