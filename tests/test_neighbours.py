"""The nearest-neighbour estimate of mutual information against the plain quadratic one."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from zonecast.operators import neighbours as nb


def digamma(n):
    return -0.57721566490153286 + sum(1 / i for i in range(1, n))


def plain(x, y, k):
    """From whole numbers, comparing every row with every other."""
    n = len(x)
    dx, dy = np.abs(x[:, None] - x), np.abs(y[:, None] - y)
    far = np.maximum(dx, dy)
    np.fill_diagonal(far, nb.NEVER)
    r = np.sort(far, axis=1)[:, k - 1]
    nx, ny = (np.maximum((d < r[:, None]).sum(axis=1), 1) for d in (dx, dy))
    return max(0.0, digamma(n) + digamma(k) - np.mean([digamma(a) + digamma(b) for a, b in zip(nx.tolist(), ny.tolist())]))


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(8)
    n = 2000
    demand = rng.poisson(4, n).astype(float)
    pdf = pd.DataFrame({
        "id": np.arange(n), "demand": demand, "strong": demand * 2 + rng.normal(0, 0.3, n), "noise": rng.normal(size=n),
        "hot": np.where(rng.random(n) < 0.4, 3.0, rng.integers(0, 9, n)), "constant": 1.0,
        "wide": np.where(rng.random(n) < 0.01, 1e6, rng.normal(size=n)) + demand, "holes": np.where(rng.random(n) < 0.3, np.nan, demand)})
    df = spark.createDataFrame(pdf).withColumn("holes", F.when(F.isnan("holes"), None).otherwise(F.col("holes")))
    return df.repartition(5).cache()


FEATURES = ["strong", "noise", "hot", "constant", "wide", "holes"]


@pytest.mark.parametrize("slab, k", [(64, 3), (1024, 3), (100, 5)])
def test_equals_the_quadratic_estimate(table, monkeypatch, slab, k):
    monkeypatch.setattr(nb, "SLAB", slab)
    found = {r["feature"]: r["mi"] for r in nb.mutual_information(table, FEATURES, "demand", k, ["id"]).collect()}
    grid = nb.gridded(table, FEATURES, "demand", ["id"]).toPandas()
    for feature, rows in grid.groupby("feature"):
        assert found[feature] == pytest.approx(plain(rows.x.to_numpy(), rows.y.to_numpy(), k), abs=1e-9), feature
    assert set(found) == set(FEATURES) and found["strong"] > 1 > 0.1 > found["noise"]


def test_hot_values_are_split_into_slabs_of_bounded_size(spark, monkeypatch):
    monkeypatch.setattr(nb, "SLAB", 50)
    rows = nb.gridded(spark.range(3000).select("id", F.lit(7.0).alias("f"), (F.col("id") % 2).alias("demand")), ["f"], "demand", ["id"])
    sizes = nb.slabs(rows).select(F.size("xs").alias("n"), "slab", "low", "high").orderBy("slab").collect()
    assert max(r["n"] for r in sizes) <= 50 and sum(r["n"] for r in sizes) == 3000
    assert [r["slab"] for r in sizes] == list(range(len(sizes)))
    assert all(a["high"] <= b["low"] for a, b in zip(sizes, sizes[1:]))


def test_few_rows(spark):
    df = spark.range(3).select("id", F.col("id").cast("double").alias("f"), F.col("id").alias("demand"))
    assert [tuple(r) for r in nb.mutual_information(df, ["f"], keys=["id"]).collect()] == [("f", 0.0)]
    assert nb.mutual_information(df.limit(0), ["f"], keys=["id"]).count() == 0
