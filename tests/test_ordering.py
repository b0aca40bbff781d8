"""Ordered computations against NumPy and pandas, with ties, gaps and hot keys."""

import numpy as np
import pandas as pd
import pytest
from conftest import SCHEMA, frame
from pyspark.sql import functions as F

from zonecast.operators import folds as fd
from zonecast.operators import geo
from zonecast.operators import ordering as od
from zonecast.operators import temporal as tp
from zonecast.operators.history import over_history


@pytest.fixture(scope="module")
def skewed(spark):
    """One key with a third of all rows, many ties, some nulls and NaN."""
    rng = np.random.default_rng(1)
    keys = np.where(rng.random(3000) < 0.34, "hot", rng.integers(0, 9, 3000).astype(str))
    values = np.where(rng.random(3000) < 0.4, 7.0, rng.normal(0, 5, 3000))
    pdf = pd.DataFrame({"k": keys, "v": values})
    pdf.loc[::97, "v"] = np.nan
    return spark.createDataFrame(pdf), pdf.dropna()


@pytest.mark.parametrize("buckets", [4, 64, 1024])
def test_quantiles_equal_numpy(skewed, buckets):
    df, pdf = skewed
    shares = [0.0, 0.05, 0.1, 0.25, 0.5, 0.9, 1.0]
    got = od.quantiles(df, "v", shares, buckets=buckets).first()
    assert got["n"] == len(pdf)
    np.testing.assert_allclose(got["quantiles"], np.percentile(pdf.v, [100 * s for s in shares]), rtol=1e-12, atol=1e-12)
    for row in od.quantiles(df, "v", shares, ["k"], buckets=buckets).collect():
        np.testing.assert_allclose(row["quantiles"], np.percentile(pdf.v[pdf.k == row["k"]], [100 * s for s in shares]), rtol=1e-12, atol=1e-12)


def test_quantiles_of_one_value(spark):
    df = spark.createDataFrame([(3.0,)], "v double")
    assert od.quantiles(df, "v", [0.1, 0.9]).first()["quantiles"] == [3.0, 3.0]


def test_prefix_sums(skewed):
    df, pdf = skewed
    got = od.prefix_sums(od.value_counts(df, "v", ["k"]), "v", ["n"], ["k"], buckets=16).toPandas()
    for row in got.sample(60, random_state=0).itertuples():
        mine = pdf[pdf.k == row.k]
        assert row.n_before == (mine.v < row.v).sum()
        assert row.n_total == len(mine)


@pytest.mark.parametrize("dense", [True, False])
@pytest.mark.parametrize("chunk", [8, 50, 4096])
def test_chunked_windows_equal_pandas(spark, dense, chunk):
    pdf = frame(3, 130)
    df = spark.createDataFrame(pdf, SCHEMA)

    def columns(w):
        return {**tp.lag_columns(w, "demand", [1, 7]), **tp.rolling_columns(w, "demand", [6])}

    got = over_history(df, columns, 7, dense=dense, chunk_rows=chunk).toPandas().sort_values(["zone", "timestamp"])
    groups = pdf.sort_values(["zone", "timestamp"]).groupby("zone")["demand"]
    np.testing.assert_array_equal(got.demand_lag_7h.fillna(-1), groups.shift(7).fillna(-1))
    earlier = groups.shift(1).groupby(pdf.zone)
    np.testing.assert_allclose(got.demand_roll6h_mean.fillna(-1), earlier.transform(lambda s: s.rolling(6, min_periods=1).mean()).fillna(-1))
    np.testing.assert_allclose(got.demand_roll6h_std, earlier.transform(lambda s: s.rolling(6, min_periods=1).std()).fillna(0), atol=1e-9)


def test_row_lags_ignore_gaps(spark):
    pdf = frame(2, 300)
    pdf = pdf[np.random.default_rng(3).random(len(pdf)) < 0.3]
    got = over_history(spark.createDataFrame(pdf, SCHEMA), lambda w: tp.lag_columns(w, "demand", [5]), 5, chunk_rows=10)
    got = got.toPandas().sort_values(["zone", "timestamp"])
    want = pdf.sort_values(["zone", "timestamp"]).groupby("zone")["demand"].shift(5)
    assert len(got) == len(pdf)
    np.testing.assert_array_equal(got.demand_lag_5h.fillna(-1), want.fillna(-1))


def test_forward_rows(spark):
    df = spark.createDataFrame(frame(1, 60), SCHEMA)
    got = over_history(df, lambda w: {"ahead": F.lead("demand", 3).over(w)}, 0, 3, dense=True, chunk_rows=7).toPandas().sort_values("timestamp")
    np.testing.assert_array_equal(got.ahead.fillna(-1), got.demand.shift(-3).fillna(-1))


def test_a_zone_is_spread_over_chunks(spark):
    """A long series is not one window partition."""
    df = spark.createDataFrame(frame(1, 500), SCHEMA)
    plan = tp.add_lags(df, dense=True)._jdf.queryExecution().executedPlan().toString()
    assert "_chunk" in plan and "hashpartitioning(zone" in plan


def test_row_index_is_the_sorted_position(sample, sample_pdf):
    got = fd.row_index(sample).toPandas().sort_values("row_id")
    want = sample_pdf.sort_values(["timestamp", "zone"])
    assert list(got.row_id) == list(range(len(want)))
    assert list(got.zone) == list(want.zone)


def test_rank_and_share_with_nulls_and_ties(spark):
    rows = [("2024-01-01 00:00:00", z, d) for z, d in [("1", 5), ("2", 5), ("3", 9), ("4", None), ("5", 0)]]
    df = spark.createDataFrame(rows, "t string, zone string, demand bigint").withColumn("timestamp", F.to_timestamp_ntz("t"))
    got = {r["zone"]: (r["demand_rank"], r["demand_share"]) for r in geo.add_share_and_rank(df).collect()}
    assert {z: v[0] for z, v in got.items()} == {"1": 2.0, "2": 2.0, "3": 1.0, "4": None, "5": 4.0}
    assert got["3"][1] == pytest.approx(9 / 19, rel=1e-6) and got["4"][1] is None
