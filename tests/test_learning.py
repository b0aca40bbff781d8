"""Models, ensembles, selection and explanation."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from zonecast.operators import ensemble as en
from zonecast.operators import explain as ex
from zonecast.operators import folds as fd
from zonecast.operators import modeling as mo
from zonecast.operators import selecting as se

FEATURES = ["a", "b", "c"]
SMALL = {"maxIter": 5, "maxDepth": 3, "stepSize": 0.3}


@pytest.fixture(scope="module")
def data(spark):
    """demand depends on a strongly, on b weakly, not on c."""
    rng = np.random.default_rng(0)
    n = 600
    pdf = pd.DataFrame({"id": np.arange(n), "a": rng.normal(0, 1, n), "b": rng.normal(0, 1, n), "c": rng.normal(0, 1, n)})
    pdf["demand"] = 10 + 5 * pdf.a + 1.0 * pdf.b + rng.normal(0, 0.2, n)
    pdf["timestamp"] = pd.date_range("2024-01-01", periods=n, freq="h")
    pdf["zone"] = "1"
    schema = "id bigint, a double, b double, c double, demand double, timestamp timestamp_ntz, zone string"
    return fd.row_index(spark.createDataFrame(pdf, schema)).cache()


FORMULA = mo.Formula({"a": 5.0, "b": 1.0, "c": 0.0}, 10.0)


@pytest.mark.parametrize("kind", ["gbt_l1", "gbt_alt", "gbt_categorical"])
def test_boosters_fit_and_stay_nonnegative(spark, data, kind):
    model = mo.Booster(kind, SMALL).fit(data, FEATURES)
    out = model.predict(data)
    assert out.count() == 600 and out.where("prediction < 0").count() == 0
    assert set(out.columns) == {*data.columns, "prediction"}
    importance = {r["feature"]: r["importance"] for r in model.importance(spark).collect()}
    assert set(importance) == set(FEATURES) and max(importance, key=importance.get) == "a"


def test_text_needs_the_categorical_booster(data):
    with pytest.raises(ValueError, match="numeric columns only"):
        mo.Booster("gbt_l1", SMALL).fit(data, ["a", "zone"])


def test_model_round_trip(data, tmp_path):
    model = mo.Booster("gbt_l1", SMALL).fit(data, FEATURES)
    model.save(str(tmp_path / "m"))
    again = mo.Booster.load(str(tmp_path / "m"), "gbt_l1", FEATURES)
    both = again.predict(model.predict(data, "x"), "y")
    assert both.where("abs(x - y) > 1e-9").count() == 0


def test_voting_and_blending(data):
    models = [mo.Booster(k, SMALL).fit(data, FEATURES) for k in ("gbt_l1", "gbt_alt")]
    assert en.Voting(models).fit(data, FEATURES, fitted=models).predict(data).where("prediction < 0").count() == 0
    blend = en.Blending(models).fit(data, data, FEATURES, fitted=models)
    assert blend.weights_.min() >= 0 and blend.weights_.sum() == pytest.approx(1)


def test_simplex_weights_beat_a_grid():
    rng = np.random.default_rng(4)
    for _ in range(20):
        preds, y = rng.normal(0, 1, (50, 3)), rng.normal(0, 1, 50)
        weights = en.simplex_weights(preds.T @ preds / 50, preds.T @ y / 50)
        error = ((y - preds @ weights) ** 2).mean()
        grid = [(i / 20, j / 20, 1 - (i + j) / 20) for i in range(21) for j in range(21 - i)]
        assert error <= min(((y - preds @ np.array(w)) ** 2).mean() for w in grid) + 1e-9


def test_stacking_weights_equal_ridge(spark, data):
    model = en.Stacking([mo.Booster("gbt_l1", SMALL), mo.Booster("gbt_alt", SMALL)], alpha=1.0, n_folds=2, mode="kfold").fit(data, FEATURES)
    oof = en.out_of_fold(model.models, fd.assign(data, lambda n: fd.unshuffled_kfold(n, 2)), 2, FEATURES).toPandas()
    x, y = oof[["pred_0", "pred_1"]].to_numpy(), oof.demand.to_numpy()
    xc, yc = x - x.mean(0), y - y.mean()
    want = np.linalg.solve(xc.T @ xc + np.eye(2), xc.T @ yc)
    np.testing.assert_allclose(list(model.meta.coefficients), want, atol=0.02)
    assert model.predict(data).where("prediction < 0").count() == 0
    assert model.weights(spark).count() == 2


def test_cross_validation_table(data):
    out = en.cross_validate(lambda: mo.Booster("gbt_l1", SMALL), data, lambda n: fd.walk_forward(n, 2, 10, 100, 200), FEATURES).collect()
    assert [(r["fold"], r["train_size"], r["val_size"]) for r in out] == [(1, 200, 100), (2, 390, 100)]


def test_search_marks_one_best(data):
    out = se.parameter_search(data, lambda n: fd.unshuffled_kfold(n, 2), FEATURES, trials=2, fixed={"maxIter": 2}, most_depth=3).collect()
    assert len(out) == 2 and sum(r["best"] for r in out) == 1
    assert min(out, key=lambda r: r["rmse"])["best"]


def test_sample_is_the_same_for_any_partitioning(data):
    first = se.sample_rows(data.repartition(7), 50).toPandas()
    second = se.sample_rows(data.coalesce(1), 50).toPandas()
    assert len(first) == 50 and set(first.id) == set(second.id)
    assert se.sample_rows(data, 10_000).count() == 600


@pytest.mark.parametrize("block", [50, 4096])
def test_shuffle_keeps_values_and_breaks_rows(data, block):
    out = se.shuffle_columns(data, FEATURES, block_rows=block).toPandas()
    want = data.toPandas()
    for f in FEATURES:
        np.testing.assert_array_equal(np.sort(out[f"shadow_{f}"]), np.sort(want[f]))
        assert abs(np.corrcoef(out[f"shadow_{f}"], out[f])[0, 1]) < 0.2
    assert sorted(out.id) == list(range(600))
    assert abs(np.corrcoef(out.shadow_a, out.shadow_b)[0, 1]) < 0.2


def test_shadow_test_confirms_the_signal(data):
    got = {r["feature"]: r["verdict"] for r in se.boruta(data, FEATURES, trials=4, trees=10).collect()}
    assert got["a"] == "confirmed" and got["c"] != "confirmed"


def test_mutual_information_orders_features(data):
    got = {r["feature"]: r["mi"] for r in se.mutual_information(data, FEATURES).collect()}
    assert got["a"] > got["b"] and got["a"] > got["c"] >= 0


def test_few_votes_fall_back_to_attribution(spark):
    attribution = spark.createDataFrame([("a", 3.0), ("b", 2.0), ("c", 1.0)], "feature string, importance double")
    information = spark.createDataFrame([("a", 0.1), ("b", 0.2), ("c", 0.9)], "feature string, mi double")
    got = se.select_features(attribution, information, None, 2, 1, 2)
    assert {r["feature"] for r in got.where("selected").collect()} == {"a", "b"}
    enough = se.select_features(attribution, information, None, 2, 2, 1)
    assert {r["feature"]: r["votes"] for r in enough.collect()} == {"a": 1, "b": 2, "c": 1}
    assert {r["feature"] for r in enough.where("selected").collect()} == {"b"}


def test_shapley_adds_up_for_a_tree_model(data):
    model = mo.Booster("gbt_l1", SMALL).fit(data, FEATURES)
    rows = data.limit(40)
    out = ex.shapley(rows, FEATURES, model.predict, draws=3).groupBy("timestamp", "zone").agg(
        F.sum("attribution").alias("s"), F.first("base_value").alias("base"), F.first("prediction").alias("p"), F.count(F.lit(1)).alias("n")
    )
    joined = out.join(model.predict(rows, "direct"), ["timestamp", "zone"])
    assert joined.count() == 40
    assert joined.where("n <> 3 or abs(s - (p - base)) > 1e-9 or abs(p - direct) > 1e-9").count() == 0


def test_shapley_is_exact_for_a_formula(data):
    out = ex.shapley(data, FEATURES, FORMULA, draws=5).toPandas()
    pool = data.select(*FEATURES).join(data.select("a"), "a").toPandas()
    wide = out.pivot_table(index="timestamp", columns="feature", values="attribution")
    want = data.toPandas().set_index("timestamp")
    # Against the same background, two rows differ by weight * (difference of values).
    for f, w in FORMULA.weights.items():
        gap = wide[f] - wide[f].iloc[0]
        np.testing.assert_allclose(gap, w * (want[f].loc[wide.index] - want[f].loc[wide.index[0]]), atol=1e-9)
    assert len(pool) == 600


def test_local_fit_finds_the_strong_feature(data):
    out = ex.lime(data, FEATURES, FORMULA, draws=200).toPandas()
    assert len(out) == 600
    # In the outer quartiles of `a` its own bin matters most; near its middle the bin says little.
    value = data.toPandas().set_index("timestamp").a.loc[out.timestamp].to_numpy()
    outer = (value < np.percentile(value, 25)) | (value > np.percentile(value, 75))
    strongest = out.top_features.map(lambda t: t[0]["feature"])
    assert (strongest[outer] == "a").mean() > 0.99
    assert out.local_r2.between(-1e-9, 1 + 1e-9).all()
    scored = FORMULA(data).toPandas().set_index("timestamp").prediction
    np.testing.assert_allclose(out.set_index("timestamp").prediction.sort_index(), scored.sort_index())


def test_pdp_of_a_formula_is_its_slope(data):
    curve = ex.pdp(data, "a", FORMULA, 11).orderBy("grid_id").toPandas()
    slopes = curve.avg_pred.diff().dropna() / curve.grid_value.diff().dropna()
    np.testing.assert_allclose(slopes, 5.0)
    centred = ex.ice_centred(ex.ice(data, "a", FORMULA, points=5))
    assert centred.where("grid_id = 0 and centred <> 0").count() == 0


def test_anchor_numbers_hold_on_the_data(data):
    row = {"a": 2.0, "b": 0.0, "c": 0.0}
    got = ex.anchor(data, FEATURES, FORMULA, row).first()
    pdf = FORMULA(data).toPandas()
    cuts = np.percentile(pdf.prediction, [25, 50, 75])
    inside = np.ones(len(pdf), bool)
    for text in got["anchor"]:
        name = next(f for f in FEATURES if f in text.split())
        edges = np.percentile(pdf[name], [25, 50, 75])
        inside &= np.searchsorted(edges, pdf[name]) == np.searchsorted(edges, row[name])
    hits = np.searchsorted(cuts, pdf.prediction) == np.searchsorted(cuts, got["prediction"])
    assert got["coverage"] == pytest.approx(inside.mean(), abs=1e-4)
    assert got["precision"] == pytest.approx(hits[inside].mean(), abs=1e-4)
    assert got["anchor"] and got["rule_str"].startswith("IF ")


def test_counterfactuals_land_in_the_range(data):
    out = ex.counterfactuals(data, FEATURES, FORMULA, (15.0, 20.0), n=2, vary=["a"], tries=20).collect()
    found = [r for r in out if r["status"] == "found"]
    assert found and all(14.95 <= r["cf_prediction"] <= 20.05 and set(r["changes"]) <= {"a"} for r in found)
    assert all(1 <= r["rank"] <= 2 and r["n_changes"] == len(r["changes"]) for r in found)
    # Every input is in the result, found or not.
    keys = {(r["timestamp"], r["zone"]) for r in out}
    assert len(keys) == data.count() and all(r["rank"] == 0 and r["changes"] is None for r in out if r["status"] == "none")


def test_agreement(spark):
    def scores(*rows):
        return spark.createDataFrame(list(rows), "feature string, score double")

    out = ex.agreement(scores(("a", 3.0), ("b", 2.0), ("c", 0.1)), scores(("b", -5.0), ("c", 1.0), ("a", 0.5)), 2).collect()
    assert [(r["global_feature"], r["local_feature"]) for r in out] == [("a", "b"), ("b", "c")]
    assert out[0]["jaccard"] == 0.333
