"""Stored models, versions, and what happens between two writers and in a crash."""

import threading

import pytest
from conftest import frame
from pyspark.sql import functions as F

from zonecast.operators import ensemble as en
from zonecast.operators import folds as fd
from zonecast.operators import modeling as mo
from zonecast.plans import training as tr
from zonecast.sources import models as md

FEW = {"maxIter": 3, "maxDepth": 3, "stepSize": 0.3}
NAMES = ["lag", "temperature_c", "hour"]


@pytest.fixture(scope="module")
def data(spark):
    pdf = frame(3, 120)
    pdf["lag"] = pdf["demand"] * 0.9 + 1.0
    pdf["hour"] = pdf["timestamp"].dt.hour.astype(float)
    return fd.row_index(spark.createDataFrame(pdf)).cache()


@pytest.fixture(scope="module")
def boosters(data):
    return [mo.Booster("gbt_l1", FEW).fit(data, NAMES), mo.Booster("gbt_categorical", FEW).fit(data, [*NAMES, "zone"])]


def rows(model, data):
    return sorted((r["timestamp"], r["zone"], round(r["prediction"], 9)) for r in model.predict(data).select("timestamp", "zone", "prediction").collect())


def test_every_kind_of_model_comes_back_as_it_was(spark, data, boosters, tmp_path):
    kinds = [boosters[1], en.Voting(boosters).fit(data, NAMES, fitted=boosters), en.Blending(boosters).fit(data, data, NAMES, fitted=boosters),
             en.Stacking([mo.Booster("gbt_l1", FEW), mo.Booster("gbt_alt", FEW)], n_folds=2, mode="kfold").fit(data, NAMES)]
    for i, model in enumerate(kinds):
        md.save_model(spark, model, f"{tmp_path}/{i}")
        again = md.load_model(spark, f"{tmp_path}/{i}")
        assert type(again) is type(model) and rows(again, data) == rows(model, data)


def test_champion_is_the_newest_version(spark, boosters, tmp_path):
    registry = md.ModelRegistry(spark, str(tmp_path))
    assert registry.champion() is None and registry.numbers() == []
    with pytest.raises(LookupError):
        registry.load()
    lower = lambda new: lambda old: old is None or new < old.mape
    assert registry.promote(boosters[0], "a", 20.0, lower(20.0)).number == 1
    assert registry.promote(boosters[1], "b", 15.0, lower(15.0)).label == "b-v2"
    assert registry.promote(boosters[0], "a", 16.0, lower(16.0)) is None
    version, model = registry.load()
    assert (version.number, version.features, model.kind) == (2, [*NAMES, "zone"], "gbt_categorical")
    assert registry.load(1)[0].name == "a" and registry.history().count() == 2 and registry.unpublished() == []


def test_of_two_writers_one_publishes_and_the_other_decides_again(spark, boosters, tmp_path, monkeypatch):
    registry = md.ModelRegistry(spark, str(tmp_path))
    staged = [registry.stage(b) for b in boosters]
    ready, results = threading.Barrier(2), []

    def publish(i):
        ready.wait()
        try:
            results.append(registry.publish(staged[i], boosters[i], f"m{i}", 10.0, 0).name)
        except md.VersionTaken:
            results.append("taken")

    threads = [threading.Thread(target=publish, args=(i,)) for i in (0, 1)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert sorted(results)[1] == "taken" and registry.champion().name == sorted(results)[0]

    # A writer that is overtaken sees the new champion: a better one makes it give up, a worse one is followed.
    seen = []

    def overtaken(by):
        def better(old):
            seen.append(old.number)
            if len(seen) == 1:
                registry.publish(registry.stage(boosters[0]), boosters[0], "fast", by, old.number)
            return 8.0 < old.mape
        return better

    assert registry.promote(boosters[1], "slow", 8.0, overtaken(9.0)).number == 3 and seen == [1, 2]
    assert registry.champion().name == "slow"
    seen.clear()
    monkeypatch.setattr(registry, "champion", lambda: md.ModelRegistry.champion(registry))
    better = overtaken(1.0)
    assert registry.promote(boosters[1], "late", 7.9, lambda old: better(old) or old.mape == 8.0) is None
    assert registry.champion().name == "fast" and len(registry.unpublished()) == 2


def test_a_crash_before_publishing_leaves_the_old_champion(spark, data, boosters, tmp_path, monkeypatch):
    registry = md.ModelRegistry(spark, str(tmp_path))
    registry.promote(boosters[0], "old", 10.0, lambda old: True)

    def crash(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(md, "move_new", crash)
        with pytest.raises(RuntimeError):
            registry.promote(boosters[1], "new", 5.0, lambda old: True)
    version, model = registry.load()
    assert version.name == "old" and rows(model, data) == rows(boosters[0], data) and len(registry.unpublished()) == 1
    assert registry.promote(boosters[1], "new", 5.0, lambda old: True).number == 2


def test_retraining_promotes_a_model_that_scores_requests(spark, tmp_path):
    pdf = frame(2, 420)
    pdf["wind_speed_kmh"] = 5.0
    panel = spark.createDataFrame(pdf).withColumn("event_name", F.lit(None).cast("string")).withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz"))
    settings = tr.Settings(booster=FEW, stack_folds=2, top_attribution=6, top_information=6, least_features=4, gap_rows=10, kinds=("gbt_l1", "gbt_alt"))
    first = tr.retrain(spark, panel, panel.where("timestamp > '2024-01-17'"), str(tmp_path), settings=settings).first()
    assert first["promoted"] and first["version"] == 1
    registry = md.ModelRegistry(spark, str(tmp_path))
    version, model = registry.load()
    assert version.mape == pytest.approx(first["new_mape"]) and version.name == first["challenger"]
    registry.publish(version.model, model, "perfect", 1e-6, 1)
    again = tr.retrain(spark, panel, panel.limit(0), str(tmp_path), settings=settings).first()
    assert not again["promoted"] and again["version"] is None and registry.numbers() == [1, 2]
    asked = {c: F.lit(float(i)) for i, c in enumerate(("demand_lag_1h", "demand_lag_24h", "demand_lag_168h", "demand_roll24h_mean", "hour", "day_of_week", "month"), 3)}
    requests = spark.range(3).withColumns(asked)
    scored = tr.predict_with_champion(spark, requests, str(tmp_path)).collect()
    assert len(scored) == 3 and all(r["model_version"] == "perfect-v2" and r["predicted_demand"] >= 0 for r in scored)
