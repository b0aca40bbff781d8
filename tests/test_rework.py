"""Cases of wrong or lost results that were mended."""

import datetime as dt

from pyspark.sql import functions as F
from zonecast import fixed_values as fv
from zonecast.operators import modeling as mo
from zonecast.operators import panel as pn
from zonecast.operators import scoring as sc
from zonecast.plans import training as tr

EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
T0 = dt.datetime(2024, 1, 1)


def test_panel_rejects_and_counts_events_without_a_zone(spark):
    rows = [(1, T0, 3, "click", 1.0, None), (2, T0, None, "click", 1.0, None), (3, T0, -7, "view", 1.0, None)]
    events = spark.createDataFrame(rows, EVENTS)
    assert pn.demand_panel(spark, events).agg(F.sum("demand")).first()[0] == 1
    assert {r["reason"]: r["n"] for r in pn.rejected_events(events).collect()} == {"no zone": 1, "unknown zone": 1}


def test_panel_weather_does_not_depend_on_row_order(spark):
    rows = [(i, T0, i, kind, 1.0, None) for i, kind in enumerate(["view", "error", "signup"])]
    seen = {
        tuple(r["weather"] for r in pn.demand_panel(spark, spark.createDataFrame(order, EVENTS).coalesce(1)).collect())
        for order in (rows, rows[::-1], rows[1:] + rows[:1])
    }
    assert len(seen) == 1 and set(seen.pop()) <= set(fv.WEATHER_KINDS)


def test_late_delivery_of_an_old_week_keeps_the_rest(spark):
    panel = spark.createDataFrame([(T0 + dt.timedelta(hours=h), z, 1) for h in range(50) for z in "12"], "timestamp timestamp_ntz, zone string, demand int")
    late = panel.where((F.col("zone") == "1") & (F.col("timestamp") < F.lit(T0 + dt.timedelta(hours=5)))).withColumn("demand", F.lit(9))
    merged = tr.merge(panel, late)
    assert merged.count() == 100 and merged.agg(F.sum("demand")).first()[0] == 95 + 45


def test_loaded_booster_knows_its_inputs_and_many_categories(spark, tmp_path):
    for zones in (33, 80):
        df = spark.createDataFrame([(f"z{i % zones}", float(i % 7), float(i % zones)) for i in range(zones * 8)], "zone string, x double, demand double")
        model = mo.Booster("gbt_categorical", {"maxIter": 2, "maxDepth": 3}).fit(df, ["zone", "x"])
        assert "in {" in model.model.stages[-1].toDebugString
        model.save(str(tmp_path / f"m{zones}"))
        again = mo.Booster.load(str(tmp_path / f"m{zones}"), "gbt_categorical", ["zone", "x"])
        assert again.importance(spark).collect() == model.importance(spark).collect() != []


def test_reuse_counts_whole_digests():
    assert "request_key" not in sc.reuse_rate.__code__.co_names
