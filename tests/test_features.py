"""Feature invariants, and that no feature sees the future."""

import pytest
from conftest import SCHEMA
from pyspark.sql import functions as F

from zonecast import fixed_values as fv
from zonecast.operators import geo
from zonecast.operators import modeling as mo
from zonecast.operators import panel as pn
from zonecast.operators import temporal as tp
from zonecast.plans import training as tr
from zonecast.session import shared_dir, streaming_session


def test_calendar_ranges(sample):
    row = tp.add_calendar(sample).agg(
        *[F.min(c).alias(f"{c}_lo") for c in ("hour", "day_of_week", "month")], *[F.max(c).alias(f"{c}_hi") for c in ("hour", "day_of_week", "month")]
    ).first()
    assert (row["hour_lo"], row["hour_hi"]) == (0, 23)
    assert (row["day_of_week_lo"], row["day_of_week_hi"]) == (0, 6)
    assert 1 <= row["month_lo"] <= row["month_hi"] <= 12


def test_fourier_bounded(sample):
    df = tp.add_fourier(sample)
    names = [c for c in df.columns if c.startswith("fourier_")]
    assert len(names) == 14
    assert df.where(" or ".join(f"abs({c}) > 1.000001" for c in names)).count() == 0


def test_poi_nonnegative(spark, sample):
    df = geo.add_poi(spark, sample)
    names = [c for c in df.columns if c.startswith("poi_")]
    assert len(names) == 8 and df.where(" or ".join(f"{c} < 0" for c in names)).count() == 0


def test_poi_reaches_listed_neighbours(spark):
    rows = {r["zone"]: r["poi_louvre"] for r in geo.add_poi(spark, spark.createDataFrame([("1",), ("4",), ("9",)], "zone string")).collect()}
    assert rows == {"1": 15.0, "4": 6.0, "9": 0.0}


def test_graph_is_not_symmetric():
    edges = {(a, b) for a, others in fv.NEIGHBOURS.items() for b in others}
    assert len(edges) == 78
    assert {e for e in edges if e[::-1] not in edges} == {("11", "4"), ("12", "5"), ("16", "7"), ("16", "8")}


def test_shares_sum_to_one(sample):
    totals = geo.add_share_and_rank(sample).groupBy("timestamp").agg(F.sum("demand_share").alias("s"))
    assert totals.where("abs(s - 1) > 0.01").count() == 0


def test_zone_codes(sample):
    rows = geo.add_zone_code(sample).select("zone", "zone_encoded").distinct().collect()
    assert {r["zone"]: r["zone_encoded"] for r in rows} == {str(z): z - 1 for z in range(1, 6)}


def test_neighbour_absent_is_skipped(spark):
    rows = [("2024-01-01 00:00:00", z, d) for z, d in [("1", 4), ("2", 6), ("16", 1)]]
    df = spark.createDataFrame(rows, "t string, zone string, demand bigint").withColumn("timestamp", F.to_timestamp_ntz("t"))
    got = {r["zone"]: r["adj_zone_demand"] for r in geo.add_neighbour_demand(spark, df).collect()}
    assert got == {"1": 6.0, "2": 4.0, "16": None}


def test_training_features_do_not_leak(spark, sample, sample_pdf):
    """Changing the last hour moves no feature at all: features look at earlier hours only."""
    changed = sample_pdf.copy()
    last = changed.timestamp == changed.timestamp.max()
    changed.loc[last, "demand"] = 999
    before, after = (
        tr.build_features(spark, df).select("timestamp", "zone", *names)
        for names in [[*[c for c in tr.build_features(spark, sample).columns if "demand" in c and c != "demand"]]]
        for df in (sample, spark.createDataFrame(changed, SCHEMA))
    )
    assert before.exceptAll(after).count() == 0


def test_parity_velocity_uses_the_current_hour(sample):
    df = tp.add_lags(tp.add_velocity(sample, dense=True), lags=[1], dense=True).where("demand_lag_1h is not null")
    assert df.where("demand <> demand_lag_1h + demand_velocity_1h").count() == 0


def test_feature_count(spark, sample):
    full = sample.withColumn("wind_speed_kmh", F.lit(1.0))
    assert len(mo.feature_columns(tr.build_features(spark, full, lagged=False))) == 71


def test_sequences_pad(sample):
    full = tp.sequences(sample, ["demand"], "demand", 24, dense=True)
    padded = tp.sequences(sample, ["demand"], "demand", 24, dense=True, pad=True)
    assert full.count() == 5 * (200 - 24) and padded.count() == 1000
    assert padded.where("sequence is null").count() == 5 * 24


def test_spine_fills_every_hour(spark):
    zones = spark.createDataFrame([("1",), ("2",)], "zone string")
    hours = [F.to_timestamp_ntz(F.lit(t)) for t in ("2024-01-01 00:00:00", "2024-01-02 05:00:00")]
    assert pn.spine(zones, *hours).distinct().count() == 60


def test_event_ends_count(spark):
    schedule = pn.city_schedule(spark, [("PSG_match", "2024-01-01 10:30:00")])
    times = ["10:00:00", "10:30:00", "11:15:00", "14:30:00", "14:31:00"]
    df = spark.createDataFrame([(f"2024-01-01 {t}", z) for t in times for z in ("16", "1")], "t string, zone string").withColumn("timestamp", F.to_timestamp_ntz("t"))
    got = {(r["t"][11:], r["zone"]): (r["is_event"], r["event_boost"]) for r in pn.active_events(df, schedule).collect()}
    assert [got[t, "16"] for t in times] == [(False, 1.0), (True, 3.0), (True, 3.0), (True, 3.0), (False, 1.0)]
    assert got["11:15:00", "1"] == (True, 1.0)


def test_streaming_session_settings(spark, tmp_path):
    assert shared_dir(spark)
    session = streaming_session(str(tmp_path))
    assert session.conf.get("spark.sql.streaming.checkpointLocation") == str(tmp_path)
    session.conf.unset("spark.sql.streaming.checkpointLocation")
