"""Stores, sinks and live queries."""

import pytest
from conftest import SCHEMA, frame
from pyspark.sql import functions as F

from zonecast.operators import scoring as sc
from zonecast.sources import offline, online
from zonecast.streaming import live


def at(text):
    return F.to_timestamp(F.lit(text))


def test_offline_write_replaces_only_touched_months(spark, tmp_path):
    store = offline.OfflineStore(spark, str(tmp_path / "off"))
    df = spark.createDataFrame(frame(2, 24 * 40), SCHEMA)
    store.write(df)
    february = df.where("timestamp >= '2024-02-01'").withColumn("demand", F.lit(-1).cast("bigint"))
    store.write(february)
    assert store.table().where("month = 2 and demand <> -1").count() == 0
    assert store.table().where("month = 1 and demand > 0").count() == 2 * 24 * 31
    parts = {r["partition"]: r["n_rows"] for r in store.partitions().collect()}
    assert parts == {"year=2024/month=01": 2 * 24 * 31, "year=2024/month=02": 2 * 24 * 9}
    # Newest 30 hours reach back over the month's end when few February hours are there.
    assert store.snapshot(24 * 10).count() == 2 * (24 * 10 + 1)


def test_offline_read_prunes_partitions(spark, tmp_path):
    store = offline.OfflineStore(spark, str(tmp_path / "off"))
    store.write(spark.createDataFrame(frame(1, 24 * 70), SCHEMA))
    got = store.read("2024-02-03 00:00:00", "2024-02-03 05:00:00")
    assert got.count() == 6
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull" in plan or "year#" in plan.split("PartitionFilters")[1][:200]
    assert "PushedFilters: [IsNotNull(timestamp)" in plan


def entry(spark, zone, value, when):
    row = spark.createDataFrame([(zone, "g", {"x": value})], "zone string, feature_group string, features map<string,string>")
    return row.withColumn("updated_at", at(when))


def test_online_upsert_keeps_the_newest(spark, tmp_path):
    store = online.OnlineStore(spark, str(tmp_path / "on"), ttl_seconds=600)
    assert store.entries().count() == 0
    store.write(entry(spark, "1", "new", "2024-01-01 10:00:00"))
    store.write(entry(spark, "1", "old", "2024-01-01 09:00:00"))
    store.write(entry(spark, "2", "b", "2024-01-01 10:00:00"))
    now = at("2024-01-01 10:05:00")
    assert store.read("1", "g", now).first()["features"] == {"x": "new"}
    assert store.read_many(["1", "2", "3"], "g", now).count() == 2
    assert store.read("1", "g", at("2024-01-01 10:10:00")).count() == 0  # exactly at its end of life
    assert store.read("1", "other", now).count() == 0


def files(folder):
    return {str(f.relative_to(folder)): f.stat().st_size for f in folder.rglob("*.parquet")}


def test_a_write_makes_files_for_the_buckets_it_touches_only(spark, tmp_path):
    store = online.OnlineStore(spark, str(tmp_path / "on"))
    many = spark.range(500).selectExpr("CAST(id AS STRING) AS zone", "'g' AS feature_group", "map('x', 'a') AS features", "timestamp'2024-01-01 10:00:00' AS updated_at")
    store.write(many)
    before = files(tmp_path / "on")
    assert len(before) == online.BUCKETS
    store.write(entry(spark, "7", "b", "2024-01-01 11:00:00"))
    new = files(tmp_path / "on")
    assert len(new) == len(before) + 1 and all(new[f] == n for f, n in before.items())
    got = {r["zone"]: r["features"]["x"] for r in store.entries().collect()}
    assert len(got) == 500 and got["7"] == "b" and set(got.values()) == {"a", "b"}
    # A look-up opens the files of its bucket: one of the base, one of the delta.
    found = store.read("7", "g", at("2024-01-01 11:00:01"))
    assert found.first()["features"] == {"x": "b"}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "bucket" in plan.split("PartitionFilters:")[1][:80]


def test_repeated_writes_and_batches_change_nothing(spark, tmp_path):
    store = online.OnlineStore(spark, str(tmp_path / "on"))
    store.write(entry(spark, "1", "a", "2024-01-01 10:00:00"))
    for _ in range(3):
        store.write(entry(spark, "1", "b", "2024-01-01 11:00:00"))
        assert [r["features"]["x"] for r in store.entries().collect()] == ["b"]
    store.write(entry(spark, "2", "c", "2024-01-01 11:00:00"), "q-7")
    before = files(tmp_path / "on")
    store.write(entry(spark, "2", "other", "2024-01-01 12:00:00"), "q-7")
    assert files(tmp_path / "on") == before and store.read("2", "g", at("2024-01-01 11:00:00")).first()["features"] == {"x": "c"}


def test_compaction_keeps_what_is_alive(spark, tmp_path):
    store = online.OnlineStore(spark, str(tmp_path / "on"), ttl_seconds=3600, keep_versions=1, compact_after=4)
    for hour, zone in ((6, "1"), (10, "2"), (10, "3")):
        store.write(entry(spark, zone, "a", f"2024-01-01 {hour:02d}:00:00"))
    assert store.versions() == [0, 1, 2] and store.entries().count() == 3
    store.write(entry(spark, "3", "b", "2024-01-01 10:30:00"))
    assert store.versions() == [3] and store._needed() == ["b000000000003"]
    assert {r["zone"]: r["features"]["x"] for r in store.entries().collect()} == {"2": "a", "3": "b"}
    store.write(entry(spark, "2", "late", "2024-01-01 09:00:00"))
    store.write(entry(spark, "4", "c", "2024-01-01 10:40:00"))
    assert store._needed() == ["b000000000003", "d000000000004", "d000000000005"]
    assert {r["zone"]: r["features"]["x"] for r in store.entries().collect()} == {"2": "a", "3": "b", "4": "c"}
    store.compact()
    store.compact()
    assert store._needed() == ["b000000000005"] and store.entries().count() == 3


def test_unfinished_write_is_not_read(spark, tmp_path):
    store = online.OnlineStore(spark, str(tmp_path / "on"))
    store.write(entry(spark, "1", "a", "2024-01-01 10:00:00"))
    (tmp_path / "on" / "d000000000001").mkdir()
    (tmp_path / "on" / "b000000000000").mkdir()
    assert store.versions() == [0]
    store.write(entry(spark, "1", "b", "2024-01-01 11:00:00"))
    assert store.versions() == [0, 1] and store.entries().first()["features"] == {"x": "b"}


def test_stream_defaults(spark):
    rows = [("1", None, None, None, None, None), ("2", 3, 0.0, 1.5, "", 1)]
    df = spark.createDataFrame(rows, "zone string, demand_5min bigint, avg_temp_5min double, avg_precip_5min double, weather string, is_event int")
    df = df.withColumn("window_start", at("2024-01-01 10:00:00"))
    got = {r["zone"]: tuple(r)[1:] for r in live.stream_features(df).collect()}
    assert got == {"1": (0.0, 12.0, 0.0, "clear", 0), "2": (3.0, 12.0, 1.5, "clear", 1)}


def messages(spark, rows):
    return spark.createDataFrame([(r.encode(),) for r in rows], "value binary")


def test_broken_messages_are_dropped(spark):
    good = '{"timestamp": "2024-01-01T10:01:00", "zone": "3", "demand": 4, "is_event": true}'
    rows = [good, '{"timestamp": "2024-01-01T10:01:00", "demand": 4}', "nonsense", good[:20]]
    out = live.parse(messages(spark, rows), watermark=None).collect()
    assert len(out) == 1 and out[0]["zone"] == "3" and out[0]["demand"] == 4


def test_sliding_hours_repeat_each_event_twelve_times(spark):
    row = '{"timestamp": "2024-01-01T10:01:00", "zone": "3", "demand": 4}'
    out = live.hour_windows(live.parse(messages(spark, [row]), watermark=None)).collect()
    assert len(out) == 12 and all(r["demand_1h"] == 4 and r["demand_1h_std"] is None for r in out)


def test_kafka_source_needs_its_connector(spark):
    with pytest.raises(Exception, match="kafka"):
        live.kafka_source(spark, "nowhere:9092", "gps")


REQUEST = {
    "zone": "11", "hour": 18, "day_of_week": 4, "month": 3, "weather": "rain", "temperature_c": 10.0, "precipitation_mm": 5.0, "is_event": False,
    "demand_lag_1h": 15.0, "demand_lag_24h": 12.0, "demand_lag_168h": 11.0, "demand_roll24h_mean": 13.0,
}
REQUEST_SCHEMA = (
    "zone string, hour bigint, day_of_week bigint, month bigint, weather string, temperature_c double, precipitation_mm double, is_event boolean, "
    "demand_lag_1h double, demand_lag_24h double, demand_lag_168h double, demand_roll24h_mean double"
)


@pytest.mark.parametrize("field,value", [
    ("zone", "99"), ("hour", 24), ("day_of_week", 7), ("month", 0), ("weather", "tornado"), ("temperature_c", 46.0), ("precipitation_mm", -1.0),
    ("demand_lag_1h", -0.5), ("weather", None),
])
def test_invalid_requests(spark, field, value):
    df = spark.createDataFrame([{**REQUEST, field: value}], REQUEST_SCHEMA)
    row = sc.validate(df).first()
    assert row["errors"] == [field] and not row["valid"]


def test_request_features_and_answer(spark):
    df = sc.with_defaults(spark.createDataFrame([REQUEST, {**REQUEST, "is_event": None, "demand_lag_1h": None}], REQUEST_SCHEMA))
    assert sc.validate(df).where("valid").count() == 2
    features = sc.to_features(df)
    first, second = features.collect()
    assert (first["zone_encoded"], first["weather_encoded"], first["is_rush_pm"], first["is_friday_night"]) == (10, 2, 1, 0)
    assert second["demand_lag_1h"] == 10.0 and second["is_event"] == 0
    out = sc.predict_with_reuse(features.unionByName(features), lambda d: d.withColumn("prediction", F.col("demand_lag_1h") - 12), "v1")
    assert out.count() == 4
    for row in out.collect():
        assert row["confidence_low"] <= row["predicted_demand"] <= row["confidence_high"] and row["predicted_demand"] >= 0
    rate = sc.reuse_rate(features.unionByName(features)).first()
    assert (rate["hits"], rate["misses"], rate["hit_rate"]) == (2, 2, 0.5)


def test_snapshot_opens_one_month_only(spark, tmp_path):
    rows = spark.sql("SELECT timestampadd(HOUR, id * 6, timestamp_ntz'2024-01-01') AS timestamp, '1' AS zone, id AS demand FROM range(480)")
    store = offline.OfflineStore(spark, str(tmp_path / "o"))
    store.write(rows)
    assert store.months() == [(2024, 1), (2024, 2), (2024, 3), (2024, 4)]
    newest = store.snapshot(24)
    assert sorted(r["demand"] for r in newest.collect()) == [475, 476, 477, 478, 479]
    plan = newest._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and len({f.split("month=")[1][0] for f in newest.inputFiles() if "month=" in f} & {"4"}) == 1
    read = {r["f"].split("month=")[1].split("/")[0] for r in newest.select(F.col("_metadata.file_path").alias("f")).distinct().collect()}
    assert read == {"4"}


def test_profile_gives_the_same_drift_without_the_reference(spark, sample, tmp_path):
    from zonecast.operators import drift as dr

    names = ["demand", "temperature_c", "precipitation_mm"]
    reference, current = sample.where("zone <= '3'"), sample.where("zone > '3'").withColumn("temperature_c", F.col("temperature_c") + 2)
    dr.ReferenceProfile.of(reference, names).save(str(tmp_path / "p"))
    profile = dr.ReferenceProfile.load(spark, str(tmp_path / "p"))
    for plain, stored in ((dr.psi_by_feature(reference, current, names), dr.psi_by_feature(profile, current, names)),
                          (dr.ks_by_feature(reference, current, names), dr.ks_by_feature(profile, current, names))):
        want = {r["feature"]: [v for v in r if not isinstance(v, str)] for r in plain.collect()}
        assert {r["feature"]: [v for v in r if not isinstance(v, str)] for r in stored.collect()} == {f: pytest.approx(v) for f, v in want.items()}
    run = dr.drift_run(profile, current, columns=names).first()
    assert run["n_features_checked"] == 3 and run == dr.drift_run(reference, current, columns=names).first()
    two = dr.ReferenceProfile.of(reference.where("zone = '1'"), names).plus(dr.ReferenceProfile.of(reference.where("zone <> '1'"), names))
    assert {r["feature"]: tuple(r["counts"]) for r in two.bins.collect()} == {r["feature"]: tuple(r["counts"]) for r in profile.bins.collect()}
    grown = dr.ReferenceProfile.of(reference, names)
    assert grown.columns() and dr.psi_by_feature(profile, current.limit(0), names).count() == 0
