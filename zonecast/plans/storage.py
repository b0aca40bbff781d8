"""Queries on sources, stores and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from zonecast.operators import drift as dr
from zonecast.operators import explain as ex
from zonecast.operators import modeling as mo
from zonecast.operators import panel as pn
from zonecast.operators import temporal as tp
from zonecast.plans import sql as q
from zonecast.plans.registry import query, rides, rounded, scored, tidy
from zonecast.session import checkpointed, new_dir
from zonecast.sources import dimensions, offline, online, sinks, tables

WEEK_TWO = ("2024-01-08 00:00:00", "2024-01-14 23:00:00")


@query("scan_rides", q.with_rides(f"SELECT {q.RIDE_COLUMNS} FROM rides"))
def scan_rides(spark: SparkSession, folder: str) -> DataFrame:
    path = new_dir(spark, "rides")
    rides(spark, folder).write.parquet(path)
    return tidy(tables.read_rides(spark, path), 9)


@query("panel_spine", q.with_rides("SELECT timestamp, zone, demand FROM rides"))
def panel_spine(spark: SparkSession, folder: str) -> DataFrame:
    zones = dimensions.zone_table(spark).select("zone")
    return pn.panel_spine(tables.events(spark, folder), zones)


def stored(spark: SparkSession, folder: str) -> offline.OfflineStore:
    store = offline.OfflineStore(spark, new_dir(spark, "offline"))
    store.write(rides(spark, folder))
    return store


@query("offline_write", q.with_rides(
    f"SELECT {q.RIDE_COLUMNS}, year(timestamp) AS year, month(timestamp) AS month FROM rides"
))
def offline_write(spark: SparkSession, folder: str) -> DataFrame:
    return tidy(stored(spark, folder).table(), 9)


@query("offline_read", q.with_rides(
    f"SELECT {q.RIDE_COLUMNS} FROM rides WHERE timestamp BETWEEN TIMESTAMP '{WEEK_TWO[0]}' AND TIMESTAMP '{WEEK_TWO[1]}' "
    "AND zone IN ('7', '11', '16') ORDER BY timestamp"
))
def offline_read(spark: SparkSession, folder: str) -> DataFrame:
    return tidy(stored(spark, folder).read(*WEEK_TWO, zones=["7", "11", "16"]), 9)


@query("training_data", q.with_rides(
    f"SELECT {q.RIDE_COLUMNS} FROM rides WHERE timestamp BETWEEN TIMESTAMP '{WEEK_TWO[0]}' AND TIMESTAMP '{WEEK_TWO[1]}'"
))
def training_data(spark: SparkSession, folder: str) -> DataFrame:
    return tidy(stored(spark, folder).read(*WEEK_TWO), 9)


@query("offline_snapshot", q.with_rides(
    f"SELECT {q.RIDE_COLUMNS} FROM rides WHERE timestamp >= (SELECT max(timestamp) FROM rides) - INTERVAL 24 HOUR"
))
def offline_snapshot(spark: SparkSession, folder: str) -> DataFrame:
    return tidy(stored(spark, folder).snapshot(24), 9)


@query("offline_partitions", q.with_rides(
    "SELECT 'year=' || year(timestamp) || '/month=' || lpad(CAST(month(timestamp) AS VARCHAR), 2, '0') AS partition, "
    "count(*) AS n_rows, true AS has_size FROM rides GROUP BY 1"
))
def offline_partitions(spark: SparkSession, folder: str) -> DataFrame:
    # File sizes depend on the writer, so only their presence is compared.
    return stored(spark, folder).partitions().select("partition", "n_rows", (F.col("size_kb") > 0).alias("has_size"))


@query("partition_union", q.with_rides(
    f"SELECT {q.RIDE_COLUMNS} FROM rides WHERE timestamp < TIMESTAMP '2024-01-11' UNION ALL "
    f"SELECT {q.RIDE_COLUMNS} FROM rides WHERE timestamp >= TIMESTAMP '2024-01-11'"
))
def partition_union(spark: SparkSession, folder: str) -> DataFrame:
    """Two separately written tables read as one."""
    panel = rides(spark, folder)
    paths = [new_dir(spark, "part") for _ in range(2)]
    early = F.col("timestamp") < F.to_timestamp_ntz(F.lit("2024-01-11"))
    panel.where(early).write.parquet(paths[0])
    panel.where(~early).write.parquet(paths[1])
    return tidy(spark.read.schema(panel.schema).parquet(*paths), 9)


LATEST = """
latest AS (SELECT zone, arg_max(temperature_c, timestamp) AS temperature_c, arg_max(precipitation_mm, timestamp) AS precipitation_mm,
           arg_max(wind_speed_kmh, timestamp) AS wind_speed_kmh, arg_max(lat, timestamp) AS lat, arg_max(lon, timestamp) AS lon
           FROM rides GROUP BY zone)"""
LATEST_COLUMNS = ", ".join(f"{q.r(c, 4)} AS {c}" for c in ("temperature_c", "precipitation_mm", "wind_speed_kmh", "lat", "lon"))


def latest_select(condition: str = "true") -> str:
    return f"WITH {q.RIDES}, {LATEST} SELECT zone, {LATEST_COLUMNS} FROM latest WHERE {condition}"


def flat(entries: DataFrame) -> DataFrame:
    names = ("temperature_c", "precipitation_mm", "wind_speed_kmh", "lat", "lon")
    return entries.select("zone", *[rounded(F.element_at("features", F.lit(n)).cast("double"), 4).alias(n) for n in names])


NOW = "2024-03-01 12:00:00"


def filled_online(spark: SparkSession, folder: str) -> online.OnlineStore:
    """Two writes: all zones long ago, then the even zones just before `NOW`."""
    store = online.OnlineStore(spark, new_dir(spark, "online"))
    latest = online.latest_features(rides(spark, folder))
    store.write(online.as_entries(latest, online.GROUP, F.to_timestamp(F.lit("2024-03-01 10:00:00"))))
    fresh = latest.where(F.col("zone").cast("int") % 2 == 0)
    store.write(online.as_entries(fresh, online.GROUP, F.to_timestamp(F.lit("2024-03-01 11:55:00"))))
    return store


@query("online_latest", latest_select())
def online_latest(spark: SparkSession, folder: str) -> DataFrame:
    return tidy(online.latest_features(rides(spark, folder)), 4)


@query("online_write", "WITH " + q.RIDES + ", " + LATEST + f""" SELECT zone, {LATEST_COLUMNS},
CASE WHEN CAST(zone AS BIGINT) % 2 = 0 THEN TIMESTAMP '2024-03-01 11:55:00' ELSE TIMESTAMP '2024-03-01 10:00:00' END AS updated_at
FROM latest""")
def online_write(spark: SparkSession, folder: str) -> DataFrame:
    entries = filled_online(spark, folder).entries()
    stamps = entries.select("zone", F.col("updated_at").cast("timestamp_ntz").alias("updated_at"))
    return flat(entries).join(stamps, "zone")


@query("online_read", latest_select("zone = '8'"))
def online_read(spark: SparkSession, folder: str) -> DataFrame:
    return flat(filled_online(spark, folder).read("8", now=F.to_timestamp(F.lit(NOW))))


@query("online_read_many", latest_select("zone IN ('2', '20')"))
def online_read_many(spark: SparkSession, folder: str) -> DataFrame:
    """Zone 7 is stale and zone 99 missing, so neither comes back."""
    return flat(filled_online(spark, folder).read_many(["2", "7", "20", "99"], now=F.to_timestamp(F.lit(NOW))))


@query("materialize", latest_select())
def materialize(spark: SparkSession, folder: str) -> DataFrame:
    off = offline.OfflineStore(spark, new_dir(spark, "offline"))
    on = online.OnlineStore(spark, new_dir(spark, "online"))
    online.materialize(rides(spark, folder), off, on, F.to_timestamp(F.lit(NOW)))
    return flat(on.entries())


@query("serving_features", latest_select("zone = '11'"))
def serving_features(spark: SparkSession, folder: str) -> DataFrame:
    on = online.OnlineStore(spark, new_dir(spark, "online"))
    latest = online.latest_features(rides(spark, folder))
    on.write(online.as_entries(latest, online.GROUP, F.to_timestamp(F.lit(NOW))))
    return flat(on.read("11", now=F.to_timestamp(F.lit(NOW))))


@query("push_realtime", "WITH " + q.RIDES + ", " + LATEST + f""" SELECT zone, {LATEST_COLUMNS} FROM latest WHERE zone <> '5'
UNION ALL SELECT '5', 21.5, 0.25, 3.0, NULL, NULL""")
def push_realtime(spark: SparkSession, folder: str) -> DataFrame:
    """One zone's features replaced by pushed ones."""
    store = filled_online(spark, folder)
    pushed = {"temperature_c": 21.5, "precipitation_mm": 0.25, "wind_speed_kmh": 3.0}
    store.push("5", pushed, F.to_timestamp(F.lit(NOW)))
    return flat(store.entries())


@query("feature_table_sink", q.with_rides(
    "SELECT timestamp, zone, demand, " + q.columns({**q.lags(), **q.rolling()}) + " FROM rides"
))
def feature_table_sink(spark: SparkSession, folder: str) -> DataFrame:
    path = new_dir(spark, "features")
    table = tp.add_rolling(tp.add_lags(rides(spark, folder), dense=True), dense=True)
    sinks.write_features(table, path)
    names = [*q.lags(), *q.rolling()]
    return spark.read.schema(table.schema).parquet(path).select("timestamp", "zone", "demand", *[rounded(n).alias(n) for n in names])


CUT = "2024-01-19 00:00:00"
SIDES = f"""
reference AS (SELECT * FROM rides WHERE timestamp < TIMESTAMP '{CUT}'),
current_rows AS (SELECT * FROM rides WHERE timestamp >= TIMESTAMP '{CUT}')"""
DRIFT_COLUMNS = ["demand", "temperature_c", "precipitation_mm", "wind_speed_kmh"]


def sides(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Reference: the first 18 days; current: the rest."""
    early = F.col("timestamp") < F.to_timestamp_ntz(F.lit(CUT))
    return df.where(early), df.where(~early)


@query("drift_log_sink", f"""WITH {q.RIDES}, {SIDES}, {q.psi('reference', 'current_rows', DRIFT_COLUMNS)}
SELECT TIMESTAMP '2024-02-01' AS run_at, count(*) AS n_features_checked,
coalesce(string_agg(CASE WHEN psi >= 0.2 THEN feature END, ',' ORDER BY feature), '') AS drifted FROM psi""")
def drift_log_sink(spark: SparkSession, folder: str) -> DataFrame:
    path = new_dir(spark, "drift-log")
    reference, current = sides(rides(spark, folder))
    run = dr.drift_run(reference, current, columns=DRIFT_COLUMNS)
    dr.append_log(run, path, F.to_timestamp(F.lit("2024-02-01")))
    return dr.read_log(spark, path).select(
        F.col("run_at").cast("timestamp_ntz").alias("run_at"), "n_features_checked",
        F.array_join("drifted_features", ",").alias("drifted"),
    )


TREND_CUTS = ["2024-01-08", "2024-01-12", "2024-01-16", "2024-01-20", "2024-01-24"]


def _trend_sql() -> str:
    parts = []
    for i, cut in enumerate(TREND_CUTS):
        text = q.psi(
            f"(SELECT * FROM rides WHERE timestamp < TIMESTAMP '{cut}') t", f"(SELECT * FROM rides WHERE timestamp >= TIMESTAMP '{cut}') t",
            ["temperature_c"],
        )
        parts.append(f"SELECT TIMESTAMP '{cut}' AS run_at, {q.r('psi', 4)} AS psi FROM (WITH {text} SELECT psi FROM psi)")
    return f"WITH {q.RIDES} " + " UNION ALL ".join(parts[-3:])


@query("drift_trend", _trend_sql())
def drift_trend(spark: SparkSession, folder: str) -> DataFrame:
    """Five logged runs, the last three shown."""
    path = new_dir(spark, "drift-log")
    panel = checkpointed(spark, rides(spark, folder))
    for cut in TREND_CUTS:
        at = F.to_timestamp_ntz(F.lit(cut))
        run = dr.drift_run(panel.where(F.col("timestamp") < at), panel.where(F.col("timestamp") >= at), columns=["temperature_c"])
        dr.append_log(run, path, F.to_timestamp(F.lit(cut)))
    return tidy(dr.drift_trend(dr.read_log(spark, path), "temperature_c", 3), 4)


@query("counterfactual_sink")
def counterfactual_sink(spark: SparkSession, folder: str) -> DataFrame:
    path = new_dir(spark, "counterfactuals")
    features = ["demand_lag_24h", "temperature_c", "hour"]
    rows = tp.add_calendar(tp.add_lags(rides(spark, folder), lags=[24], dense=True)).na.drop(subset=features)
    score = mo.Formula({"demand_lag_24h": 0.8, "temperature_c": 0.02, "hour": 0.05})
    found = ex.counterfactuals(rows, features, score, (3.0, 6.0), n=2, tries=10)
    sinks.write_counterfactuals(found, path)
    return sinks.read_counterfactuals(
        spark, path, "timestamp timestamp_ntz, zone string, rank bigint, cf_prediction double, n_changes bigint, changes string"
    )
