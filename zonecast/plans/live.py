"""Streaming queries, and the same operators in batch form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from zonecast.plans import sql as q
from zonecast.plans.registry import query, rounded, tidy
from zonecast.session import new_dir
from zonecast.sources import tables
from zonecast.sources.online import OnlineStore
from zonecast.streaming import live

WEATHER = "CASE event_type WHEN 'view' THEN 'cloudy' WHEN 'signup' THEN 'rain' WHEN 'error' THEN 'heavy_rain' WHEN 'purchase' THEN 'snow' ELSE 'clear' END"
GPS = f"""gps AS (SELECT ts, CAST(user_id % 20 + 1 AS VARCHAR) AS zone, 1 AS demand, {WEATHER} AS weather, value / 10 AS temperature_c,
value / 100 AS precipitation_mm, value / 20 AS wind_speed_kmh, event_type = 'purchase' AS is_event, value FROM events)"""
FIVE = """five AS (SELECT time_bucket(INTERVAL 5 MINUTE, ts) AS ws, zone, sum(demand) AS demand_5min, avg(temperature_c) AS t, avg(precipitation_mm) AS p,
arg_min(weather, ts) AS weather, max(CAST(is_event AS INTEGER)) AS e FROM {source} GROUP BY 1, 2)"""
FIVE_COLUMNS = f"""ws AS window_start, ws + INTERVAL 5 MINUTE AS window_end, zone, CAST(demand_5min AS BIGINT) AS demand_5min, {q.r('t')} AS avg_temp_5min,
{q.r('p')} AS avg_precip_5min, weather, CAST(e AS BIGINT) AS is_event"""
CLOSED = "ws + INTERVAL 5 MINUTE <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE"


def messages(spark: SparkSession, folder: str) -> DataFrame:
    """Messages with flaws: no zone for values below 1, cut off in the middle for values above 480."""
    events = tables.events(spark, folder)
    no_zone = events.where("value < 1.0").withColumn("user_id", F.lit(None).cast("bigint"))
    good = live.as_messages(events.where("value between 1.0 and 480").unionByName(no_zone))
    broken = live.as_messages(events.where("value > 480"))
    text = F.substring(F.col("value").cast("string"), 1, 60)
    return good.unionByName(broken.select(text.cast("binary").alias("value")))


@query("parse_json_events", f"""WITH {GPS} SELECT ts AS event_time, zone, CAST(demand AS BIGINT) AS demand, weather, {q.r('temperature_c')} AS temperature_c,
{q.r('precipitation_mm')} AS precipitation_mm, {q.r('wind_speed_kmh')} AS wind_speed_kmh, is_event FROM gps WHERE value BETWEEN 1.0 AND 480""")
def parse_json_events(spark: SparkSession, folder: str) -> DataFrame:
    out = live.parse(messages(spark, folder), watermark=None)
    return tidy(out.select("event_time", "zone", "demand", "weather", "temperature_c", "precipitation_mm", "wind_speed_kmh", "is_event"))


@query("stream_tumbling_5m", f"WITH {GPS}, {FIVE.format(source='gps')} SELECT {FIVE_COLUMNS} FROM five")
def stream_tumbling_5m(spark: SparkSession, folder: str) -> DataFrame:
    parsed = live.parse(live.as_messages(tables.events(spark, folder)), watermark=None)
    return tidy(live.five_minute_windows(parsed))


HOURS = """hour_rows AS (SELECT unnest(generate_series(time_bucket(INTERVAL 5 MINUTE, ts) - INTERVAL 55 MINUTE, time_bucket(INTERVAL 5 MINUTE, ts), INTERVAL 5 MINUTE)) AS ws,
zone, demand FROM gps),
hour_windows AS (SELECT ws, zone, CAST(sum(demand) AS BIGINT) AS s, avg(demand) AS m, stddev_samp(demand) AS d, max(demand) AS x FROM hour_rows GROUP BY 1, 2)"""


@query("stream_sliding_1h", f"""WITH {GPS}, {HOURS} SELECT ws AS window_start, zone, s AS demand_1h, {q.r('m')} AS demand_1h_mean,
{q.r('d')} AS demand_1h_std, CAST(x AS BIGINT) AS demand_1h_max FROM hour_windows""")
def stream_sliding_1h(spark: SparkSession, folder: str) -> DataFrame:
    parsed = live.parse(live.as_messages(tables.events(spark, folder)), watermark=None)
    return tidy(live.hour_windows(parsed))


def source(spark: SparkSession, folder: str) -> DataFrame:
    return live.as_messages(live.event_file_source(spark, folder))


def drained(stream: DataFrame, spark: SparkSession, label: str) -> DataFrame:
    """Work off a stream into files and read them back."""
    path = new_dir(spark, label)
    live.start_offline(stream, path, new_dir(spark, f"{label}-checkpoint"), every=None).awaitTermination()
    return spark.read.parquet(path)


@query("stream_message_source", f"WITH {GPS} SELECT zone, count(*) AS n_messages, CAST(date_trunc('day', min(ts)) AS TIMESTAMP) AS first_day FROM gps GROUP BY zone")
def stream_message_source(spark: SparkSession, folder: str) -> DataFrame:
    path = new_dir(spark, "messages")
    writer = source(spark, folder).writeStream.format("parquet").option("path", path)
    writer.option("checkpointLocation", new_dir(spark, "messages-checkpoint")).trigger(availableNow=True).start().awaitTermination()
    parsed = live.parse(spark.read.parquet(path), watermark=None)
    return parsed.groupBy("zone").agg(
        F.count(F.lit(1)).alias("n_messages"), F.date_trunc("day", F.min("event_time")).cast("timestamp_ntz").alias("first_day")
    )


@query("stream_watermark", f"WITH {GPS} SELECT zone, count(*) AS n_rows, max(ts) AS newest FROM gps GROUP BY zone")
def stream_watermark(spark: SparkSession, folder: str) -> DataFrame:
    """Parsed rows pass the watermark operator unchanged as long as nothing is aggregated."""
    parsed = live.parse(source(spark, folder))
    rows = drained(parsed.select("zone", "event_time", F.col("event_time").alias("window_start")), spark, "watermark")
    return rows.groupBy("zone").agg(F.count(F.lit(1)).alias("n_rows"), F.max("event_time").cast("timestamp_ntz").alias("newest"))


@query("sink_stream_parquet", f"""WITH {GPS}, {FIVE.format(source='gps')} SELECT {FIVE_COLUMNS}, CAST(date_trunc('day', ws) AS TIMESTAMP) AS day FROM five WHERE {CLOSED}""")
def sink_stream_parquet(spark: SparkSession, folder: str) -> DataFrame:
    """Every closed window exactly once, partitioned by date."""
    rows = drained(live.five_minute_windows(live.parse(source(spark, folder))), spark, "five-minutes")
    return tidy(rows.withColumn("day", F.col("date").cast("timestamp_ntz")).drop("date"))


@query("stream_offline_query", f"""WITH {GPS}, {HOURS} SELECT ws AS window_start, zone, s AS demand_1h, {q.r('m')} AS demand_1h_mean
FROM hour_windows WHERE ws + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE""")
def stream_offline_query(spark: SparkSession, folder: str) -> DataFrame:
    """The sliding hours as a running query, read back after it drained its input."""
    rows = drained(live.hour_windows(live.parse(source(spark, folder))), spark, "hours")
    return tidy(rows.select("window_start", "zone", "demand_1h", "demand_1h_mean"))


LATE = "TIMESTAMP '2024-01-15'"


@query("stream_late_data", f"""WITH {GPS}, fresh AS (SELECT * FROM gps WHERE ts >= {LATE}), {FIVE.format(source='fresh')} SELECT {FIVE_COLUMNS} FROM five WHERE {CLOSED}""")
def stream_late_data(spark: SparkSession, folder: str) -> DataFrame:
    """The first half of the month arrives last, when it is too late, and is dropped.

    Lateness is judged by the watermark of the batch before, so two batches go first.
    """
    events = tables.events(spark, folder)
    path = new_dir(spark, "late-input")
    half, end = (F.to_timestamp_ntz(F.lit(d)) for d in ("2024-01-15", "2024-01-29"))
    ts = F.col("ts")
    for part in ((ts >= half) & (ts < end), ts >= end, ts < half):
        events.where(part).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(path)
    rows = drained(live.five_minute_windows(live.parse(live.as_messages(stream))), spark, "late")
    return tidy(rows.drop("date"))


NEWEST = """newest AS (SELECT * FROM five QUALIFY row_number() OVER (PARTITION BY zone ORDER BY ws DESC) = 1)"""
ENTRY_COLUMNS = f"""zone, {q.r('demand_5min', 4)} AS demand_5min, {q.r('CASE WHEN coalesce(t, 0) = 0 THEN 12 ELSE t END', 4)} AS avg_temp_5min,
{q.r('coalesce(p, 0)', 4)} AS avg_precip_5min, coalesce(weather, 'clear') AS weather, CAST(e AS BIGINT) AS is_event, ws + INTERVAL 5 MINUTE AS updated_at"""


def flat(entries: DataFrame) -> DataFrame:
    def field(name: str):
        return F.element_at("features", F.lit(name))

    numbers = [rounded(field(n).cast("double"), 4).alias(n) for n in ("demand_5min", "avg_temp_5min", "avg_precip_5min")]
    return entries.select(
        "zone", *numbers, field("weather").alias("weather"), field("is_event").cast("bigint").alias("is_event"),
        F.col("updated_at").cast("timestamp_ntz").alias("updated_at"),
    )


@query("sink_stream_latest", f"WITH {GPS}, {FIVE.format(source='gps')}, {NEWEST} SELECT {ENTRY_COLUMNS} FROM newest")
def sink_stream_latest(spark: SparkSession, folder: str) -> DataFrame:
    """The batch writer on one batch of windows."""
    store = OnlineStore(spark, new_dir(spark, "live-online"), live.STREAM_TTL)
    parsed = live.parse(live.as_messages(tables.events(spark, folder)), watermark=None)
    store.write(live.window_entries(live.five_minute_windows(parsed)))
    return flat(store.entries())


@query("stream_online_query", f"WITH {GPS}, {FIVE.format(source='gps')}, {NEWEST} SELECT {ENTRY_COLUMNS} FROM newest")
def stream_online_query(spark: SparkSession, folder: str) -> DataFrame:
    store = OnlineStore(spark, new_dir(spark, "live-online"), live.STREAM_TTL)
    windows = live.five_minute_windows(live.parse(source(spark, folder)))
    live.start_online(windows, store, new_dir(spark, "live-checkpoint"), every=None).awaitTermination()
    return flat(store.entries())


@query("stream_both_sinks", f"""WITH {GPS}, {FIVE.format(source='gps')}, {HOURS}
SELECT (SELECT count(DISTINCT zone) FROM five) AS n_online, (SELECT count(*) FROM five WHERE {CLOSED}) AS n_five,
(SELECT count(*) FROM hour_windows WHERE ws + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE) AS n_hours""")
def stream_both_sinks(spark: SparkSession, folder: str) -> DataFrame:
    """Online and offline queries side by side, each with its own checkpoint."""
    out, store = new_dir(spark, "live-out"), OnlineStore(spark, new_dir(spark, "live-online"))
    for running in live.start_all(source(spark, folder), store, out, new_dir(spark, "live-checkpoints"), once=True).values():
        running.awaitTermination()
    count = F.count(F.lit(1))
    return store.entries().agg(count.alias("n_online")).select(
        "n_online", spark.read.parquet(f"{out}/five_minutes").agg(count.alias("n")).scalar().alias("n_five"),
        spark.read.parquet(f"{out}/hours").agg(count.alias("n")).scalar().alias("n_hours"),
    )
