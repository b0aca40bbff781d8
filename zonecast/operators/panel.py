"""The dense zone-by-hour panel, made from raw events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from zonecast import fixed_values as fv
from zonecast.operators.history import over_history
from zonecast.session import checkpointed
from zonecast.sources.dimensions import small_table


def hour_start(ts: Column) -> Column:
    return F.date_trunc("hour", ts).cast("timestamp_ntz")


def spine(zones: DataFrame, first_hour: Column, last_hour: Column) -> DataFrame:
    """One row per zone and hour from `first_hour` to `last_hour`, both included."""
    hours = F.sequence(first_hour, last_hour, F.expr("interval 1 hour"))
    return zones.withColumn("timestamp", F.explode(hours))


def weather_code(event_type: Column) -> Column:
    """Stand-in weather of the test data, as a code: each event type names one kind."""
    order = ["click", "view", "signup", "error", "purchase"]
    codes = F.create_map(*[part for code, kind in enumerate(order) for part in (F.lit(kind), F.lit(code))])
    return F.coalesce(codes[event_type], F.lit(0))


def weather_name(code: Column) -> Column:
    return F.coalesce(F.get(F.array(*[F.lit(w) for w in fv.WEATHER_KINDS]), code), F.lit("clear"))


def zone_of(user_id: Column) -> Column:
    return (user_id % 20 + 1).cast("string")


def rejected() -> Column:
    """Why an event has no place in the panel: `no zone`, `unknown zone` or `no time`; null for all others."""
    zone = zone_of(F.col("user_id"))
    return F.when(F.col("user_id").isNull(), "no zone").when(~zone.isin(*fv.ZONE_CENTRES), "unknown zone").when(F.col("ts").isNull(), "no time")


def rejected_events(events: DataFrame) -> DataFrame:
    """How many events the panel leaves out, by reason."""
    return events.select(rejected().alias("reason")).where("reason IS NOT NULL").groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def hourly_demand(events: DataFrame) -> DataFrame:
    """Events combined to one row per hour and zone.

    Every aggregate has a fixed-width state (the earliest event's weather is kept
    as a code), so the raw rows are hash-combined before the only large shuffle.
    """
    return (
        events.select(
            hour_start(F.col("ts")).alias("timestamp"), zone_of(F.col("user_id")).alias("zone"),
            "ts", weather_code(F.col("event_type")).alias("code"), "event_type", "value",
        )
        .groupBy("timestamp", "zone")
        .agg(
            F.count(F.lit(1)).alias("demand"),
            F.sum("value").alias("value_sum"),
            F.count("value").alias("value_count"),
            F.min("value").alias("low"),
            F.max("value").alias("high"),
            # The earliest time with its code in one number: a tie goes to the smaller code, and hashing stays possible.
            F.min(F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)") * 8 + F.col("code")).alias("first"),
            F.bool_or((F.col("event_type") == "purchase") & (F.col("value") >= 150)).alias("promo"),
        )
    )


def demand_panel(spark: SparkSession, events: DataFrame) -> DataFrame:
    """Rides panel from events: every zone at every hour, demand 0 where nothing happened.

    Events are read once. From there on there is one row per hour (under 900,000
    in a century), holding the demand of its zones as a map; hours without events
    are filled from the gap to the next hour.
    """
    by_hour = hourly_demand(events.where(rejected().isNull())).groupBy("timestamp").agg(
        F.map_from_entries(F.collect_list(F.struct("zone", "demand"))).alias("demands"),
        (F.sum("value_sum") / F.sum("value_count")).alias("mean_value"),
        F.min("low").alias("low"),
        F.max("high").alias("high"),
        F.pmod(F.min("first"), F.lit(8)).cast("int").alias("code"),
        F.bool_or("promo").alias("promo"),
    )
    hour = F.expr("interval 1 hour")
    following = F.lead("timestamp").over(Window.partitionBy(F.lit(0)).orderBy("timestamp"))
    last_free = F.coalesce(following - hour, F.col("timestamp"))
    filled = by_hour.withColumn("_last", last_free).select(
        "*", F.explode(F.sequence("timestamp", "_last", hour)).alias("_hour")
    )
    busy = F.col("_hour") == F.col("timestamp")
    happened = F.when(busy, F.col("promo")).otherwise(F.lit(False))
    weather = F.when(busy, weather_name(F.col("code"))).otherwise(F.lit("clear"))
    hours = filled.select(
        F.col("_hour").alias("timestamp"),
        F.when(busy, F.col("demands")).alias("demands"),
        weather.alias("weather"),
        F.when(busy, F.round("mean_value", 9)).otherwise(F.lit(12.0)).alias("temperature_c"),
        F.when(weather == "clear", 0.0).otherwise(F.col("low") / 10).alias("precipitation_mm"),
        F.when(busy, F.col("high") / 10).otherwise(F.lit(0.0)).alias("wind_speed_kmh"),
        happened.alias("is_event"),
        F.when(happened, "promo").alias("event_name"),
    )
    zones = F.array(*[
        F.struct(F.lit(z).alias("zone"), F.lit(lat).alias("lat"), F.lit(lon).alias("lon"))
        for z, (lat, lon) in fv.ZONE_CENTRES.items()
    ])
    # The hours were put in order in one task; the zones of each are made in many.
    cells = hours.repartition("timestamp").withColumn("_zone", F.explode(zones))
    demand = F.coalesce(F.element_at("demands", F.col("_zone.zone")), F.lit(0)).cast("long")
    return cells.select(
        "timestamp", F.col("_zone.zone").alias("zone"), demand.alias("demand"), "weather", "temperature_c",
        "precipitation_mm", "wind_speed_kmh", "is_event", "event_name",
        F.col("_zone.lat").alias("lat"), F.col("_zone.lon").alias("lon"),
    )


def panel_spine(events: DataFrame, zones: DataFrame) -> DataFrame:
    """Zones x hours grid with the event count of each cell, 0 where there is none."""
    # Stored, as the ends of the grid and its cells both come from it: the events are read once.
    counts = checkpointed(events.sparkSession, (
        events.groupBy(hour_start(F.col("ts")).alias("timestamp"), zone_of(F.col("user_id")).alias("zone"))
        .agg(F.count(F.lit(1)).alias("demand"))
    ))
    first_hour, last_hour = (counts.agg(end("timestamp").alias("h")).scalar() for end in (F.min, F.max))
    grid = spine(zones, first_hour, last_hour)
    return grid.join(counts, ["timestamp", "zone"], "left").select(
        "timestamp", "zone", F.coalesce("demand", F.lit(0)).cast("long").alias("demand")
    )


def gappy_panel(orders: DataFrame, customers: DataFrame) -> DataFrame:
    """Daily orders per nation: a panel with real gaps, demand = orders that day."""
    return (
        orders.select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderdate").cast("timestamp_ntz").alias("timestamp"))
        .join(customers.select("c_custkey", F.col("c_nationkey").cast("string").alias("zone")), "c_custkey")
        .groupBy("timestamp", "zone")
        .agg(F.count(F.lit(1)).alias("demand"))
    )


def scored_panel(panel: DataFrame) -> DataFrame:
    """Add `pred`: demand a day earlier, else the mean of the last 24 hours; rows with neither go."""

    def columns(w):
        recent = w.rowsBetween(-24, -1)
        return {"pred": F.coalesce(F.lag("demand", 24).over(w).cast("double"), F.avg("demand").over(recent))}

    return over_history(panel, columns, back=24, dense=True).where("pred is not null")


def city_schedule(spark: SparkSession, starts: list[tuple[str, str]]) -> DataFrame:
    """City events as intervals: (event name, start) pairs -> name, zone, boost, start, end, ordinal."""
    known = {name: (zone, boost, hours) for name, zone, boost, hours in fv.CITY_EVENTS}
    rows = [(i, name, *known[name], start) for i, (name, start) in enumerate(starts)]
    table = small_table(
        spark, rows, "ordinal int, name string, zone string, boost double, hours int, start_text string"
    )
    start = F.to_timestamp_ntz("start_text")
    return table.select(
        "ordinal", "name", "zone", "boost", start.alias("start"),
        (start + F.make_dt_interval(hours=F.col("hours"))).alias("end"),
    )


def active_events(panel: DataFrame, schedule: DataFrame) -> DataFrame:
    """Add is_event, event_name and event_boost from intervals, both ends included.

    Each interval is spread over the hours it touches, so the range join becomes
    an equi join on the hour; it runs on the distinct timestamps only.
    """
    hours = F.sequence(hour_start(F.col("start")), hour_start(F.col("end")), F.expr("interval 1 hour"))
    spread = schedule.select(
        F.explode(hours).alias("_hour"), "start", "end", "name", "ordinal", "boost",
        F.col("zone").alias("_zone"),
    )
    times = panel.select("timestamp").distinct().withColumn("_hour", hour_start(F.col("timestamp")))
    active = times.join(spread, "_hour").where("timestamp between start and end")
    any_zone = active.groupBy("timestamp").agg(F.min_by("name", "ordinal").alias("event_name"))
    same_zone = active.groupBy("timestamp", F.col("_zone").alias("zone")).agg(F.max("boost").alias("_boost"))
    return (
        panel.drop("is_event", "event_name")
        .join(any_zone, "timestamp", "left")
        .join(same_zone, ["timestamp", "zone"], "left")
        .withColumn("is_event", F.col("event_name").isNotNull())
        .withColumn("event_boost", F.greatest(F.coalesce("_boost", F.lit(1.0)), F.lit(1.0)))
        .drop("_boost")
    )


def latest_per_zone(panel: DataFrame) -> DataFrame:
    """The newest row of each zone."""
    row = F.struct(*[c for c in panel.columns if c != "zone"])
    return panel.groupBy("zone").agg(F.max_by(row, "timestamp").alias("row")).select("zone", "row.*")
