"""Queries on projections, features and windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from zonecast import fixed_values as fv
from zonecast.operators import explore as eda
from zonecast.operators import geo
from zonecast.operators import modeling as mo
from zonecast.operators import panel as pn
from zonecast.operators import pricing as pr
from zonecast.operators import temporal as tp
from zonecast.plans import sql as q
from zonecast.plans.registry import query, rides, rounded, scored, stored_rides, tidy
from zonecast.sources import dimensions, tables

KEYS = ["timestamp", "zone"]


def pick(df: DataFrame, names: list[str], places: int = 6, whole: tuple[str, ...] = ()) -> DataFrame:
    return df.select(*KEYS, *[F.col(n).cast("bigint").alias(n) if n in whole else rounded(n, places).alias(n) for n in names])


def all_features(spark: SparkSession, folder: str) -> DataFrame:
    """The panel with its 71 features."""
    return geo.add_geo(spark, tp.add_temporal(stored_rides(spark, folder), dense=True))


CAL = tuple(tp.CALENDAR_COLUMNS)


@query("calendar_features", q.with_rides(f"SELECT timestamp, zone, {q.columns(q.calendar(), CAL)} FROM rides"))
def calendar_features(spark: SparkSession, folder: str) -> DataFrame:
    return pick(tp.add_calendar(rides(spark, folder)), list(CAL), whole=CAL)


ORDER_HOLIDAY = f"CAST(month(o_orderdate) * 100 + day(o_orderdate) IN ({', '.join(map(str, fv.HOLIDAYS))}) AS BIGINT)"


@query("holiday_flag", f"SELECT CAST(o_orderdate AS TIMESTAMP) AS timestamp, {ORDER_HOLIDAY} AS is_holiday, count(*) AS n_orders "
       "FROM orders GROUP BY 1, 2")
def holiday_flag(spark: SparkSession, folder: str) -> DataFrame:
    """On the order dates, which cover whole years."""
    days = tables.table(spark, folder, "orders").groupBy(F.col("o_orderdate").cast("timestamp_ntz").alias("timestamp")).agg(
        F.count(F.lit(1)).alias("n_orders")
    )
    return tp.add_calendar(days).select("timestamp", "is_holiday", "n_orders")


FOURIER = q.fourier({name: q.SINCE_START for name in fv.FOURIER_PERIODS})


@query("fourier_features", q.with_rides(f"SELECT timestamp, zone, {q.columns(FOURIER)} FROM rides"))
def fourier_features(spark: SparkSession, folder: str) -> DataFrame:
    return pick(tp.add_fourier(stored_rides(spark, folder)), list(FOURIER))


@query("lag_features", q.with_rides(f"SELECT timestamp, zone, demand, {q.columns(q.lags())} FROM rides"))
def lag_features(spark: SparkSession, folder: str) -> DataFrame:
    return pick(tp.add_lags(rides(spark, folder), dense=True), ["demand", *q.lags()], whole=("demand",))


GAPPY = """gappy AS (SELECT CAST(o_orderdate AS TIMESTAMP) AS timestamp, CAST(c_nationkey AS VARCHAR) AS zone, count(*) AS demand
FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1, 2)"""


@query("lag_features_gappy", f"WITH {GAPPY} SELECT timestamp, zone, demand, {q.columns(q.lags())} FROM gappy")
def lag_features_gappy(spark: SparkSession, folder: str) -> DataFrame:
    """Row lags on a panel with missing days: positions are counted, not taken from the clock."""
    daily = pn.gappy_panel(tables.table(spark, folder, "orders"), tables.table(spark, folder, "customer"))
    return pick(tp.add_lags(daily), ["demand", *q.lags()], whole=("demand",))


@query("rolling_features", q.with_rides(f"SELECT timestamp, zone, {q.columns(q.rolling())} FROM rides"))
def rolling_features(spark: SparkSession, folder: str) -> DataFrame:
    return pick(tp.add_rolling(rides(spark, folder), dense=True), list(q.rolling()))


@query("velocity_features", q.with_rides(f"SELECT timestamp, zone, {q.columns(q.velocity())} FROM rides"))
def velocity_features(spark: SparkSession, folder: str) -> DataFrame:
    return pick(tp.add_velocity(rides(spark, folder), dense=True), list(q.velocity()))


@query("temporal_features", q.with_rides(f"SELECT timestamp, zone, {q.columns(q.TEMPORAL, CAL)} FROM rides"))
def temporal_features(spark: SparkSession, folder: str) -> DataFrame:
    return pick(tp.add_temporal(stored_rides(spark, folder), dense=True), list(q.TEMPORAL), whole=CAL)


def geo_sql(names: list[str]) -> str:
    chosen = {n: q.GEO[n] for n in names}
    return f"WITH {q.RIDES}, {q.GEO_CTES} SELECT rides.timestamp AS timestamp, rides.zone AS zone, {q.columns(chosen)} FROM {q.GEO_FROM}"


@query("zone_encode", geo_sql(["zone_encoded"]))
def zone_encode(spark: SparkSession, folder: str) -> DataFrame:
    return pick(geo.add_zone_code(rides(spark, folder)), ["zone_encoded"])


CLUSTERS = [f"cluster_{c}" for c in fv.CLUSTERS]


@query("zone_cluster_onehot", f"""WITH {q.RIDES}, {q.GEO_CTES} SELECT rides.timestamp AS timestamp, rides.zone AS zone,
{q.CLUSTER.replace('zone', 'rides.zone')} AS zone_cluster, {q.columns({n: q.GEO[n] for n in CLUSTERS})} FROM {q.GEO_FROM}""")
def zone_cluster_onehot(spark: SparkSession, folder: str) -> DataFrame:
    out = geo.add_zone_cluster(spark, rides(spark, folder))
    return out.select(*KEYS, "zone_cluster", *[rounded(c).alias(c) for c in CLUSTERS])


@query("poi_proximity", geo_sql(list(q.POI)))
def poi_proximity(spark: SparkSession, folder: str) -> DataFrame:
    return pick(geo.add_poi(spark, rides(spark, folder)), list(q.POI))


@query("adjacency_demand", geo_sql(["adj_zone_demand"]))
def adjacency_demand(spark: SparkSession, folder: str) -> DataFrame:
    return pick(geo.add_neighbour_demand(spark, stored_rides(spark, folder)), ["adj_zone_demand"])


@query("demand_share", geo_sql(["demand_share"]))
def demand_share(spark: SparkSession, folder: str) -> DataFrame:
    return pick(geo.add_share_and_rank(rides(spark, folder)), ["demand_share"])


@query("demand_rank", geo_sql(["demand_rank"]))
def demand_rank(spark: SparkSession, folder: str) -> DataFrame:
    return pick(geo.add_share_and_rank(rides(spark, folder)), ["demand_rank"])


@query("geo_features", geo_sql(list(q.GEO)))
def geo_features(spark: SparkSession, folder: str) -> DataFrame:
    return pick(geo.add_geo(spark, stored_rides(spark, folder)), list(q.GEO))


@query("feature_columns", q.with_features("SELECT feature, count(*) AS n_values FROM " + q.unpivot("features", q.ALL_FEATURES) + " GROUP BY feature"))
def feature_columns(spark: SparkSession, folder: str) -> DataFrame:
    """The model's feature names, each with its number of present values."""
    df = all_features(spark, folder)
    names = mo.feature_columns(df)
    counts = df.agg(*[F.count(n).alias(n) for n in names])
    pairs = F.array(*[F.struct(F.lit(n).alias("feature"), F.col(n).alias("n_values")) for n in names])
    return counts.select(F.explode(pairs).alias("p")).select("p.*")


GROUP_RULES = {
    "Lag": "contains(feature, 'lag')",
    "Rolling": "contains(feature, 'roll')",
    "Calendar": "feature IN ('hour','day_of_week','month','is_weekend','is_rush_am','is_rush_pm','is_night','is_holiday','is_friday_night')",
    "Fourier": "contains(feature, 'fourier')",
    "Geo": "contains(feature, 'zone') OR contains(feature, 'poi') OR contains(feature, 'adj') OR contains(feature, 'cluster') OR contains(feature, 'demand_share')",
    "Context": "feature IN ('temperature_c','precipitation_mm','wind_speed_kmh','weather_encoded')",
}


@query("feature_groups", q.with_features(
    "SELECT feature_group, count(*) AS n_features, CAST(sum(n) AS BIGINT) AS n_values FROM (" + " UNION ALL ".join(
        f"SELECT '{g}' AS feature_group, n FROM counts WHERE {rule}" for g, rule in GROUP_RULES.items()
    ) + ") GROUP BY feature_group"
).replace(q.FEATURES, q.FEATURES + ", counts AS (SELECT feature, count(*) AS n FROM " + q.unpivot("features", q.ALL_FEATURES) + " GROUP BY feature)"))
def feature_groups(spark: SparkSession, folder: str) -> DataFrame:
    df = all_features(spark, folder)
    return eda.feature_groups(df, mo.feature_columns(df))


@query("drop_nulls", q.with_features(
    "SELECT timestamp, zone, demand FROM features WHERE " + " AND ".join(f"{f} IS NOT NULL" for f in q.ALL_FEATURES)
))
def drop_nulls(spark: SparkSession, folder: str) -> DataFrame:
    df = all_features(spark, folder)
    return mo.drop_nulls(df, mo.feature_columns(df)).select(*KEYS, "demand")


@query("fill_zero", q.with_rides("SELECT timestamp, zone, " + q.columns({n: f"coalesce({e}, 0)" for n, e in q.lags().items()}) + " FROM rides"))
def fill_zero(spark: SparkSession, folder: str) -> DataFrame:
    return pick(tp.add_lags(rides(spark, folder), dense=True).na.fill(0, subset=list(q.lags())), list(q.lags()))


@query("filter_zone", q.with_rides("SELECT timestamp, zone, demand FROM rides WHERE zone IN ('11', '16')"))
def filter_zone(spark: SparkSession, folder: str) -> DataFrame:
    return rides(spark, folder).where(F.col("zone").isin("11", "16")).select(*KEYS, "demand")


@query("zone_attributes", q.with_rides(
    f"SELECT timestamp, rides.zone AS zone, {q.CLUSTER.replace('zone', 'rides.zone')} AS zone_cluster, lat, lon FROM rides"
))
def zone_attributes(spark: SparkSession, folder: str) -> DataFrame:
    return rides(spark, folder).select(*KEYS).join(dimensions.zone_table(spark), "zone", "left").select(*KEYS, "zone_cluster", "lat", "lon")


SCHEDULE = [
    ("PSG_match", "2024-01-03 18:00:00"), ("concert_bercy", "2024-01-03 20:00:00"), ("roland_garros", "2024-01-03 15:30:00"),
    ("fashion_week", "2024-01-12 14:00:00"), ("bastille_day", "2024-01-12 20:00:00"),
]
_KNOWN = {name: (zone, boost, hours) for name, zone, boost, hours in fv.CITY_EVENTS}
SCHEDULE_SQL = "schedule(ordinal, name, zone, boost, s, e) AS (VALUES " + ", ".join(
    f"({i}, '{n}', '{_KNOWN[n][0]}', {_KNOWN[n][1]}::DOUBLE, TIMESTAMP '{s}', TIMESTAMP '{s}' + INTERVAL {_KNOWN[n][2]} HOUR)"
    for i, (n, s) in enumerate(SCHEDULE)
) + ")"


@query("event_interval_join", f"""WITH {q.RIDES}, {SCHEDULE_SQL},
hit AS (SELECT r.timestamp AS timestamp, r.zone AS zone, arg_min(s.name, s.ordinal) AS event_name,
        max(CASE WHEN s.zone = r.zone THEN s.boost END) AS boost
        FROM rides r JOIN schedule s ON r.timestamp BETWEEN s.s AND s.e GROUP BY r.timestamp, r.zone)
SELECT r.timestamp AS timestamp, r.zone AS zone, hit.event_name IS NOT NULL AS is_event, hit.event_name AS event_name,
greatest(coalesce(hit.boost, 1.0), 1.0)::DOUBLE AS event_boost
FROM rides r LEFT JOIN hit ON hit.timestamp = r.timestamp AND hit.zone = r.zone""")
def event_interval_join(spark: SparkSession, folder: str) -> DataFrame:
    out = pn.active_events(rides(spark, folder), pn.city_schedule(spark, SCHEDULE))
    return out.select(*KEYS, "is_event", "event_name", "event_boost")


def _case(values: list[float], index: str) -> str:
    return f"CASE {index} " + " ".join(f"WHEN {i} THEN {v}::DOUBLE" for i, v in enumerate(values)) + " END"


def _weather_case(factors: dict[str, float]) -> str:
    return "CASE weather " + " ".join(f"WHEN '{w}' THEN {v}::DOUBLE" for w, v in factors.items()) + " ELSE 1.0::DOUBLE END"


@query("demand_factors", f"""WITH {q.RIDES}, {SCHEDULE_SQL},
base AS (SELECT zone, avg(demand) AS b FROM rides GROUP BY zone),
boosts AS (SELECT r.timestamp AS timestamp, r.zone AS zone, max(s.boost) AS boost FROM rides r
           JOIN schedule s ON r.timestamp BETWEEN s.s AND s.e AND s.zone = r.zone GROUP BY r.timestamp, r.zone)
SELECT rides.timestamp AS timestamp, rides.zone AS zone,
{q.r(f"b * {_case(fv.HOUR_FACTORS, 'hour(rides.timestamp)')} * {_case(fv.DAY_FACTORS, '(isodow(rides.timestamp) - 1)')} * {_weather_case(fv.WEATHER_FACTORS)} * greatest(coalesce(boost, 1.0), 1.0)", 9)} AS expected_demand
FROM rides JOIN base ON base.zone = rides.zone LEFT JOIN boosts ON boosts.timestamp = rides.timestamp AND boosts.zone = rides.zone""")
def demand_factors(spark: SparkSession, folder: str) -> DataFrame:
    """The zone's mean demand as its base."""
    panel = rides(spark, folder)
    base = panel.groupBy("zone").agg(F.avg("demand").alias("base"))
    with_events = pn.active_events(panel, pn.city_schedule(spark, SCHEDULE)).join(base, "zone")
    return pick(pr.expected_demand(with_events, F.col("base"), F.col("event_boost")), ["expected_demand"], 9)


@query("hourly_profile", f"""WITH {q.RIDES},
day_ago AS (SELECT timestamp, zone, weather, lag(demand, 24) OVER ({q.BY_ZONE}) AS l FROM rides),
hours24 AS (SELECT unnest(range(0, 24)) AS hh),
levels AS (SELECT timestamp, zone, hh, l * {_weather_case(fv.PROFILE_WEATHER_FACTORS)} * {_case(fv.HOUR_FACTORS, 'hh')} AS v
           FROM day_ago, hours24 WHERE l IS NOT NULL)
SELECT timestamp, zone, CAST(hh AS BIGINT) AS profile_hour, {q.r('v')} AS profile_demand,
CASE WHEN v / 10.0::DOUBLE >= 2.0 THEN 'high' WHEN v / 10.0::DOUBLE >= 1.5 THEN 'raised' ELSE 'normal' END AS band FROM levels""")
def hourly_profile(spark: SparkSession, folder: str) -> DataFrame:
    day_ago = tp.add_lags(rides(spark, folder), lags=[24], dense=True).where("demand_lag_24h is not null")
    out = pr.hourly_profile(day_ago)
    return out.select(*KEYS, F.col("profile_hour").cast("bigint").alias("profile_hour"), rounded("profile_demand").alias("profile_demand"), "band")


@query("sequence_windows", f"""WITH {q.RIDES},
seq AS (SELECT timestamp, zone, demand, list([demand::DOUBLE, temperature_c]) OVER ({q.BY_ZONE} ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING) AS s FROM rides)
SELECT timestamp, zone, demand, CAST(len(s) AS BIGINT) AS n_steps, s[1][1] AS oldest_demand, s[24][1] AS newest_demand, {q.r('s[12][2]', 9)} AS middle_temperature
FROM seq WHERE len(s) = 24""")
def sequence_windows(spark: SparkSession, folder: str) -> DataFrame:
    out = tp.sequences(rides(spark, folder), ["demand", "temperature_c"], "demand", 24, dense=True)
    step = lambda i, j: F.get(F.get("sequence", F.lit(i)), F.lit(j))
    return out.select(
        *KEYS, "demand", F.size("sequence").cast("bigint").alias("n_steps"), step(0, 0).alias("oldest_demand"),
        step(23, 0).alias("newest_demand"), rounded(step(11, 1), 9).alias("middle_temperature"),
    )


@query("latest_per_zone", q.with_rides(
    f"SELECT {q.RIDE_COLUMNS} FROM rides QUALIFY row_number() OVER (PARTITION BY zone ORDER BY timestamp DESC) = 1"
))
def latest_per_zone(spark: SparkSession, folder: str) -> DataFrame:
    return tidy(pn.latest_per_zone(rides(spark, folder)), 9)


@query("distinct_zones", q.with_rides("SELECT DISTINCT zone FROM rides"))
def distinct_zones(spark: SparkSession, folder: str) -> DataFrame:
    return rides(spark, folder).select("zone").distinct()


@query("sort_panel", q.with_rides("SELECT timestamp, zone, demand FROM rides ORDER BY zone, timestamp"))
def sort_panel(spark: SparkSession, folder: str) -> DataFrame:
    return rides(spark, folder).select(*KEYS, "demand").orderBy("zone", "timestamp")


@query("standardise", q.with_rides("SELECT timestamp, zone, " + ", ".join(
    q.r(f"({c} - avg({c}) OVER ()) / (stddev_pop({c}) OVER () + 1e-8)", 5) + f" AS {c}" for c in ("demand", "temperature_c", "wind_speed_kmh")
) + " FROM rides"))
def standardise(spark: SparkSession, folder: str) -> DataFrame:
    names = ["demand", "temperature_c", "wind_speed_kmh"]
    return pick(mo.standardise(rides(spark, folder), names), names, 5)
