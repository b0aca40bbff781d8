"""Queries on batch scoring of requests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from zonecast import fixed_values as fv
from zonecast.operators import modeling as mo
from zonecast.operators import scoring as sc
from zonecast.operators import temporal as tp
from zonecast.plans import sql as q
from zonecast.plans.features import KEYS
from zonecast.plans.registry import query, rides, rounded, tidy

# One request per panel row; some are spoilt by rule: zone 7 at 03:00, zone 9 at
# 05:00, zone 11 at 23:00, and every temperature above 45 after halving.
REQUESTS_SQL = q.RIDES + f""",
lagged AS (SELECT timestamp, zone AS panel_zone, hour(timestamp) AS h, isodow(timestamp) - 1 AS day_of_week, month(timestamp) AS month, weather AS w,
temperature_c / 2 AS temperature_c, precipitation_mm, is_event, CAST(lag(demand, 1) OVER ({q.BY_ZONE}) AS DOUBLE) AS demand_lag_1h,
CAST(lag(demand, 24) OVER ({q.BY_ZONE}) AS DOUBLE) AS demand_lag_24h, CAST(lag(demand, 168) OVER ({q.BY_ZONE}) AS DOUBLE) AS demand_lag_168h,
avg(demand) OVER ({q.BY_ZONE} ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING) AS demand_roll24h_mean FROM rides),
requests AS (SELECT timestamp, panel_zone, CASE WHEN h = 3 AND panel_zone = '7' THEN '99' ELSE panel_zone END AS zone,
CASE WHEN h = 23 AND panel_zone = '11' THEN 24 ELSE h END AS hour, day_of_week, month, CASE WHEN h = 5 AND panel_zone = '9' THEN 'tornado' ELSE w END AS weather,
temperature_c, precipitation_mm, is_event, coalesce(demand_lag_1h, 10.0) AS demand_lag_1h, coalesce(demand_lag_24h, 10.0) AS demand_lag_24h,
coalesce(demand_lag_168h, 10.0) AS demand_lag_168h, coalesce(demand_roll24h_mean, 10.0) AS demand_roll24h_mean FROM lagged),
valid AS (SELECT * FROM requests WHERE zone <> '99' AND hour < 24 AND weather <> 'tornado' AND temperature_c BETWEEN -10 AND 45)"""


def requests(spark: SparkSession, folder: str) -> DataFrame:
    from zonecast.operators.history import over_history

    def columns(w):
        return {
            **{f"demand_lag_{n}h": F.lag("demand", n).over(w).cast("double") for n in (1, 24, 168)},
            "demand_roll24h_mean": F.avg("demand").over(w.rowsBetween(-24, -1)),
        }

    panel = over_history(rides(spark, folder), columns, 168, dense=True)
    hour, zone = F.hour("timestamp"), F.col("zone")
    raw = panel.select(
        "timestamp", zone.alias("panel_zone"),
        F.when((hour == 3) & (zone == "7"), "99").otherwise(zone).alias("zone"),
        F.when((hour == 23) & (zone == "11"), 24).otherwise(hour).cast("bigint").alias("hour"),
        F.weekday("timestamp").cast("bigint").alias("day_of_week"), F.month("timestamp").cast("bigint").alias("month"),
        F.when((hour == 5) & (zone == "9"), "tornado").otherwise(F.col("weather")).alias("weather"),
        (F.col("temperature_c") / 2).alias("temperature_c"), "precipitation_mm", "is_event",
        *[c for c in sc.REQUEST_DEFAULTS if c.startswith("demand")],
    )
    return sc.with_defaults(raw)


def valid_features(spark: SparkSession, folder: str) -> DataFrame:
    return sc.to_features(sc.validate(requests(spark, folder)).where("valid"))


@query("request_validate", f"""WITH {REQUESTS_SQL} SELECT timestamp, panel_zone, array_to_string(list_filter([CASE WHEN zone = '99' THEN 'zone' END,
CASE WHEN hour = 24 THEN 'hour' END, CASE WHEN weather = 'tornado' THEN 'weather' END, CASE WHEN temperature_c > 45 THEN 'temperature_c' END],
lambda x: x IS NOT NULL), ',') AS errors, NOT (zone = '99' OR hour = 24 OR weather = 'tornado' OR temperature_c > 45) AS valid FROM requests""")
def request_validate(spark: SparkSession, folder: str) -> DataFrame:
    out = sc.validate(requests(spark, folder))
    return out.select("timestamp", "panel_zone", F.array_join("errors", ",").alias("errors"), "valid")


CODES = " ".join(f"WHEN '{w}' THEN {i}" for i, w in enumerate(fv.WEATHER_KINDS))
FEATURES = {
    "zone_encoded": "CAST(zone AS BIGINT) - 1", "hour": "hour", "day_of_week": "day_of_week", "month": "month",
    **q.day_flags("hour", "day_of_week"), "weather_encoded": f"CASE weather {CODES} END", "temperature_c": "temperature_c",
    "precipitation_mm": "precipitation_mm", "is_event": "CAST(is_event AS BIGINT)",
    **{c: c for c in ("demand_lag_1h", "demand_lag_24h", "demand_lag_168h", "demand_roll24h_mean")},
}
WHOLE = tuple(c for c in FEATURES if c not in ("temperature_c", "precipitation_mm") and not c.startswith("demand"))


def shown(df: DataFrame, names: list[str]) -> DataFrame:
    return df.select("timestamp", "panel_zone", *[F.col(n).cast("bigint").alias(n) if n in WHOLE else rounded(n).alias(n) for n in names])


@query("request_to_features", f"WITH {REQUESTS_SQL} SELECT timestamp, panel_zone, {q.columns(FEATURES, WHOLE)} FROM valid")
def request_to_features(spark: SparkSession, folder: str) -> DataFrame:
    return shown(valid_features(spark, folder), list(FEATURES))


MEAN, L1, L24 = "demand_roll24h_mean", "demand_lag_1h", "demand_lag_24h"
IMPUTED = {
    "demand_lag_2h": f"{L1} * 0.95::DOUBLE", "demand_lag_3h": f"{L1} * 0.9::DOUBLE", "demand_lag_6h": f"{L24} * 1.05::DOUBLE",
    "demand_lag_12h": L24, "demand_lag_48h": "demand_lag_168h",
    **{f"demand_roll{n}h_mean": MEAN for n in fv.ROLLING_WINDOWS},
    **{f"demand_roll{n}h_{k}": f"{MEAN} * {v}::DOUBLE" for n in fv.ROLLING_WINDOWS for k, v in (("std", 0.15), ("max", 1.3), ("min", 0.7))},
    **{f"demand_velocity_{h}h": f"({L1} - {L24}) * {v}::DOUBLE" for h, v in ((1, 1.0), (3, 0.8), (6, 0.6))},
    **q.fourier({"daily": "hour", "weekly": "day_of_week * 24 + hour", "yearly": "month * 30 + hour"}),
    "adj_zone_demand": f"{MEAN} * 0.9::DOUBLE", "demand_share": "0.05::DOUBLE", "demand_rank": "10.0::DOUBLE",
}


@query("request_impute", f"WITH {REQUESTS_SQL} SELECT timestamp, panel_zone, {q.columns(IMPUTED)} FROM valid")
def request_impute(spark: SparkSession, folder: str) -> DataFrame:
    return shown(sc.impute(valid_features(spark, folder)), list(IMPUTED))


MODEL_COLUMNS = ["demand_lag_24h", "hour", "poi_louvre", "demand_roll3h_max", "cluster_mid"]


@query("align_columns", f"""WITH {REQUESTS_SQL} SELECT timestamp, panel_zone, {q.r('demand_lag_24h')} AS demand_lag_24h, CAST(hour AS DOUBLE) AS hour,
0.0::DOUBLE AS poi_louvre, {q.r(IMPUTED['demand_roll3h_max'])} AS demand_roll3h_max, 0.0::DOUBLE AS cluster_mid FROM valid""")
def align_columns(spark: SparkSession, folder: str) -> DataFrame:
    return tidy(sc.align(sc.impute(valid_features(spark, folder)), MODEL_COLUMNS, ["timestamp", "panel_zone"]))


# Stands for a fitted model; a few requests get a negative score, which is clamped.
# The weights keep scores off exact rounding ties.
MODEL = mo.Formula(
    {"demand_lag_1h": 0.3017321, "demand_lag_24h": 0.5003717, "demand_roll24h_mean": 0.1511893, "hour": 0.0103147, "is_weekend": 0.2009431},
    -0.1507319,
)
MODEL_SQL = f"({MODEL.intercept}::DOUBLE + " + " + ".join(f"{w}::DOUBLE * {FEATURES[c]}" for c, w in MODEL.weights.items()) + ")"
ANSWER = f"""{q.r(f'greatest({MODEL_SQL}, 0.0)', 2)} AS predicted_demand, {q.r(f'greatest({MODEL_SQL}, 0.0) * 0.8', 2)} AS confidence_low,
{q.r(f'greatest({MODEL_SQL}, 0.0) * 1.2', 2)} AS confidence_high, 'formula-1' AS model_version"""


@query("predict_batch", f"WITH {REQUESTS_SQL} SELECT timestamp, panel_zone, {q.r(MODEL_SQL)} > 0 AS positive, {ANSWER} FROM valid")
def predict_batch(spark: SparkSession, folder: str) -> DataFrame:
    out = sc.predict(valid_features(spark, folder), MODEL, "formula-1")
    return out.select(
        "timestamp", "panel_zone", (rounded("prediction") > 0).alias("positive"),
        *[rounded(c, 2).alias(c) for c in ("predicted_demand", "confidence_low", "confidence_high")], "model_version",
    )


@query("clamp_nonnegative", f"WITH {REQUESTS_SQL} SELECT timestamp, panel_zone, {q.r(f'greatest({MODEL_SQL}, 0.0)', 12)} AS prediction FROM valid")
def clamp_nonnegative(spark: SparkSession, folder: str) -> DataFrame:
    scored = MODEL(valid_features(spark, folder))
    return scored.select("timestamp", "panel_zone", rounded(F.greatest("prediction", F.lit(0.0)), 12).alias("prediction"))


DISTINCT = ", ".join(FEATURES.values())


@query("request_key", f"WITH {REQUESTS_SQL} SELECT timestamp, panel_zone, count(*) OVER (PARTITION BY {DISTINCT}) AS n_equal FROM valid")
def request_key(spark: SparkSession, folder: str) -> DataFrame:
    """How many requests share each request's key (the key's text depends on the JSON writer)."""
    keyed = valid_features(spark, folder).withColumn("request_key", sc.request_key())
    sizes = keyed.groupBy("request_key").agg(F.count(F.lit(1)).alias("n_equal"))
    return keyed.join(sizes, "request_key").select("timestamp", "panel_zone", "n_equal")


@query("predict_with_reuse", f"WITH {REQUESTS_SQL} SELECT timestamp, panel_zone, {ANSWER} FROM valid")
def predict_with_reuse(spark: SparkSession, folder: str) -> DataFrame:
    out = sc.predict_with_reuse(valid_features(spark, folder), MODEL, "formula-1")
    return out.select(
        "timestamp", "panel_zone", *[rounded(c, 2).alias(c) for c in ("predicted_demand", "confidence_low", "confidence_high")], "model_version"
    )


@query("reuse_rate", f"""WITH {REQUESTS_SQL}, kinds AS (SELECT count(*) AS n FROM valid GROUP BY {DISTINCT})
SELECT CAST(sum(n) - count(*) AS BIGINT) AS hits, count(*) AS misses, {q.r('(sum(n) - count(*)) / sum(n)', 4)} AS hit_rate FROM kinds""")
def reuse_rate(spark: SparkSession, folder: str) -> DataFrame:
    return tidy(sc.reuse_rate(valid_features(spark, folder)), 4)
