"""Batch scoring of requests: validate, derive features, impute, align, predict, reuse."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zonecast import fixed_values as fv
from zonecast.operators.temporal import day_flags, fourier_columns

REQUEST_COLUMNS = [
    "zone", "hour", "day_of_week", "month", "weather", "temperature_c", "precipitation_mm", "is_event",
    "demand_lag_1h", "demand_lag_24h", "demand_lag_168h", "demand_roll24h_mean",
]
# What an absent optional field counts as.
REQUEST_DEFAULTS = {
    "precipitation_mm": 0.0, "demand_lag_1h": 10.0, "demand_lag_24h": 10.0, "demand_lag_168h": 10.0,
    "demand_roll24h_mean": 10.0,
}


def with_defaults(requests: DataFrame) -> DataFrame:
    filled = requests.fillna(REQUEST_DEFAULTS)
    return filled.withColumn("is_event", F.coalesce("is_event", F.lit(False)))


def validate(requests: DataFrame) -> DataFrame:
    """Add `errors`, the names of the fields that break a rule, and `valid`.

    A missing required field is an error too.
    """
    rules = {
        "zone": F.col("zone").isin(fv.ZONES),
        "hour": F.col("hour").between(0, 23),
        "day_of_week": F.col("day_of_week").between(0, 6),
        "month": F.col("month").between(1, 12),
        "weather": F.col("weather").isin(fv.WEATHER_KINDS),
        "temperature_c": F.col("temperature_c").between(-10, 45),
        **{c: F.col(c) >= 0 for c in REQUEST_DEFAULTS},
    }
    broken = [F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]
    checked = requests.withColumn("errors", F.array_compact(F.array(*broken)))
    return checked.withColumn("valid", F.size("errors") == 0)


def weather_code(weather: Column) -> Column:
    pairs = [part for code, kind in enumerate(fv.WEATHER_KINDS) for part in (F.lit(kind), F.lit(code).cast("long"))]
    return F.coalesce(F.create_map(*pairs)[weather], F.lit(0).cast("long"))


REQUEST_FEATURES = [
    "zone_encoded", "hour", "day_of_week", "month", "is_weekend", "is_rush_am", "is_rush_pm", "is_friday_night",
    "is_night", "weather_encoded", "temperature_c", "precipitation_mm", "is_event", "demand_lag_1h",
    "demand_lag_24h", "demand_lag_168h", "demand_roll24h_mean",
]


def to_features(requests: DataFrame) -> DataFrame:
    """Feature columns of valid requests, next to the request's `zone`."""
    added = requests.withColumns({
        "zone_encoded": F.col("zone").cast("long") - 1,
        "weather_encoded": weather_code(F.col("weather")),
        "is_event": F.col("is_event").cast("long"),
        **day_flags(F.col("hour"), F.col("day_of_week")),
    })
    kept = [c for c in requests.columns if c not in REQUEST_FEATURES and c not in ("weather", "errors", "valid")]
    return added.select(*kept, *REQUEST_FEATURES)


def impute(features: DataFrame) -> DataFrame:
    """Stand-ins for the features a request cannot carry, from its lags, mean, hour, day and month.

    The yearly phase counts month x 30 + hour as hours, as the online scorer does.
    """
    hour_ago, day_ago, week_ago = F.col("demand_lag_1h"), F.col("demand_lag_24h"), F.col("demand_lag_168h")
    mean, hour = F.col("demand_roll24h_mean"), F.col("hour")
    columns: dict[str, Column] = {
        "demand_lag_2h": hour_ago * 0.95,
        "demand_lag_3h": hour_ago * 0.9,
        "demand_lag_6h": day_ago * 1.05,
        "demand_lag_12h": day_ago,
        "demand_lag_48h": week_ago,
    }
    for n in fv.ROLLING_WINDOWS:
        columns[f"demand_roll{n}h_mean"] = mean
        for name, share in (("std", 0.15), ("max", 1.3), ("min", 0.7)):
            columns[f"demand_roll{n}h_{name}"] = mean * share
    for h, share in zip(fv.VELOCITY_HOURS, (1.0, 0.8, 0.6)):
        columns[f"demand_velocity_{h}h"] = (hour_ago - day_ago) * share
    phases = {"daily": hour, "weekly": F.col("day_of_week") * 24 + hour, "yearly": F.col("month") * 30 + hour}
    for name, spec in fv.FOURIER_PERIODS.items():
        columns.update(fourier_columns(phases[name], {name: spec}))
    columns["adj_zone_demand"] = mean * 0.9
    columns["demand_share"] = F.lit(0.05)
    columns["demand_rank"] = F.lit(10.0)
    return features.withColumns(columns)


def align(df: DataFrame, model_columns: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """The model's columns in the model's order as doubles; missing ones are 0."""
    columns = [
        (F.col(c).cast("double") if c in df.columns else F.lit(0.0)).alias(c) for c in model_columns
    ]
    return df.select(*keep, *columns)


def _digest(features: Sequence[str]) -> Column:
    return F.md5(F.to_json(F.struct(*[F.col(c) for c in sorted(features)])))


def request_key(features: Sequence[str] = REQUEST_FEATURES) -> Column:
    """First 12 hex digits of the md5 of the features as JSON with sorted names."""
    return F.substring(_digest(features), 1, 12)


def predict(df: DataFrame, score: Callable[[DataFrame], DataFrame], version: str) -> DataFrame:
    """Clamped prediction, interval 0.8x to 1.2x, and the model version; `score` adds `prediction`."""
    level = F.greatest(F.col("prediction"), F.lit(0.0))
    return score(df).withColumns({
        "predicted_demand": F.round(level, 2),
        "confidence_low": F.round(level * 0.8, 2),
        "confidence_high": F.round(level * 1.2, 2),
        "model_version": F.lit(version),
    })


def predict_with_reuse(features: DataFrame, score: Callable[[DataFrame], DataFrame], version: str) -> DataFrame:
    """Score each distinct request once and hand the result to all its repeats.

    Repeats are combined before the shuffle; the join back goes through the whole
    digest (12 digits would collide among very many requests), where the adaptive
    planner splits a request that is very frequent.
    """
    keyed = features.withColumns({"request_key": request_key(), "_digest": _digest(REQUEST_FEATURES)})
    distinct = keyed.groupBy("_digest").agg(*[F.first(c).alias(c) for c in REQUEST_FEATURES])
    answers = predict(distinct, score, version).select(
        "_digest", "predicted_demand", "confidence_low", "confidence_high", "model_version"
    )
    return keyed.join(answers, "_digest").drop("_digest")


def reuse_rate(features: DataFrame) -> DataFrame:
    """Share of requests that an earlier equal request could answer."""
    keyed = features.groupBy(_digest(REQUEST_FEATURES).alias("_digest")).agg(F.count(F.lit(1)).alias("n"))
    total, misses = F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))
    return keyed.agg((total - misses).alias("hits"), misses.alias("misses")).select(
        "hits", "misses", F.round(F.col("hits") / F.greatest(F.col("hits") + F.col("misses"), F.lit(1)), 4).alias("hit_rate")
    )
