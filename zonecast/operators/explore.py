"""Exploratory summaries of the panel and of the feature table."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from zonecast.operators.drift import long_values
from zonecast.operators.history import over_history
from zonecast.operators.ordering import quantiles


def dataset_summary(df: DataFrame) -> DataFrame:
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_distinct("zone").alias("n_zones"),
        F.to_date(F.min("timestamp")).alias("first_day"), F.to_date(F.max("timestamp")).alias("last_day"),
    )


def describe(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """count, mean, std, min, quartiles, max per column, rounded to 2 places."""
    rows = long_values(df, columns)
    plain = rows.groupBy("feature").agg(
        F.count("value").alias("count"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"), F.max("value").alias("max"),
    )
    q = quantiles(rows, "value", [0.25, 0.5, 0.75], ["feature"], "q").drop("n")
    out = plain.join(q, "feature")
    return out.select(
        "feature", "count", F.round("mean", 2).alias("mean"), F.round("std", 2).alias("std"),
        F.round("min", 2).alias("min"),
        *[F.round(F.get("q", F.lit(i)), 2).alias(n) for i, n in enumerate(("p25", "p50", "p75"))],
        F.round("max", 2).alias("max"),
    )


def heatmap(df: DataFrame, target: str = "demand") -> DataFrame:
    """Mean target, one row per day of week (Monday = 0), one column per hour."""
    with_parts = df.select(
        F.weekday("timestamp").cast("long").alias("day_of_week"), F.hour("timestamp").alias("hour"), target
    )
    wide = with_parts.groupBy("day_of_week").pivot("hour", list(range(24))).agg(F.avg(target))
    return wide.select("day_of_week", *[F.col(str(h)).alias(f"h{h:02d}") for h in range(24)]).orderBy("day_of_week")


def zone_profile(df: DataFrame, target: str = "demand") -> DataFrame:
    return (
        df.groupBy("zone")
        .agg(
            F.round(F.avg(target), 2).alias("mean"), F.round(F.stddev_samp(target), 2).alias("std"),
            F.max(target).alias("max"),
        )
        .orderBy(F.desc("mean"), "zone")
    )


def weather_profile(df: DataFrame, target: str = "demand") -> DataFrame:
    plain = df.groupBy("weather").agg(F.round(F.avg(target), 2).alias("mean"), F.count(target).alias("count"))
    middle = quantiles(df, target, [0.5], ["weather"], "q").select("weather", F.round(F.get("q", F.lit(0)), 2).alias("median"))
    return plain.join(middle, "weather").select("weather", "mean", "median", "count").orderBy(F.desc("mean"), "weather")


def daily_total(df: DataFrame, target: str = "demand") -> DataFrame:
    return df.groupBy(F.to_date("timestamp").alias("day")).agg(F.sum(target).alias("demand"))


def moving_average(daily: DataFrame, days: int = 7) -> DataFrame:
    """Centred mean over `days` rows of the daily totals; null where fewer rows are there."""
    half = days // 2

    def columns(w: WindowSpec) -> dict[str, Column]:
        around = w.rowsBetween(-half, half)
        return {"moving_average": F.when(F.count("demand").over(around) == days, F.avg("demand").over(around))}

    return over_history(daily, columns, back=half, forward=half, keys=(), order="day")


def event_lift(df: DataFrame, target: str = "demand") -> DataFrame:
    on, off = F.when(F.col("is_event"), F.col(target)), F.when(~F.col("is_event"), F.col(target))
    out = df.agg(
        F.count(on).alias("n_event"), F.count(off).alias("n_other"),
        F.avg(on).alias("mean_event"), F.avg(off).alias("mean_other"),
    )
    return out.withColumn("lift", F.try_divide("mean_event", "mean_other"))


def histogram(df: DataFrame, value: Column, bins: int = 50) -> DataFrame:
    """Counts in equal-width bins between the smallest and the largest value; empty bins stay with 0."""
    rows = df.select(value.cast("double").alias("x")).where("x is not null")
    low = rows.agg(F.min("x").alias("v")).scalar()
    high = rows.agg(F.max("x").alias("v")).scalar()
    ranged = rows.withColumns({"_low": low, "_high": high})
    # A single value spans half a unit to both sides.
    flat = F.col("_low") == F.col("_high")
    start = F.when(flat, F.col("_low") - 0.5).otherwise(F.col("_low"))
    width = F.when(flat, F.lit(1.0)).otherwise(F.col("_high") - F.col("_low"))
    place = F.least(F.floor((F.col("x") - start) / width * bins), F.lit(bins - 1)).cast("long")
    counts = ranged.groupBy(place.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    every = df.sparkSession.range(bins).withColumnRenamed("id", "bin")
    out = every.join(counts, "bin", "left").withColumns({"_low": low, "_high": high})
    return out.select(
        "bin", (start + F.col("bin") * width / bins).alias("left_edge"),
        (start + (F.col("bin") + 1) * width / bins).alias("right_edge"), F.coalesce("n", F.lit(0)).alias("n"),
    )


def adjusted_skewness(df: DataFrame, values: dict[str, Column]) -> DataFrame:
    """Bias-adjusted skewness: the population form times sqrt(n (n - 1)) / (n - 2)."""
    out = []
    for name, value in values.items():
        n = F.count(value).cast("double")
        out.append((F.skewness(value) * F.sqrt(n * (n - 1)) / (n - 2)).alias(name))
    return df.agg(*out)


def target_correlation(df: DataFrame, features: Sequence[str], target: str = "demand") -> DataFrame:
    """Absolute Pearson correlation of each feature with the target, strongest first; null for a constant feature."""
    y = F.col(target).cast("double")

    def strength(f: str) -> Column:
        # Only rows that have both.
        x = F.when(y.isNotNull(), F.col(f).cast("double"))
        own = F.when(F.col(f).isNotNull(), y)
        return F.when(F.min(x) < F.max(x), F.abs(F.try_divide(F.covar_pop(x, own), F.stddev_pop(x) * F.stddev_pop(own))))

    one_row = df.agg(*[strength(f).alias(f) for f in features])
    pairs = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).alias("abs_corr")) for f in features])
    return one_row.select(F.explode(pairs).alias("_p")).select("_p.feature", "_p.abs_corr").orderBy(
        F.desc_nulls_last("abs_corr"), "feature"
    )


def correlation_matrix(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Pearson correlation of every pair of features, from one pass over the rows."""
    names = [(a, b) for i, a in enumerate(features) for b in features[i:]]
    one_row = df.agg(*[F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"{a}|{b}") for a, b in names])
    cells = []
    for a, b in names:
        cells.append(F.struct(F.lit(a).alias("row"), F.lit(b).alias("col"), F.col(f"`{a}|{b}`").alias("corr")))
        if a != b:
            cells.append(F.struct(F.lit(b).alias("row"), F.lit(a).alias("col"), F.col(f"`{a}|{b}`").alias("corr")))
    return one_row.select(F.explode(F.array(*cells)).alias("_c")).select("_c.*")


def autocorrelation(df: DataFrame, lags: int = 48, target: str = "demand", dense: bool = False) -> DataFrame:
    """Autocorrelation per zone for lags 0 to `lags`: (zone, lag, acf).

    Uses the mean and variance of the whole series. The centred products are
    rebuilt from plain sums, so one pass over the lagged rows is enough.
    """
    x = F.col(target).cast("double")

    def columns(w: WindowSpec) -> dict[str, Column]:
        return {f"_x{k}": F.lag(x, k).over(w) for k in range(1, lags + 1)}

    lagged = over_history(df.select("zone", "timestamp", target), columns, back=lags, dense=dense)
    x_text = f"CAST({target} AS DOUBLE)"
    sums = [F.expr(f"count({x_text}) AS n"), F.expr(f"sum({x_text}) AS s"), F.expr(f"sum({x_text} * {x_text}) AS ss")]
    for k in range(1, lags + 1):
        sums += [
            F.expr(f"sum({x_text} * _x{k}) AS xy{k}"), F.expr(f"count(_x{k}) AS n{k}"), F.expr(f"sum(_x{k}) AS b{k}"),
            F.expr(f"sum(CASE WHEN _x{k} IS NOT NULL THEN {x_text} END) AS a{k}"),
        ]
    per_zone = lagged.groupBy("zone").agg(*sums).withColumn("mean", F.expr("s / n"))
    spread = "(ss - n * mean * mean)"
    # A constant series has no autocorrelation, not even at lag 0.
    points = [f"named_struct('lag', 0L, 'acf', try_divide({spread}, {spread}))"]
    for k in range(1, lags + 1):
        cross = f"xy{k} - mean * (a{k} + b{k}) + n{k} * mean * mean"
        points.append(f"named_struct('lag', {k}L, 'acf', try_divide({cross}, {spread}))")
    return per_zone.select("zone", F.expr(f"inline(array({', '.join(points)}))"))


def partial_autocorrelation(acf: DataFrame) -> DataFrame:
    """Partial autocorrelation per zone, from its autocorrelations (a few dozen rows per zone)."""

    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        ordered = rows.sort_values("lag")
        r = ordered["acf"].to_numpy(dtype=float)
        partial = [1.0]
        weights: list[float] = []
        left = 1.0
        for k in range(1, len(r)):
            reached = sum(w * r[k - 1 - j] for j, w in enumerate(weights))
            phi = (r[k] - reached) / left if left > 0 else float("nan")
            weights = [w - phi * weights[k - 2 - j] for j, w in enumerate(weights)] + [phi]
            left *= 1 - phi * phi
            partial.append(phi)
        return pd.DataFrame({"zone": ordered["zone"].to_numpy(), "lag": ordered["lag"].to_numpy(), "pacf": partial})

    return acf.groupBy("zone").applyInPandas(solve, "zone string, lag bigint, pacf double")


FEATURE_GROUPS = {
    "Lag": ("lag",),
    "Rolling": ("roll",),
    "Fourier": ("fourier",),
    "Geo": ("zone", "poi", "adj", "cluster", "demand_share"),
}
NAMED_GROUPS = {
    "Calendar": (
        "hour", "day_of_week", "month", "is_weekend", "is_rush_am", "is_rush_pm", "is_night", "is_holiday",
        "is_friday_night",
    ),
    "Context": ("temperature_c", "precipitation_mm", "wind_speed_kmh", "weather_encoded"),
}


def feature_groups(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Number of features per group; a name may belong to several groups or to none.

    Each feature name is taken with its count of non-null rows, so the table also
    says how much of the data the group covers.
    """
    filled = df.agg(*[F.count(f).alias(f) for f in features])
    pairs = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).alias("filled")) for f in features])
    names = filled.select(F.explode(pairs).alias("_p")).select("_p.*")
    labels = []
    for group, parts in FEATURE_GROUPS.items():
        labels.append(F.when(F.col("feature").rlike("|".join(parts)), group))
    for group, exact in NAMED_GROUPS.items():
        labels.append(F.when(F.col("feature").isin(*exact), group))
    spread = names.select(F.explode(F.array_compact(F.array(*labels))).alias("feature_group"), "filled")
    return spread.groupBy("feature_group").agg(
        F.count(F.lit(1)).alias("n_features"), F.sum("filled").alias("n_values")
    )
