"""Zone baselines, surge pricing and the pricing A/B test."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zonecast import fixed_values as fv
from zonecast.functions import measures as ms
from zonecast.operators.ordering import median


def zone_baseline(df: DataFrame, target: str = "demand") -> DataFrame:
    """Exact median of the target per zone."""
    return median(df, target, ["zone"], "baseline")


def with_baseline(df: DataFrame, baselines: DataFrame, default: float = fv.DEFAULT_BASELINE) -> DataFrame:
    """Attach each zone's baseline; unknown zones get the default.

    One row per zone on the right: the planner broadcasts it when it is small
    enough by its own measure and shuffles it otherwise.
    """
    return df.join(baselines, "zone", "left").withColumn("baseline", F.coalesce("baseline", F.lit(default)))


def price(df: DataFrame, demand: str, base_price: float = fv.BASE_PRICE) -> DataFrame:
    """Surge multiplier, final price and demand ratio from `demand` and `baseline`."""
    multiplier = ms.surge(F.col(demand), F.col("baseline"))
    return df.withColumns({
        "base_price": F.lit(base_price),
        "surge_multiplier": F.round(multiplier, 2),
        "final_price": F.round(F.lit(base_price) * multiplier, 2),
        "demand_ratio": F.round(ms.demand_ratio(F.col(demand), F.col("baseline")), 3),
    })


def ab_route(df: DataFrame, demand: str, baseline_a: Column, baseline_b: Column, split: float = 0.5,
             base_price: float = fv.BASE_PRICE) -> DataFrame:
    """Variant by a stable hash of the zone, then that variant's price."""
    to_a = ms.hash_percent(F.col("zone")) < split * 100
    routed = df.withColumn("variant", F.when(to_a, "A").otherwise("B")).withColumn(
        "baseline", F.when(to_a, baseline_a).otherwise(baseline_b)
    )
    return price(routed, demand, base_price)


def ab_summary(routed: DataFrame) -> DataFrame:
    return (
        routed.groupBy("variant")
        .agg(
            F.count(F.lit(1)).alias("n_requests"),
            F.round(F.avg("final_price"), 2).alias("mean_price"),
            F.round(F.avg("surge_multiplier"), 2).alias("mean_surge"),
            F.round(F.avg((F.col("surge_multiplier") > 1).cast("double")), 3).alias("pct_surged"),
        )
        .orderBy("variant")
    )


def expected_demand(df: DataFrame, base: Column, boost: Column) -> DataFrame:
    """Base x hour x day x weather x event factor."""

    def lookup(values: list[float], index: Column) -> Column:
        return F.get(F.array(*[F.lit(v) for v in values]), index)

    weather = F.create_map(*[F.lit(part) for pair in fv.WEATHER_FACTORS.items() for part in pair])
    t = F.col("timestamp")
    product = (
        base * lookup(fv.HOUR_FACTORS, F.hour(t)) * lookup(fv.DAY_FACTORS, F.weekday(t)) * weather[F.col("weather")] * boost
    )
    return df.withColumn("expected_demand", product)


def hourly_profile(df: DataFrame, day_ago: str = "demand_lag_24h", scale: float = fv.DEFAULT_BASELINE) -> DataFrame:
    """24 rows per input row: day-ago demand x weather factor x hour factor, with its price band."""
    weather = F.create_map(*[F.lit(part) for pair in fv.PROFILE_WEATHER_FACTORS.items() for part in pair])
    factor = F.coalesce(weather[F.col("weather")], F.lit(1.0))
    out = df.select("*", F.posexplode(F.array(*[F.lit(v) for v in fv.HOUR_FACTORS])).alias("profile_hour", "_factor"))
    level = F.col(day_ago) * factor * F.col("_factor")
    band = F.when(level / scale >= 2.0, "high").when(level / scale >= 1.5, "raised").otherwise("normal")
    return out.withColumn("profile_demand", level).withColumn("band", band).drop("_factor")
