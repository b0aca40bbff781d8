"""Forecast evaluation: metrics, intervals, revenue backtest, leaderboard."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from zonecast import fixed_values as fv
from zonecast.functions import measures as ms
from zonecast.operators.pricing import with_baseline, zone_baseline


def metrics(df: DataFrame, y: str = "demand", p: str = "pred", prefix: str = "", places: int = 4) -> DataFrame:
    return df.agg(*ms.error_aggregates(y, p, prefix, places))


def metrics_by(df: DataFrame, keys: Sequence[str], y: str = "demand", p: str = "pred",
               places: int = 4) -> DataFrame:
    """All metrics and the sample count per key, worst MAPE first."""
    return (
        df.groupBy(*keys)
        .agg(*ms.error_aggregates(y, p, places=places), F.count(F.lit(1)).alias("n_samples"))
        .orderBy(F.desc("mape"), *keys)
    )


def pinball_loss(df: DataFrame, quantile: float, y: str = "demand", p: str = "pred") -> DataFrame:
    return df.agg(F.avg(ms.pinball(F.col(y), F.col(p), quantile)).alias("pinball"))


def winkler_score(df: DataFrame, low: str, high: str, alpha: float = 0.1, y: str = "demand") -> DataFrame:
    return df.agg(F.avg(ms.winkler(F.col(y), F.col(low), F.col(high), alpha)).alias("winkler"))


def revenue_backtest(df: DataFrame, y: str = "demand", p: str = "pred") -> DataFrame:
    """Revenue under prices from actual and from predicted demand.

    Riders are the actual ones in both cases, so an over-prediction can push the
    efficiency above 1.
    """
    priced = with_baseline(df, zone_baseline(df, y))
    rows = priced.select(
        F.col(y).alias("riders"),
        ms.surge(F.col(y), F.col("baseline")).alias("surge_actual"),
        ms.surge(F.greatest(F.col(p), F.lit(0.0)), F.col("baseline")).alias("surge_pred"),
    )
    perfect = F.sum(F.col("riders") * fv.BASE_PRICE * F.col("surge_actual"))
    model = F.sum(F.col("riders") * fv.BASE_PRICE * F.col("surge_pred"))
    totals = rows.agg(
        perfect.alias("perfect"), model.alias("model"),
        F.avg("surge_actual").alias("a"), F.avg("surge_pred").alias("p"),
    )
    return totals.select(
        F.round("perfect", 2).alias("total_revenue_perfect_eur"),
        F.round("model", 2).alias("total_revenue_model_eur"),
        F.round(F.try_divide("model", "perfect"), 4).alias("revenue_efficiency"),
        F.round(F.col("perfect") - F.col("model"), 2).alias("revenue_loss_eur"),
        F.round("a", 3).alias("mean_surge_actual"),
        F.round("p", 3).alias("mean_surge_pred"),
    )


LOWER_IS_BETTER = ["mape", "rmse", "mae"]
RANKED_METRICS = ["mape", "rmse", "mae", "r2", "pinball_90"]


def leaderboard(scores: DataFrame) -> DataFrame:
    """Rank models by MAPE and mark each metric `best`, `close` (within 5 %) or blank.

    `scores` has one row per model. Only mape, rmse and mae can be `close`; r2 is
    best at its maximum, every other metric at its minimum.
    """
    everyone = Window.partitionBy(F.lit(0))
    out = scores.withColumn("rank", F.row_number().over(everyone.orderBy("mape", "model")).cast("long"))
    for m in RANKED_METRICS:
        best = (F.max(m) if m == "r2" else F.min(m)).over(everyone)
        mark = F.when(F.col(m) == best, "best")
        if m in LOWER_IS_BETTER:
            mark = mark.when(F.col(m) <= best * 1.05, "close")
        out = out.withColumn(f"{m}_mark", mark.otherwise(""))
    return out.orderBy("rank")


def best_model(scores: DataFrame) -> DataFrame:
    return scores.agg(F.min_by("model", "mape").alias("model"), F.min("mape").alias("mape"))


def champion_gate(champion: DataFrame, challengers: DataFrame, least_gain: float = 0.01) -> DataFrame:
    """Promote the best challenger when it lowers the champion's MAPE by more than `least_gain`,
    or when there is no champion. Both inputs have columns model and mape."""
    best = best_model(challengers).select(F.col("model").alias("challenger"), F.col("mape").alias("new_mape"))
    old = champion.agg(F.min("mape").alias("m")).scalar()
    gain = (F.col("champion_mape") - F.col("new_mape")) / F.col("champion_mape")
    with_old = best.withColumn("champion_mape", old).withColumn("improvement", gain)
    has_new = F.col("new_mape").isNotNull()
    return with_old.withColumn(
        "promote", F.when(F.col("champion_mape").isNull(), True).otherwise(has_new & (F.col("improvement") > least_gain))
    )
