"""Column expressions for forecast errors, prices and surge."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from zonecast import fixed_values as fv


def pinball(y: Column, p: Column, quantile: float = 0.9) -> Column:
    error = y - p
    return F.greatest(quantile * error, (quantile - 1) * error)


def winkler(y: Column, low: Column, high: Column, alpha: float = 0.1) -> Column:
    missed = F.when(y < low, low - y).when(y > high, y - high).otherwise(0.0)
    return (high - low) + (2.0 / alpha) * missed


def relative_error(y: Column, p: Column, eps: float = 1.0) -> Column:
    return F.abs((y - p) / (F.abs(y) + eps))


def error_aggregates(y: str, p: str, prefix: str = "", places: int = 4) -> list[Column]:
    """RMSE, MAPE, MAE, R2, pinball at 0.9 and largest error, rounded."""
    actual, predicted = F.col(y).cast("double"), F.col(p).cast("double")
    error = actual - predicted
    spread = F.count(error) * F.var_pop(actual)
    named = {
        "rmse": F.sqrt(F.avg(error * error)),
        "mape": F.avg(relative_error(actual, predicted)),
        "mae": F.avg(F.abs(error)),
        "r2": 1 - F.sum(error * error) / (spread + 1e-9),
        "pinball_90": F.avg(pinball(actual, predicted)),
        "max_error": F.max(F.abs(error)),
    }
    start = f"{prefix}_" if prefix else ""
    return [F.round(c, places).alias(start + name) for name, c in named.items()]


def demand_ratio(demand: Column, baseline: Column) -> Column:
    return demand / (baseline + 1e-3)


def surge(demand: Column, baseline: Column) -> Column:
    """Surge multiplier of the highest step that demand / baseline reaches, else 1."""
    ratio = demand_ratio(demand, baseline)
    (least, low), *higher = reversed(fv.SURGE_STEPS)
    step = F.when(ratio >= least, low)
    for threshold, multiplier in higher:
        step = step.when(ratio >= threshold, multiplier)
    return step.otherwise(1.0)


def hash_percent(text: Column) -> Column:
    """Stable bucket 0-99 of a text."""
    return (F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long") % 100).cast("long")


def drift_status(psi: Column, threshold: float = 0.2) -> Column:
    return F.when(psi < 0.1, "stable").when(psi < threshold, "warn").otherwise("drift")
