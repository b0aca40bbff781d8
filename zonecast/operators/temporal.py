"""Calendar, Fourier, lag, rolling and velocity features."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from zonecast import fixed_values as fv
from zonecast.operators.history import over_history

CALENDAR_COLUMNS = [
    "hour", "day_of_week", "day_of_month", "month", "week_of_year", "is_weekend", "is_friday_night",
    "is_rush_am", "is_rush_pm", "is_night", "quarter", "is_holiday",
]


def day_flags(hour: Column, day: Column) -> dict[str, Column]:
    """0/1 flags from the hour and the day of the week (Monday = 0)."""
    workday = day < 5
    return {
        "is_weekend": (~workday).cast("long"),
        "is_friday_night": ((day == 4) & (hour >= 20)).cast("long"),
        "is_rush_am": (workday & hour.between(7, 9)).cast("long"),
        "is_rush_pm": (workday & hour.between(17, 19)).cast("long"),
        "is_night": hour.between(0, 5).cast("long"),
    }


def add_calendar(df: DataFrame, ts: str = "timestamp") -> DataFrame:
    t = F.col(ts)
    hour, day = F.hour(t), F.weekday(t)
    parts = {
        "hour": hour, "day_of_week": day, "day_of_month": F.dayofmonth(t), "month": F.month(t),
        "week_of_year": F.weekofyear(t), "quarter": F.quarter(t),
    }
    holiday = (F.month(t) * 100 + F.dayofmonth(t)).isin(fv.HOLIDAYS)
    columns = {**{k: v.cast("long") for k, v in parts.items()}, **day_flags(hour, day), "is_holiday": holiday.cast("long")}
    return df.withColumns({c: columns[c] for c in CALENDAR_COLUMNS})


def fourier_columns(hours: Column, periods: dict[str, tuple[float, int]]) -> dict[str, Column]:
    """sin and cos of 2 pi k t / period for each period and harmonic."""
    out = {}
    for name, (period, harmonics) in periods.items():
        for k in range(1, harmonics + 1):
            angle = F.lit(2.0) * F.pi() * k * hours / F.lit(float(period))
            out[f"fourier_{name}_sin_{k}"] = F.sin(angle)
            out[f"fourier_{name}_cos_{k}"] = F.cos(angle)
    return out


def add_fourier(df: DataFrame, ts: str = "timestamp", periods: dict[str, tuple[float, int]] | None = None,
                origin: Column | None = None) -> DataFrame:
    """Fourier terms of the hours since the first timestamp (or since `origin`)."""
    start = df.agg(F.min(ts).alias("origin")).scalar() if origin is None else origin
    with_t = df.withColumn("_hours", F.timestamp_diff("SECOND", start, F.col(ts)) / 3600)
    return with_t.withColumns(fourier_columns(F.col("_hours"), periods or fv.FOURIER_PERIODS)).drop("_hours")


def lag_columns(w: WindowSpec, target: str, lags: Sequence[int]) -> dict[str, Column]:
    return {f"{target}_lag_{n}h": F.lag(target, n).over(w) for n in lags}


def rolling_columns(w: WindowSpec, target: str, windows: Sequence[int]) -> dict[str, Column]:
    """Mean, sample deviation (0 when undefined), max, min over the n rows before the current one."""
    out = {}
    for n in windows:
        frame = w.rowsBetween(-n, -1)
        prefix = f"{target}_roll{n}h"
        out[f"{prefix}_mean"] = F.avg(target).over(frame)
        out[f"{prefix}_std"] = F.coalesce(F.stddev_samp(target).over(frame), F.lit(0.0))
        out[f"{prefix}_max"] = F.max(target).over(frame)
        out[f"{prefix}_min"] = F.min(target).over(frame)
    return out


def velocity_columns(w: WindowSpec, target: str, hours: Sequence[int] = fv.VELOCITY_HOURS,
                     lagged: bool = False) -> dict[str, Column]:
    """(x - x h rows ago) / h. With `lagged`, x is the previous row's value, so the target is not used."""
    now = F.lag(target, 1).over(w) if lagged else F.col(target)
    shift = 1 if lagged else 0
    return {f"{target}_velocity_{h}h": (now - F.lag(target, h + shift).over(w)) / h for h in hours}


def add_lags(df: DataFrame, target: str = "demand", lags: Sequence[int] = fv.LAGS,
             keys: Sequence[str] = ("zone",), dense: bool = False) -> DataFrame:
    return over_history(df, lambda w: lag_columns(w, target, lags), max(lags), keys=keys, dense=dense)


def add_rolling(df: DataFrame, target: str = "demand", windows: Sequence[int] = fv.ROLLING_WINDOWS,
                keys: Sequence[str] = ("zone",), dense: bool = False) -> DataFrame:
    return over_history(df, lambda w: rolling_columns(w, target, windows), max(windows), keys=keys, dense=dense)


def add_velocity(df: DataFrame, target: str = "demand", keys: Sequence[str] = ("zone",), dense: bool = False,
                 lagged: bool = False) -> DataFrame:
    return over_history(
        df, lambda w: velocity_columns(w, target, lagged=lagged), max(fv.VELOCITY_HOURS) + 1, keys=keys, dense=dense
    )


def add_temporal(df: DataFrame, target: str = "demand", lags: Sequence[int] = fv.LAGS,
                 windows: Sequence[int] = fv.ROLLING_WINDOWS, dense: bool = False, lagged: bool = False,
                 origin: Column | None = None) -> DataFrame:
    """All temporal features; lag, rolling and velocity columns share one shuffle and one sort."""

    def columns(w: WindowSpec) -> dict[str, Column]:
        return {
            **lag_columns(w, target, lags),
            **rolling_columns(w, target, windows),
            **velocity_columns(w, target, lagged=lagged),
        }

    back = max([*lags, *windows, max(fv.VELOCITY_HOURS) + 1])
    with_history = over_history(df, columns, back, dense=dense)
    return add_fourier(add_calendar(with_history), origin=origin)


def sequences(df: DataFrame, features: Sequence[str], label: str, length: int, keys: Sequence[str] = ("zone",),
              order: str = "timestamp", dense: bool = False, pad: bool = False) -> DataFrame:
    """The `length` feature rows before each row as `sequence`, with `label`.

    Rows with a shorter history are left out; with `pad` they are kept and get a
    null sequence (their prediction is 0).
    """
    row = F.array(*[F.col(f).cast("double") for f in features])

    def columns(w: WindowSpec) -> dict[str, Column]:
        return {"sequence": F.collect_list(row).over(w.rowsBetween(-length, -1))}

    out = over_history(df, columns, length, keys=keys, order=order, dense=dense)
    full = F.size("sequence") == length
    out = out.withColumn("sequence", F.when(full, F.col("sequence"))) if pad else out.where(full)
    return out.select(*keys, order, "sequence", label)
