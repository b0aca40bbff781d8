"""Time-ordered splits and cross-validation folds."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zonecast.operators.ordering import prefix_sums, row_positions


@dataclass
class Fold:
    """Half-open row ranges of one fold; `exists` is false when the fold does not fit."""

    train: list[tuple[Column, Column]]
    val: tuple[Column, Column]
    exists: Column


def row_index(df: DataFrame) -> DataFrame:
    """Add `row_id`, the 0-based position in (timestamp, zone) order."""
    return row_positions(df, "timestamp", ties=["zone"])


def time_index(df: DataFrame) -> DataFrame:
    """Add `row_id` counting distinct timestamps, for folds and gaps measured in time steps."""
    steps = df.select("timestamp").distinct().withColumn("_one", F.lit(1))
    order = prefix_sums(steps, "timestamp", ["_one"]).select("timestamp", F.col("_one_before").cast("long").alias("row_id"))
    return df.join(order, "timestamp")


def row_count(df: DataFrame) -> Column:
    return df.agg(F.count(F.lit(1)).alias("n")).scalar()


def step_count(df: DataFrame) -> Column:
    return df.agg(F.count_distinct("timestamp").alias("n")).scalar()


def _whole(numerator: Column, divisor: int) -> Column:
    return F.floor(numerator / divisor).cast("long")


def walk_forward(n: Column, folds: int = 5, gap: int = 24, val_size: int | None = None,
                 min_train: int | None = None) -> list[Fold]:
    """Expanding training range, then a gap, then the validation range.

    Fails at run time when `n` rows are too few.
    """
    val = F.greatest(F.lit(24), _whole(n, folds + 1)) if val_size is None else F.lit(val_size)
    least = val * 2 if min_train is None else F.lit(min_train)
    need = least + gap + val * folds
    message = F.concat(
        F.lit(f"{folds} walk-forward folds take "), need.cast("string"), F.lit(" rows or more; there are "), n.cast("string"),
    )
    spare = F.when(n < need, F.raise_error(message).cast("long")).otherwise(n - need)
    out = []
    for i in range(folds):
        end = least + _whole(spare * i, max(folds - 1, 1))
        out.append(Fold([(F.lit(0), end)], (end + gap, F.least(end + gap + val, n)), F.lit(True)))
    return out


def sliding(n: Column, folds: int = 5, train_size: int = 500, val_size: int = 100, gap: int = 24) -> list[Fold]:
    """Training range of fixed size moving forward; folds that would run past the end are left out."""
    step = _whole(n - train_size - gap - val_size, folds)
    out = []
    for i in range(folds):
        start = step * i
        first = start + train_size + gap
        out.append(Fold([(start, start + train_size)], (first, first + val_size), first + val_size <= n))
    return out


def purged(n: Column, folds: int = 5, purge: int = 24, embargo_share: float = 0.01) -> list[Fold]:
    """Blocks as validation; training on both sides, less the purge before and the embargo after."""
    size = _whole(n, folds)
    embargo = F.floor(size * F.lit(embargo_share)).cast("long")
    out = []
    for i in range(folds):
        start, end = size * i, size * (i + 1)
        train = [(F.lit(0), F.greatest(F.lit(0), start - purge)), (F.least(n, end + embargo), n)]
        out.append(Fold(train, (start, end), F.lit(True)))
    return out


def unshuffled_kfold(n: Column, folds: int = 5) -> list[Fold]:
    """Plain k-fold without shuffling: the first n mod k blocks hold one row more."""
    size, extra = _whole(n, folds), n % folds
    out = []
    for i in range(folds):
        start = size * i + F.least(F.lit(i), extra)
        end = size * (i + 1) + F.least(F.lit(i + 1), extra)
        out.append(Fold([(F.lit(0), start), (end, n)], (start, end), F.lit(True)))
    return out


Plan = Callable[[Column], list[Fold]]


def assign(df: DataFrame, plan: Plan, n: Column | None = None) -> DataFrame:
    """One output row per fold that uses the row, with `fold` (from 1) and `role` (train or val).

    `plan` gives the folds for n rows; n is the row count of `df` unless given.
    The bounds ride along as an array of at most one entry per fold and role, so
    no join is needed; unused entries are dropped before the rows are multiplied.
    """
    counted = df.withColumn("_n", row_count(df) if n is None else n)
    row = F.col("row_id")
    entries = []
    for i, fold in enumerate(plan(F.col("_n")), start=1):
        in_train = F.lit(False)
        for start, end in fold.train:
            in_train = in_train | ((row >= start) & (row < end))
        in_val = (row >= fold.val[0]) & (row < fold.val[1])
        for role, inside in (("train", in_train), ("val", in_val)):
            label = F.struct(F.lit(i).cast("long").alias("fold"), F.lit(role).alias("role"))
            entries.append(F.when(fold.exists & inside, label))
    spread = counted.withColumn("_use", F.explode(F.array_compact(F.array(*entries))))
    return spread.select(*df.columns, "_use.fold", "_use.role")


def fold_count(plan: Plan) -> int:
    return len(plan(F.lit(0).cast("long")))


def fold_sizes(assigned: DataFrame) -> DataFrame:
    return (
        assigned.groupBy("fold", "role")
        .agg(F.count(F.lit(1)).alias("n_rows"), F.min("row_id").alias("first_row"), F.max("row_id").alias("last_row"))
        .orderBy("fold", "role")
    )


def split_by_date(df: DataFrame, val_start: str, test_start: str) -> dict[str, DataFrame]:
    """Train before `val_start`, validation up to `test_start`, test from there on."""
    t = F.col("timestamp")
    first, second = (F.to_timestamp_ntz(F.lit(d)) for d in (val_start, test_start))
    return {
        "train": df.where(t < first),
        "val": df.where((t >= first) & (t < second)),
        "test": df.where(t >= second),
    }


def cut_timestamps(df: DataFrame, shares: tuple[float, float] = (0.70, 0.85)) -> tuple[Column, Column]:
    """First timestamps of the validation and of the test part.

    A timestamp belongs to a part by the position of its first row, so the rows
    of one timestamp always stay together.
    """
    counts = df.groupBy("timestamp").agg(F.count(F.lit(1)).alias("n"))
    placed = prefix_sums(counts, "timestamp", ["n"])

    def first_at(share: float) -> Column:
        reached = placed.where(F.col("n_before") >= F.floor(F.col("n_total") * F.lit(share)))
        return reached.agg(F.min("timestamp").alias("cut")).scalar()

    return first_at(shares[0]), first_at(shares[1])


def split_positional(df: DataFrame, shares: tuple[float, float] = (0.70, 0.85)) -> DataFrame:
    """Add `part`: train, val or test by position in time."""
    first, second = cut_timestamps(df, shares)
    t = F.col("timestamp")
    return df.withColumn("part", F.when(t < first, "train").when(t < second, "val").otherwise("test"))


def split_report(split: DataFrame) -> DataFrame:
    return split.groupBy("part").agg(
        F.count(F.lit(1)).alias("n_rows"), F.min("timestamp").alias("first_ts"), F.max("timestamp").alias("last_ts")
    )


def cv_summary(fold_metrics: DataFrame, columns: list[str]) -> DataFrame:
    """count, mean, std, min, quartiles and max of each fold metric, one row per statistic."""
    pairs = F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("v")) for c in columns])
    flat = fold_metrics.select(F.explode(pairs).alias("_p")).select("_p.metric", "_p.v")
    # A handful of folds, so the exact built-in percentile is enough here.
    stats = flat.groupBy("metric").agg(
        F.count("v").cast("double").alias("count"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"),
        F.min("v").alias("min"), F.percentile("v", F.lit(0.25)).alias("p25"), F.percentile("v", F.lit(0.5)).alias("p50"),
        F.percentile("v", F.lit(0.75)).alias("p75"), F.max("v").alias("max"),
    )
    return stats.select("metric", *[F.round(c, 4).alias(c) for c in stats.columns if c != "metric"])
