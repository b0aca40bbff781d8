"""Exact ordered computations that never put one whole group into one task.

A plain `Window.partitionBy(key).orderBy(x)` sends every row of a key to one
task. The functions here first cut each key's value range into many buckets of
about equal size (from an approximate sketch), sum per bucket, and then sort
only inside a bucket. The sketch decides where the cuts lie, never the result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = 1024


def bucket_text(value: str, cuts: str, buckets: int = BUCKETS) -> str:
    """SQL for the number of entries of the sorted array `cuts` below `value`, by binary search."""
    steps = []
    size = 1
    while size < buckets:
        steps.insert(0, str(size))
        size *= 2
    found = f"i + s - 1 < size({cuts}) AND get({cuts}, i + s - 1) < {value}"
    return f"aggregate(array({', '.join(steps)}), 0, (i, s) -> i + CASE WHEN {found} THEN s ELSE 0 END)"


def bucket_of(value: str, cuts: str, buckets: int = BUCKETS) -> Column:
    return F.expr(bucket_text(value, cuts, buckets))


def _cut_points(value: str, buckets: int) -> Column:
    shares = ",".join(f"{i / buckets!r}D" for i in range(1, buckets))
    return F.expr(f"percentile_approx(`{value}`, array({shares}), {10 * buckets})")


def prefix_sums(
    df: DataFrame, value: str, measures: Sequence[str], keys: Sequence[str] = (), buckets: int = BUCKETS
) -> DataFrame:
    """Add `<m>_before` and `<m>_total` for each measure.

    `df` holds one row per (keys, value). `<m>_before` sums the measure over the
    smaller values with the same keys, `<m>_total` over all of them. Rows without
    a value or a key are left out; stating that first makes all readers of `df`
    below alike, so its shuffle is made once and reused.
    """
    keys = list(keys)
    df = df.where(" AND ".join(f"`{c}` IS NOT NULL" for c in [*keys, value]))
    if keys:
        cuts = df.groupBy(*keys).agg(_cut_points(value, buckets).alias("_cuts"))
        placed = df.join(cuts, keys)
    else:
        placed = df.withColumn("_cuts", df.agg(_cut_points(value, buckets).alias("_cuts")).scalar())
    placed = placed.withColumn("_bucket", bucket_of(f"`{value}`", "_cuts", buckets)).drop("_cuts")

    # At most `buckets` rows per key.
    per_key = Window.partitionBy(*(keys or [F.lit(0)]))
    earlier = per_key.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = placed.groupBy(*keys, "_bucket").agg(*[F.sum(m).alias(m) for m in measures])
    offsets = sums.select(
        *keys,
        "_bucket",
        *[F.coalesce(F.sum(m).over(earlier), F.lit(0)).alias(f"_{m}_offset") for m in measures],
        *[F.sum(m).over(per_key).alias(f"{m}_total") for m in measures],
    )
    inside = Window.partitionBy(*keys, "_bucket").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    joined = placed.join(offsets, [*keys, "_bucket"])
    for m in measures:
        joined = joined.withColumn(
            f"{m}_before", F.col(f"_{m}_offset") + F.coalesce(F.sum(m).over(inside), F.lit(0))
        )
    return joined.drop("_bucket", *[f"_{m}_offset" for m in measures])


def value_counts(df: DataFrame, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """Rows per (keys, value), nulls and NaN dropped; combines before the shuffle."""
    kept = df.where(F.col(value).isNotNull())
    if dict(df.dtypes)[value] in ("double", "float"):
        kept = kept.where(~F.isnan(value))
    return kept.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))


def quantiles(
    df: DataFrame, value: str, shares: Sequence[float], keys: Sequence[str] = (), name: str = "quantiles",
    buckets: int = BUCKETS,
) -> DataFrame:
    """Exact linear-interpolated quantiles: one row per key with an array column `name`.

    Also returns `n`, the number of values. A quantile at share p sits at
    position p * (n - 1) of the sorted values.
    """
    return quantiles_of_counts(value_counts(df, value, keys), value, shares, keys, name, buckets)


def quantiles_of_counts(
    counts: DataFrame, value: str, shares: Sequence[float], keys: Sequence[str] = (), name: str = "quantiles", buckets: int = BUCKETS,
) -> DataFrame:
    """The same from one row per (keys, value) with the number of rows `n`."""
    keys = list(keys)
    placed = prefix_sums(counts, value, ["n"], keys, buckets)

    def at(position: str, side: str) -> Column:
        # The value whose run of equal rows covers this position.
        covers = f"{position} >= n_before AND {position} < n_before + n"
        return F.expr(f"max(CASE WHEN {covers} THEN CAST(`{value}` AS DOUBLE) END) AS {side}")

    found, points = [F.expr("max(n_total) AS n")], []
    for i, p in enumerate(shares):
        found.append(at(f"floor({float(p)!r}D * (n_total - 1))", f"_lo{i}"))
        found.append(at(f"ceil({float(p)!r}D * (n_total - 1))", f"_hi{i}"))
        position = f"{float(p)!r}D * (n - 1)"
        points.append(f"_lo{i} + (_hi{i} - _lo{i}) * ({position} - floor({position}))")
    picked = placed.groupBy(*keys).agg(*found)
    return picked.select(*keys, "n", F.expr(f"array({', '.join(points)})").alias(name))


def median(df: DataFrame, value: str, keys: Sequence[str] = (), name: str = "median") -> DataFrame:
    return quantiles(df, value, [0.5], keys, "_q").select(*keys, F.get("_q", F.lit(0)).alias(name))


def row_positions(df: DataFrame, order: str, keys: Sequence[str] = (), ties: Sequence[str] = (),
                  name: str = "row_id") -> DataFrame:
    """0-based position of each row among the rows of its keys, by `order` then `ties`.

    Rows that share keys and `order` are numbered within that small set, so
    `ties` must tell them apart for a repeatable result. Rows without a key or
    order value are kept and get no position.
    """
    keys = list(keys)
    counts = df.groupBy(*keys, order).agg(F.count(F.lit(1)).alias("n"))
    starts = prefix_sums(counts, order, ["n"], keys).select(*keys, order, F.col("n_before").alias("_start"))
    within = Window.partitionBy(*keys, order).orderBy(*(ties or [order]))
    return (
        df.join(starts, [*keys, order], "left")
        .withColumn(name, (F.col("_start") + F.row_number().over(within) - 1).cast("long"))
        .drop("_start")
    )
