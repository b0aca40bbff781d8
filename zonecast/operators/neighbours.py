"""Mutual information by nearest neighbours, for continuous columns, on the cluster.

The estimate of Kraskov, Stoegbauer and Grassberger: with r the distance of a row
to its k-th neighbour in the plane (feature, target) under the larger of the two
differences, and n_x, n_y the rows nearer than r in one coordinate alone (itself
included), it is psi(n) + psi(k) - mean(psi(n_x) + psi(n_y)), at least 0.

* Columns are divided by their standard deviation and put on an integer grid of
  2^-26 deviations; 20 more bits of hash noise below it break ties. From there on
  all comparisons are exact, whatever tasks do them.
* Rows of a feature are sorted by value and cut into slabs of `SLAB` rows. Equal
  values differ in their noise, so a value that a third of all rows have is as
  many slabs as any third of the rows.
* A row's k nearest inside its slab bound r. Where that reaches over the slab's
  border, the row is copied to the slabs within reach, one on each side, then
  two, four and so on, as long as their border is nearer than the r found so far.
* n_x and n_y are differences of ranks: interval ends are sorted among the
  values by bucketed prefix sums; no row is compared with all others.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from zonecast.operators.ordering import prefix_sums
from zonecast.session import checkpointed

SLAB = 1024
GRID, NOISE = 1 << 26, 1 << 20
#: Deviations beyond which a value counts as that many.
FARTHEST = 1 << 16
NEVER = (1 << 62) - 1


def on_grid(value: Column, deviation: Column, *seed: Column) -> Column:
    scaled = value / F.when(deviation > 0, deviation).otherwise(1.0)
    level = F.floor(F.greatest(F.least(scaled, F.lit(float(FARTHEST))), F.lit(-float(FARTHEST))) * GRID).cast("long")
    return level * NOISE + F.pmod(F.xxhash64(*seed), F.lit(NOISE))


def gridded(df: DataFrame, features: Sequence[str], target: str, keys: Sequence[str]) -> DataFrame:
    """(feature, x, y) in whole numbers; nulls and NaN count as 0."""
    own = [F.col(k) for k in keys]

    def filled(c: str) -> Column:
        return F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0))

    spread = df.agg(F.struct(*[F.stddev_pop(filled(c)).alias(f"_{i}") for i, c in enumerate([*features, target])]).alias("s")).scalar()
    y = on_grid(filled(target), F.col(f"_s._{len(features)}"), *own, F.lit("y"))
    pairs = F.array(*[F.struct(F.lit(f).alias("feature"), on_grid(filled(f), F.col(f"_s._{i}"), *own, F.lit(f)).alias("x")) for i, f in enumerate(features)])
    return df.withColumn("_s", spread).select(y.alias("y"), F.explode(pairs).alias("_p")).select("_p.feature", "_p.x", "y")


_SLAB = "feature string, part int, seq bigint, low bigint, high bigint, xs array<bigint>, ys array<bigint>"


def slabs(rows: DataFrame) -> DataFrame:
    """(feature, slab, low, high, xs, ys): rows sorted by (feature, x), `SLAB` in a row, numbered by value in their feature."""
    spark = rows.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seq, current = TaskContext.get().partitionId(), 0, None
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def packed(whole: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, seq
            if not held:
                return
            xs, ys = (np.concatenate([h[i] for h in held]) for i in (0, 1))
            end = len(xs) if whole else len(xs) // SLAB * SLAB
            for start in range(0, end, SLAB):
                x, y = xs[start:start + SLAB], ys[start:start + SLAB]
                if start + SLAB > end:
                    x, y = xs[start:end], ys[start:end]
                yield pa.RecordBatch.from_pydict({
                    "feature": [current], "part": pa.array([part], pa.int32()), "seq": [seq], "low": [int(x[0])], "high": [int(x[-1])],
                    "xs": pa.array([x], pa.list_(pa.int64())), "ys": pa.array([y], pa.list_(pa.int64()))})
                seq += 1
            held = [] if whole or end == len(xs) else [(xs[end:], ys[end:])]

        for batch in batches:
            names = np.array(batch.column(0).to_pylist(), dtype=object)
            x, y = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            cuts = [0, *(np.flatnonzero(names[1:] != names[:-1]) + 1).tolist(), len(names)]
            for low, high in zip(cuts, cuts[1:]) if len(names) else ():
                if names[low] != current:
                    yield from packed(True)
                    current = names[low]
                held.append((x[low:high], y[low:high]))
                yield from packed(False)
        yield from packed(True)

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartitionByRange(parts, "feature", "x", "y").sortWithinPartitions("feature", "x", "y")
    cut = checkpointed(spark, ordered.mapInArrow(run, _SLAB))
    # One row per feature and partition is put in order, not the slabs.
    runs = cut.groupBy("feature", "part").agg(F.min("seq").alias("_first"), F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy("feature").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = runs.select("feature", "part", (F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_first")).alias("_shift"))
    return cut.join(starts, ["feature", "part"]).select("feature", (F.col("seq") + F.col("_shift")).alias("slab"), "part", "seq", "low", "high", "xs", "ys")


def nearest(qx: np.ndarray, qy: np.ndarray, xs: np.ndarray, ys: np.ndarray, k: int, own: bool) -> np.ndarray:
    """The k smallest distances of each query to the points, sorted; `own`: queries are the points, without themselves."""
    far = np.maximum(np.abs(qx[:, None] - xs), np.abs(qy[:, None] - ys))
    if own:
        np.fill_diagonal(far, NEVER)
    if far.shape[1] < k:
        far = np.pad(far, ((0, 0), (0, k - far.shape[1])), constant_values=NEVER)
    return np.sort(np.partition(far, k - 1, axis=1)[:, :k], axis=1)


def _flat(column: pa.Array, i: int) -> np.ndarray:
    return column[i].values.to_numpy()


def own_neighbours(packs: DataFrame, k: int) -> DataFrame:
    """(row, feature, slab, x, y, best): the k nearest inside the own slab."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                xs, ys = _flat(batch.column(4), i), _flat(batch.column(5), i)
                best = nearest(xs, ys, xs, ys, k, True)
                n = len(xs)
                # Unique in the table: the slab's place among all partitions, then the place in the slab.
                first = ((batch.column(2)[i].as_py() << 33) | batch.column(3)[i].as_py()) * SLAB
                yield pa.RecordBatch.from_arrays(
                    [pa.array(first + np.arange(n)), pa.repeat(batch.column(0)[i], n), pa.repeat(batch.column(1)[i], n), pa.array(xs), pa.array(ys),
                     pa.array(list(best), pa.list_(pa.int64()))], names=["row", "feature", "slab", "x", "y", "best"])

    return packs.select("feature", "slab", "part", "seq", "xs", "ys").mapInArrow(
        run, "row bigint, feature string, slab bigint, x bigint, y bigint, best array<bigint>")


def asked(rows: DataFrame, packs: DataFrame, reached: int, step: int) -> DataFrame:
    """(row, side, feature, slab, target, x, y): copies of (row, side) to the next slabs on that side whose border is nearer than the k-th neighbour."""
    there = F.sequence(F.col("slab") + F.col("side") * (reached + 1), F.col("slab") + F.col("side") * (reached + step))
    copies = rows.select("row", "side", "feature", "slab", "x", "y", F.element_at("best", -1).alias("r"), F.explode(there).alias("target"))
    borders = packs.select("feature", F.col("slab").alias("target"), "low", "high")
    met = copies.join(borders, ["feature", "target"])
    return met.where("IF(side < 0, high > x - r, low < x + r)").select("row", "side", "feature", "slab", "target", "x", "y")


def answered(questions: DataFrame, packs: DataFrame, k: int) -> DataFrame:
    """(row, found): the k nearest of each question in its target slab."""
    block = F.pmod(F.xxhash64("row"), F.lit(64))
    sets = questions.groupBy("feature", "target", block.alias("_b")).agg(F.collect_list(F.struct("row", "x", "y")).alias("q"))
    points = packs.select("feature", F.col("slab").alias("target"), "xs", "ys")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                q = batch.column(0)[i].values
                row, x, y = (q.field(c).to_numpy() for c in ("row", "x", "y"))
                xs, ys = _flat(batch.column(1), i), _flat(batch.column(2), i)
                for start in range(0, len(row), SLAB):
                    own = slice(start, start + SLAB)
                    best = nearest(x[own], y[own], xs, ys, k, False)
                    yield pa.RecordBatch.from_arrays([pa.array(row[own]), pa.array(list(best), pa.list_(pa.int64()))], names=["row", "found"])

    return sets.join(points, ["feature", "target"]).select("q", "xs", "ys").mapInArrow(run, "row bigint, found array<bigint>")


def neighbour_distances(rows: DataFrame, k: int) -> DataFrame:
    """(row, feature, x, y, r): the distance of each row to its k-th neighbour."""
    spark = rows.sparkSession
    packs = checkpointed(spark, slabs(rows))
    known = checkpointed(spark, own_neighbours(packs, k))
    reached, step = 0, 1
    both = F.explode(F.array(F.lit(-1), F.lit(1))).alias("side")
    open_ = known.select("row", both)
    while True:
        questions = checkpointed(spark, asked(known.join(open_, "row") if reached else known.select("*", both), packs, reached, step))
        if questions.isEmpty():
            break
        found = answered(questions, packs, k).groupBy("row").agg(F.flatten(F.collect_list("found")).alias("found"))
        best = F.slice(F.array_sort(F.concat("best", F.coalesce("found", F.array().cast("array<bigint>")))), 1, k)
        known = checkpointed(spark, known.join(found, "row", "left").select("row", "feature", "slab", "x", "y", best.alias("best")))
        # Who did not need the outermost slab of a side needs none beyond it: r only shrinks.
        open_ = questions.where(F.col("target") == F.col("slab") + F.col("side") * (reached + step)).select("row", "side").distinct()
        reached, step = reached + step, 2 * step
    return known.select("row", "feature", "x", "y", F.element_at("best", -1).alias("r"))


def marginal_counts(found: DataFrame) -> DataFrame:
    """(row, feature, nx, ny): rows nearer than r in one coordinate, the row itself included."""
    axes = F.array(*[F.struct(F.lit(a).alias("axis"), F.col(a).alias("at")) for a in ("x", "y")])
    flat = found.select("row", "feature", "r", F.explode(axes).alias("_a")).select("row", "feature", "r", "_a.axis", "_a.at")
    ends = F.array(F.struct(F.lit(0).alias("p"), (F.col("at") - F.col("r")).alias("value")), F.struct(F.lit(0).alias("p"), (F.col("at") + F.col("r")).alias("value")),
                   F.struct(F.lit(1).alias("p"), F.col("at").alias("value")))
    values = flat.select("feature", "axis", F.explode(ends).alias("_e")).groupBy("feature", "axis", "_e.value").agg(F.sum("_e.p").alias("p"))
    ranked = checkpointed(found.sparkSession, prefix_sums(values, "value", ["p"], ["feature", "axis"]).select("feature", "axis", "value", "p", "p_before"))
    sides = F.array(F.struct(F.lit(-1).alias("side"), (F.col("at") - F.col("r")).alias("value")), F.struct(F.lit(1).alias("side"), (F.col("at") + F.col("r")).alias("value")))
    asked_for = flat.select("row", "feature", "axis", F.explode(sides).alias("_e")).select("row", "feature", "axis", "_e.side", "_e.value")
    met = asked_for.join(ranked, ["feature", "axis", "value"])
    part = F.when(F.col("side") > 0, F.col("p_before")).otherwise(-F.col("p_before") - F.col("p"))
    count = lambda a: F.greatest(F.sum(F.when(F.col("axis") == a, part)), F.lit(1))
    return met.groupBy("row", "feature").agg(count("x").alias("nx"), count("y").alias("ny"))


def psi(n: Column) -> Column:
    """The digamma function of a whole number, by its series after six steps of the recurrence."""
    n = n.cast("double")
    m = n + 6
    series = F.ln(m) - 1 / (2 * m) - 1 / (12 * m**2) + 1 / (120 * m**4) - 1 / (252 * m**6) + 1 / (240 * m**8) - 1 / (132 * m**10)
    return series - sum((1 / (n + i) for i in range(1, 6)), 1 / n)


def mutual_information(df: DataFrame, features: Sequence[str], target: str = "demand", neighbours: int = 3,
                       keys: Sequence[str] = ("timestamp", "zone")) -> DataFrame:
    """(feature, mi) in nats over all rows. `keys` tell rows apart, for the noise.

    With `neighbours` rows or fewer there is nothing to estimate: 0. An empty
    table gives no rows.
    """
    spark = df.sparkSession
    rows = gridded(df, features, target, keys)
    found = checkpointed(spark, neighbour_distances(rows, neighbours))
    near = found.where(F.col("r") < NEVER)
    counted = marginal_counts(near)
    mi = psi(F.count(F.lit(1))) + psi(F.lit(neighbours)) - F.avg(psi(F.col("nx")) + psi(F.col("ny")))
    some = counted.groupBy("feature").agg(F.greatest(mi, F.lit(0.0)).alias("mi"))
    every = found.groupBy("feature").agg(F.count(F.lit(1)).alias("_n"))
    return every.join(some, "feature", "left").select("feature", F.coalesce("mi", F.lit(0.0)).alias("mi"))
