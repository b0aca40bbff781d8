"""Mixing sources to target weights by entropy balancing.

Each source gets a target number of words (`targets`). Among all document rates
between 0 and `cap` that meet the targets, the rates nearest to 1 in relative
entropy are exponentially tilted: rate = min(cap, exp(tilt of source * size)).
The tilts solve a convex dual with one word constraint per source. Its gradient
and curvature are sums over documents; as a rate depends on source and size
only, the documents are first counted per (source, size), and each Newton step
sums over those counts on the cluster. A step that leaves the bracket known to
hold the root is replaced by its middle, so every source converges.

Rates become copies in two steps. Per source, from the largest size down, each
(source, size) bin gets the whole number of copies nearest to its expected words
plus what the larger sizes left over or took too much; what remains at the end is
less than the smallest sizes can settle. Inside a bin all documents have one
rate; each gets the whole part, and those with the smallest hash of their id and
text one copy more until the bin's number is reached. Rows with one hash are equal
in all that is read; where the number ends among them, they are taken as they are
stored. Bins of many documents are ranked in slices, so no bin lands in one task.

Sources are ordered by code point, null last, and weigh 5, 2, 1, 5, ... A null
text has size 0 and is taken 0 times; so is everything if nothing has a word.
Repeated rows are documents of their own. The result does not depend on how rows
are dealt. Only id, text and source are read.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from zonecast.llm.base import word_count
from zonecast.session import checkpointed

WEIGHTS = (5, 2, 1)
SHARE = 1.5
CAP = 2.0
STEPS = 40
#: Documents of one bin that are ranked together.
SLICE = 50_000
#: Tables of bins and of extra copies are broadcast up to so many rows, of three short columns each.
BROADCAST_ROWS = 300_000


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> dict:
    """Target words of each source: `share` of all words by weight, no source above `cap` times its own.

    `sizes` has one row per source. What a full source cannot take goes to the
    others by weight, until none is above its limit. One number per source is
    all that the driver holds.
    """
    found = {r["source"]: r["words"] for r in sizes.collect()}
    order = sorted(found, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, open_, out = share * sum(found.values()), set(order), {}
    while open_:
        total = sum(weight[s] for s in open_)
        full = [s for s in order if s in open_ and left * weight[s] / total >= cap * found[s]]
        if not full:
            out |= {s: left * weight[s] / total for s in open_}
            break
        for s in full:
            out[s] = cap * found[s]
            open_.discard(s)
        left -= sum(out[s] for s in full)
    return out


def solve(spark: SparkSession, bins: DataFrame, goals: dict, cap: float = CAP, steps: int = STEPS) -> dict:
    """Tilt of each source: sum of n * size * min(cap, exp(tilt * size)) = target, to one part in 10^9.

    `bins` has (source, size, n), sizes of at least 1. The root lies between
    log(target / words) / smallest size (or 0) and log(cap) / smallest size.
    """
    edge = {r["source"]: r for r in bins.groupBy("source").agg(
        F.min("size").alias("low"), F.sum(F.col("n") * F.col("size")).alias("words")).collect()}
    state = {}
    for s, r in edge.items():
        goal = goals[s]
        if goal >= cap * r["words"]:
            state[s] = {"tilt": math.inf, "done": True}
        elif goal <= 0:
            state[s] = {"tilt": -math.inf, "done": True}
        else:
            flat = math.log(goal / r["words"])
            low, high = (flat / r["low"], 0.0) if flat < 0 else (0.0, math.log(cap) / r["low"])
            state[s] = {"tilt": 0.0, "low": low, "high": high, "done": abs(flat) < 1e-12}
    for _ in range(steps):
        active = [(s, float(x["tilt"])) for s, x in state.items() if not x["done"]]
        if not active:
            break
        # One row per source.
        tilts = spark.createDataFrame(active, "source string, tilt double")
        rate = F.exp(F.least(F.col("tilt") * F.col("size"), F.lit(math.log(cap))))
        free = F.col("tilt") * F.col("size") < math.log(cap)
        sums = (
            bins.join(tilts, bins["source"].eqNullSafe(tilts["source"])).select(bins["source"], "n", "size", rate.alias("rate"), free.alias("free"))
            .groupBy("source").agg(
                F.sum(F.col("n") * F.col("size") * F.col("rate")).alias("words"),
                F.sum(F.when(F.col("free"), F.col("n") * F.col("size") * F.col("size") * F.col("rate")).otherwise(0.0)).alias("curve"),
            )
        )
        for r in sums.collect():
            x, gap = state[r["source"]], r["words"] - goals[r["source"]]
            if abs(gap) <= 1e-9 * goals[r["source"]] + 1e-9:
                x["done"] = True
                continue
            x["high" if gap > 0 else "low"] = x["tilt"]
            step = x["tilt"] - gap / r["curve"] if r["curve"] > 0 else math.inf
            x["tilt"] = step if x["low"] < step < x["high"] else (x["low"] + x["high"]) / 2
    return {s: x["tilt"] for s, x in state.items()}


def settle(goal: float, tilt: float, sizes: list[int], counts: list[int], cap: float) -> list[int]:
    """Copies of each bin of one source, sizes descending: errors go on to the smaller sizes."""
    out, carry = [], 0.0
    for size, n in zip(sizes, counts):
        x = tilt * size
        rate = cap if x >= math.log(cap) else math.exp(max(x, -745.0))
        want = n * rate + carry / size
        copies = min(int(cap * n), max(0, math.floor(want + 0.5)))
        carry = (want - copies) * size
        out.append(copies)
    return out


def mix(
    spark: SparkSession, docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP,
) -> DataFrame:
    """The documents with size, source_size, target, rate and copies; other columns stay.

    A column of `docs` with one of these names stays as `given_<name>`.
    """
    names = ("size", "source_size", "target", "rate", "copies")
    kept = [F.col(f"row.`{c}`").alias(f"given_{c}" if c in names else c) for c in docs.columns]
    # Whatever their names, the columns travel in one struct.
    sized = docs.select(F.struct(*docs.columns).alias("row"), "source", word_count(F.col("text")).alias("size"), F.xxhash64("doc_id", "text").alias("_draw"))
    slim = checkpointed(spark, sized.select("source", "size", F.col("_draw").alias("draw")))
    bins = checkpointed(spark, slim.groupBy("source", "size").agg(F.count("*").alias("n")))
    sizes = bins.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("words"))
    goals = targets(sizes, weights, share, cap)
    words = {r["source"]: r["words"] for r in sizes.collect()}
    tilts = solve(spark, bins.where("size > 0"), goals, cap)

    def copies_of(source_bins: pd.DataFrame) -> pd.DataFrame:
        source = source_bins["source"].iloc[0]
        source = None if pd.isna(source) else source
        b = source_bins.sort_values("size", ascending=False)
        b = b[b["size"] > 0]
        tilt = tilts.get(source, 0.0)
        b["copies"] = settle(goals[source], tilt, b["size"].tolist(), b["n"].tolist(), cap)
        b["rate"] = [cap if tilt * s >= math.log(cap) else math.exp(max(tilt * s, -745.0)) for s in b["size"].tolist()]
        return b[["source", "size", "n", "copies", "rate"]]

    # A group here holds the distinct sizes of one source: no more than its longest document has words.
    dealt = checkpointed(spark, bins.groupBy("source").applyInPandas(
        copies_of, "source string, size bigint, n bigint, copies bigint, rate double"))
    picked = checkpointed(spark, _extra_copies(slim, dealt))
    source_facts = spark.createDataFrame(
        [(s, int(words[s]), float(goals[s])) for s in goals] or [], "source string, source_size bigint, target double")

    d = dealt.select("source", "size", "rate", F.floor(F.col("copies") / F.col("n")).alias("whole"))
    out = _join(_join(sized, _hinted(d), ["source", "size"]), source_facts, ["source"])
    out = _join(out, _hinted(picked.withColumnRenamed("draw", "_draw")), ["source", "size", "_draw"])
    if not picked.where("extra < k").isEmpty():
        out = out.where("extra IS NULL OR extra = k").unionByName(_dealt_one_by_one(spark, out.where("extra < k")))
    copies = (F.coalesce("whole", F.lit(0)) + F.when(F.col("extra") > 0, 1).otherwise(0)).cast("long")
    return out.select(*kept, "size", "source_size", "target", F.coalesce("rate", F.lit(0.0)).alias("rate"), copies.alias("copies"))


def _hinted(df: DataFrame) -> DataFrame:
    """Broadcast a stored table of so few rows that the texts need not be shuffled; leave larger ones to a shuffle."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _join(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Left join in which nulls match."""
    r = right.select(*[F.col(k).alias(f"_r_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    on = [left[k].eqNullSafe(r[f"_r_{k}"]) for k in keys]
    return left.join(r, on, "left").drop(*[f"_r_{k}" for k in keys])


def _extra_copies(slim: DataFrame, dealt: DataFrame) -> DataFrame:
    """(source, size, draw, k, extra): the draws of a bin of which `extra` of `k` rows get one copy more than its whole part.

    Only the draw at the limit can have more rows than extras. Big bins are cut
    into slices of the hash range, counted, and only then ranked.
    """
    short = dealt.select("source", "size", "n", (F.col("copies") % F.col("n")).alias("more")).where("more > 0")
    rows = _join(slim.groupBy("source", "size", "draw").agg(F.count("*").alias("k")), short, ["source", "size"]).where("more > 0")
    slices = F.ceil(F.col("n") / SLICE)
    # The upper 31 bits of the draw, cut into equal ranges, keep the order of draws.
    place = F.shiftrightunsigned(F.col("draw").bitwiseXOR(F.lit(-(1 << 63))), 33)
    rows = rows.withColumn("slice", F.shiftright(place * slices, 31))
    counts = rows.groupBy("source", "size", "slice").agg(F.sum("k").alias("k"))
    earlier = Window.partitionBy("source", "size").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("source", "size", "slice", F.coalesce(F.sum("k").over(earlier), F.lit(0)).alias("start"))
    inside = Window.partitionBy("source", "size", "slice").orderBy("draw").rowsBetween(Window.unboundedPreceding, 0)
    ranked = _join(rows, starts, ["source", "size", "slice"]).withColumn("upto", F.col("start") + F.sum("k").over(inside))
    extra = F.least(F.col("k"), F.col("more") - (F.col("upto") - F.col("k")))
    return ranked.select("source", "size", "draw", "k", extra.alias("extra")).where("extra > 0")


def _dealt_one_by_one(spark: SparkSession, torn: DataFrame) -> DataFrame:
    """The rows of draws with fewer extras than rows, with `extra` 1 for the first ones as stored, 0 for the others."""
    # Numbered once written, by the task that wrote them, so that no draw is ranked in one task.
    rows = checkpointed(spark, torn.withColumn("_row", F.monotonically_increasing_id())).withColumn("_task", F.shiftright("_row", 33))
    counts = rows.groupBy("_draw", "source", "size", "_task").agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy("_draw", "source", "size").orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_draw", "source", "size", "_task", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("_draw", "source", "size", "_task").orderBy("_row")
    ranked = _join(rows, starts, ["_draw", "source", "size", "_task"]).withColumn("_at", F.col("_start") + F.row_number().over(inside))
    return ranked.withColumn("extra", F.when(F.col("_at") <= F.col("extra"), 1).otherwise(0).cast("long")).drop("_row", "_task", "_start", "_at")


def report(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken and the rate: one row per document."""
    mixed = mix(spark, docs.select("doc_id", "text", "source"))
    return mixed.select(
        F.col("doc_id").cast("long"), "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"), "rate",
    )
