"""Exact Jaccard join of word-shingle sets, skipping by set relations.

Two documents link when 100 * |A & B| >= percent * |A | B| for their sets of
shingles. The result is each document's component under these links.

1. Each text becomes a sorted array of 64-bit shingle hashes; equal sets are one
   set from here on.
2. Shingles get one global order: rare first. How common a shingle is, is read
   from a table of `SKETCH` counters of all shingles (its size does not depend on
   the corpus); inside a step of two the hash decides. Any order gives the same
   result; this one keeps common passages out of the index.
3. Index lists hold, per shingle, the sets that have it in their prefix (the part
   in which two linked sets must meet), with size and position. Lists are cut
   into blocks by size and position band; a set visits only the blocks in which
   the bound of `can_link` can still reach the needed overlap, and skips the
   others. Linked sets meet in as many prefix shingles as the needed overlap
   leaves over (`least_meetings`). The first of these, up to `MEETINGS`, are
   counted where lists meet, in one narrow aggregate, so that sets with a chance
   meeting go no further, however many there are; all of them are then counted
   from the two prefixes before any set is fetched.
4. Sets of one list are first compared with a hub only (the list's smallest by
   hash, in a few draws). Of each set its `delta` is kept, the shingles that only
   one of set and hub has. What a set and another one differ in is what only one
   of their deltas holds, so deltas are moved without reading texts again: to
   the hub that a hub follows, and to the middle of the group (what more than
   half of it has). Links with the set nearest to the middle follow from the
   deltas, and sets linked with it or with a hub take over its class: pairs
   within a class are never formed.
5. Answers of other sets of a hub follow from the deltas: deltas with nothing in
   common add up. Where that is too much, the sets can link only through common
   shingles of their deltas: these, rare ones first, are looked up in lists of
   their own, and the pair is skipped in the long lists of what all have.
6. In a list, only sets outside the list's largest class visit it, so a list of
   one class costs nothing. The pairs left are verified one by one.

Texts and prefixes are dealt by id only for rows that a broadcast of ids, or of
a filter of bounded size, does not settle (`among`, `without`).

A null text, or one without words, has an empty set: size 0, linked with
nothing. A text shorter than a shingle has one shingle, the whole of it. Of rows
that share an id, the set with the smallest digest stands for it in linking;
each row is returned, with its own size.
Ties do not matter: a component is named by its smallest id. Null ids are
returned with a null component and link with nothing. Other columns stay unread.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from zonecast.llm.base import lower_words_of, sliced
from zonecast.llm.links import components
from zonecast.session import checkpointed

SKETCH = 1 << 20
DRAWS = 2
#: How often hubs give way to the hubs they follow; any number gives the same result.
RAISES = 2
#: Lists longer than that have blocks by size.
BLOCKED = 64
#: Pairs must meet that often, or as often as their prefixes allow, to be looked at; any number from 1 gives the same result.
MEETINGS = 4
#: Ids of rows to pick or to leave out are broadcast up to this number, of one long each.
BROADCAST_IDS = 500_000
#: Beyond that a filter of 16 bits an id is broadcast, of at most this many bits, and only rows that it cannot tell are dealt by id.
FILTER_BITS = 1 << 28

K1, K2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * K1
    return x ^ (x >> np.uint64(29))


def shingles(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles; of all words if there are fewer than k."""
    import xxhash

    words = lower_words_of(text)
    if not words:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    n = max(1, len(w) - k + 1)
    out = np.full(n, len(w) if len(w) < k else k, np.uint64)
    for i in range(min(k, len(w))):
        out = mixed(out * K2 + w[i:i + n])
    return np.unique(out)


def needed(a, b, percent: int):
    """Smallest overlap of linked sets of sizes a and b."""
    total = (a + b) * percent
    return -(-total // (100 + percent))


def prefix_length(n, percent: int):
    """Length of the part in which a set meets every set it links with."""
    return n - -(-n * percent // 100) + 1


def counters(docs: DataFrame, k: int) -> DataFrame:
    """(cell, n): how often shingles of a cell occur, over all documents."""

    def run(batches):
        total = np.zeros(SKETCH, np.int64)
        mask = np.uint64(SKETCH - 1)
        waiting, size = [], 0
        for batch in sliced(batches):
            for text in batch.column(0).to_pylist():
                waiting.append((shingles(text, k) & mask).astype(np.int64))
                size += len(waiting[-1])
                if size > 2_000_000:
                    total += np.bincount(np.concatenate(waiting), minlength=SKETCH)
                    waiting, size = [], 0
        if waiting:
            total += np.bincount(np.concatenate(waiting), minlength=SKETCH)
        for block in range(0, SKETCH, 65_536):
            part = total[block:block + 65_536]
            yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([part.astype(np.int64).tobytes()])], ["block", "counts"])

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for block, counts in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                sums[block] = sums.get(block, 0) + np.frombuffer(counts, np.int64)
        for block, n in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([n.tobytes()])], ["block", "counts"])

    # Blocks go to tasks whole; a task adds up one row at a time.
    parts = docs.select("text").mapInArrow(run, "block bigint, counts binary")
    return parts.repartition(16, "block").mapInArrow(add, "block bigint, counts binary")


def commonness(spark: SparkSession, docs: DataFrame, k: int):
    """For each cell, the step of two by which its shingles are more common than the rest."""
    total = np.zeros(SKETCH, np.int64)
    for r in counters(docs, k).toLocalIterator():
        total[r["block"]:r["block"] + 65_536] = np.frombuffer(r["counts"], np.int64)
    usual = max(1.0, float(np.median(total)))
    return np.floor(np.log2(np.maximum(total / usual, 1))).astype(np.uint8)


def signatures(spark: SparkSession, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """Per row: id, size of the set, digest of the set, and its prefix as little-endian hashes in order."""
    steps = spark.sparkContext.broadcast(commonness(spark, docs, k))

    def run(batches):
        from xxhash import xxh128_digest

        for batch in sliced(batches):
            sizes, digests, prefixes = [], [], []
            for text in batch.column(1).to_pylist():
                s = shingles(text, k)
                sizes.append(len(s))
                digests.append(xxh128_digest(s.tobytes()))
                rank = steps.value[(s & np.uint64(SKETCH - 1)).astype(np.int64)]
                # Sorted by hash already; a stable sort by commonness keeps that inside a step.
                order = np.argsort(rank, kind="stable")[:prefix_length(len(s), percent) if len(s) else 0]
                prefixes.append(s[order].tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(prefixes, pa.binary())],
                ["doc_id", "n_shingles", "digest", "prefix"])

    schema = "doc_id bigint, n_shingles bigint, digest binary, prefix binary"
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)


def index(sets: DataFrame) -> DataFrame:
    """(shingle, id, n, at): the lists, one row per set and prefix position, lists of one set left out."""

    def run(batches):
        for b in sliced(batches):
            ids, sizes = b.column(0).to_numpy(), b.column(1).to_numpy()
            parts = [np.frombuffer(p, np.int64) for p in b.column(2).to_pylist()]
            lengths = np.array([len(p) for p in parts], np.int64)
            if not lengths.sum():
                continue
            at = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(parts)), pa.array(np.repeat(ids, lengths)), pa.array(np.repeat(sizes, lengths).astype(np.int32)),
                 pa.array(at.astype(np.int32))], ["shingle", "id", "n", "at"])

    return sets.select("doc_id", "n_shingles", "prefix").mapInArrow(run, "shingle bigint, id bigint, n int, at int")


def ceil_sql(a: str, b: int) -> str:
    return f"(({a}) + {b - 1}) DIV {b}"


def can_link(x: str, y: str, percent: int) -> str:
    """SQL: sizes fit, and this meeting and the rest of both sets behind it reach the needed overlap, less the meetings before it.

    This holds for each of the first `first_meetings` of linked sets: they share fewer shingles than that before it.
    """
    need = ceil_sql(f"({x}.n + {y}.n) * {percent}", 100 + percent)
    return (
        f"{x}.n * 100 >= {y}.n * {percent} AND {y}.n * 100 >= {x}.n * {percent} "
        f"AND least({x}.n - {x}.at, {y}.n - {y}.at) > {need} - {first_meetings(f'{x}.n', f'{y}.n', percent)}"
    )


def least_meetings(a: str, b: str, percent: int) -> str:
    """SQL: in how many prefix shingles linked sets of sizes a and b meet at least.

    One of the prefixes ends first in the global order. All its shingles that
    the other set has are in that one's prefix, and behind it lie at most the
    rest of its own set.
    """
    need = ceil_sql(f"({a} + {b}) * {percent}", 100 + percent)
    rest = f"greatest({ceil_sql(f'{a} * {percent}', 100)}, {ceil_sql(f'{b} * {percent}', 100)}) - 1"
    return f"greatest(1, {need} - ({rest}))"


def first_meetings(a: str, b: str, percent: int) -> str:
    """SQL: how many meetings of two sets of sizes a and b are counted where lists meet, all of them in both prefixes."""
    return f"least({MEETINGS}, {least_meetings(a, b, percent)})"


def cells(ids: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The two bits of each id in a filter of `bits` bits, a power of two."""
    h = mixed(mixed(ids.astype(np.int64).view(np.uint64) * K2))
    return (h & np.uint64(bits - 1)).astype(np.int64), (h >> np.uint64(32) & np.uint64(bits - 1)).astype(np.int64)


def filter_of(spark: SparkSession, ids: DataFrame, count: int):
    """A test of id columns: false for ids that are surely none of the `count` ids, and for null."""
    bits = min(FILTER_BITS, 1 << max(16, (16 * count - 1).bit_length()))

    def run(batches):
        for b in batches:
            at = np.concatenate(cells(b.column(0).to_numpy(), bits))
            yield pa.RecordBatch.from_arrays([pa.array(at >> 16), pa.array(at & 65_535)], ["block", "at"])

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            blocks, at = b.column(0).to_numpy(), b.column(1).to_numpy()
            for block in np.unique(blocks):
                sums.setdefault(int(block), np.zeros(65_536, bool))[at[blocks == block]] = True
        for block, seen in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([np.packbits(seen).tobytes()])], ["block", "seen"])

    # Blocks of 8 kB go to tasks whole.
    blocks = ids.mapInArrow(run, "block bigint, at bigint").repartition("block").mapInArrow(add, "block bigint, seen binary")
    found = np.zeros(bits // 8, np.uint8)
    for r in blocks.toLocalIterator():
        found[r["block"] * 8192:(r["block"] + 1) * 8192] = np.frombuffer(r["seen"], np.uint8)
    shared = spark.sparkContext.broadcast(found)

    @F.pandas_udf("boolean")
    def maybe(column: pd.Series) -> pd.Series:
        out = np.zeros(len(column), bool)
        given = column.notna().to_numpy()
        known = np.ones(int(given.sum()), bool)
        for at in cells(column[given].to_numpy(), bits):
            known &= (shared.value[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)
        out[given] = known
        return pd.Series(out)

    return maybe


def among(spark: SparkSession, rows: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """The rows whose `key` is one of `ids`, a stored table of one column of distinct ids."""
    ids = ids.toDF(key)
    if (count := ids.count()) <= BROADCAST_IDS:
        return rows.join(F.broadcast(ids), key, "left_semi").select(*rows.columns)
    return rows.where(filter_of(spark, ids, count)(key)).join(ids, key, "left_semi").select(*rows.columns)


def without(spark: SparkSession, rows: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """The rows whose `key` is none of `ids`, a stored table of one column of distinct ids, or null."""
    ids = ids.toDF(key)
    if (count := ids.count()) <= BROADCAST_IDS:
        return rows.join(F.broadcast(ids), key, "left_anti").select(*rows.columns)
    maybe = filter_of(spark, ids, count)(key)
    return rows.where(~maybe).unionByName(rows.where(maybe).join(ids, key, "left_anti").select(*rows.columns))


def fetch(spark: SparkSession, docs: DataFrame, ids: DataFrame, k: int) -> DataFrame:
    """(id, items): the sets of the given ids, made again from their texts; `ids` is stored and distinct."""

    def run(batches):
        from xxhash import xxh128_digest

        for b in sliced(batches):
            items = [shingles(t, k).tobytes() for t in b.column(1).to_pylist()]
            kept = pa.array([len(x) > 0 for x in items], pa.bool_())
            out = pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(map(xxh128_digest, items), pa.binary()), pa.array(items, pa.binary())], ["id", "digest", "items"])
            yield out.filter(kept)

    texts = docs.select(F.col("doc_id").cast("long").alias("id"), "text")
    return among(spark, texts, "id", ids).mapInArrow(run, "id bigint, digest binary, items binary").groupBy("id").agg(F.min_by("items", "digest").alias("items"))


def compared(spark: SparkSession, docs: DataFrame, pairs: DataFrame, k: int, percent: int) -> DataFrame:
    """(a, b, linked, apart, delta) of stored pairs (a, b): in how many shingles they differ, and the shingles that one of them has."""
    ids = checkpointed(spark, pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct())
    sets = checkpointed(spark, fetch(spark, docs, ids, k))

    def run(batches):
        for batch in sliced(batches):
            out = {"linked": [], "apart": [], "delta": []}
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                delta = np.setxor1d(x, y, assume_unique=True)
                same = (len(x) + len(y) - len(delta)) // 2
                out["linked"].append(100 * same >= percent * (len(x) + len(y) - same))
                out["apart"].append(len(delta))
                # Of sets further apart than that, no difference is of use.
                out["delta"].append((delta if 2 * same > max(len(x), len(y)) else delta[:0]).view(np.int64))
            kinds = {"linked": pa.bool_(), "apart": pa.int32(), "delta": pa.list_(pa.int64())}
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *(pa.array(out[c], t) for c, t in kinds.items())], ["a", "b", *kinds])

    first = pairs.join(sets.select(F.col("id").alias("a"), F.col("items").alias("x")), "a")
    both = first.join(sets.select(F.col("id").alias("b"), F.col("items").alias("y")), "b")
    return both.select("a", "b", "x", "y").mapInArrow(run, "a bigint, b bigint, linked boolean, apart int, delta array<bigint>")


def hub_pairs(lists: DataFrame, percent: int) -> DataFrame:
    """(a, b): for each set a, the hub b it meets most often, and the hub that most sets meet.

    A list has as many hubs as draws: the sets with the smallest hashes of a draw
    among those of about its size. Incomplete on purpose; the differences follow.
    """
    band = F.floor(F.log("n") / F.log(F.lit(100 / percent)))
    banded = lists.withColumn("band", band)
    draws = [F.min(F.struct(F.xxhash64("id", F.lit(i)).alias("h"), "id", "n")).alias(f"hub{i}") for i in range(DRAWS)]
    hubs = banded.groupBy("shingle", "band").agg(*draws, F.count("*").alias("k")).where("k > 1").select(
        "shingle", "band", F.array_distinct(F.array(*[F.struct(F.col(f"hub{i}.id").alias("b"), F.col(f"hub{i}.n").alias("bn")) for i in range(DRAWS)])).alias("hubs"))
    met = banded.join(hubs, ["shingle", "band"]).select("id", "n", F.explode("hubs").alias("h")).select("id", "n", "h.b", "h.bn").where("id <> b")
    met = met.groupBy("id", "b", "n", "bn").agg(F.count("*").alias("met"))
    fit = met.where(f"n * 100 >= bn * {percent} AND bn * 100 >= n * {percent} AND met * 3 >= {least_meetings('n', 'bn', percent)}")
    liked = fit.groupBy("b").agg(F.count("*").alias("likes"))
    best = fit.join(liked, "b").groupBy(F.col("id").alias("a")).agg(
        F.max(F.struct("met", "b")).alias("near"), F.max(F.struct("likes", "b")).alias("main"))
    return best.select("a", F.explode(F.array("near.b", "main.b")).alias("b")).distinct()


def either(x: str, y: str) -> Column:
    """The shingles that only one of two arrays has."""
    return F.concat(F.array_except(x, y), F.array_except(y, x))


def groups_of(seen: DataFrame) -> DataFrame:
    """(id, hub, delta): of the compared hubs of each set the one most others have, and what set and hub differ in."""
    near = seen.where("size(delta) = apart").select("a", "b", "delta")
    liked = near.groupBy("b").agg(F.count("*").alias("likes"))
    # Hubs follow hubs of more sets only, so that they form no rings.
    ranked = near.select("a", "b").join(liked, "b").join(liked.selectExpr("b AS a", "likes AS own"), "a", "left").where(
        "own IS NULL OR likes > own OR (likes = own AND b > a)")
    best = ranked.groupBy("a").agg(F.max(F.struct("likes", "b")).alias("m")).select("a", F.col("m.b").alias("b"))
    members = near.join(best, ["a", "b"]).select(F.col("a").alias("id"), F.col("b").alias("hub"), "delta")
    own = members.select(F.col("hub").alias("id")).distinct().join(members, "id", "left_anti")
    return members.union(own.select("id", F.col("id").alias("hub"), F.array().cast("array<bigint>").alias("delta")))


def raised(groups: DataFrame) -> DataFrame:
    """The groups with each hub that follows another replaced by that one: the difference of two differences is exact."""
    hubs = groups.select("hub").distinct()
    above = groups.where("hub <> id").select(F.col("id").alias("hub"), F.col("hub").alias("top"), F.col("delta").alias("way")).join(hubs, "hub", "left_semi")
    return groups.join(above, "hub", "left").select(
        "id", F.coalesce("top", "hub").alias("hub"), F.when(F.col("top").isNull(), F.col("delta")).otherwise(either("delta", "way")).alias("delta"))


def centred(groups: DataFrame, sizes: DataFrame) -> DataFrame:
    """(id, hub, delta, n, d): differences from the middle of the group instead of its hub, d of them, and the set's size.

    The middle has what more than half of the group's sets have. No document
    need have it: two sets differ in what only one of their differences holds,
    whatever they are taken from. A group has at most twice as many shingles to
    turn over as its sets have on average.
    """
    members = groups.groupBy("hub").agg(F.count("*").alias("members"))
    counts = groups.select("hub", F.explode("delta").alias("shingle")).groupBy("hub", "shingle").agg(F.count("*").alias("k"))
    usual = counts.join(members, "hub").where("2 * k > members").groupBy("hub").agg(F.collect_list("shingle").alias("usual"))
    turned = groups.join(usual, "hub", "left").select(
        "id", "hub", F.when(F.col("usual").isNull(), F.col("delta")).otherwise(either("delta", "usual")).alias("delta"))
    return turned.join(sizes, "id").withColumn("d", F.size("delta"))


def room(x: str, y: str, percent: int) -> str:
    """SQL: in how many shingles linked sets may differ."""
    return f"({x}.n + {y}.n - 2 * ({ceil_sql(f'({x}.n + {y}.n) * {percent}', 100 + percent)}))"


def middle_links(groups: DataFrame, percent: int) -> DataFrame:
    """(a, b): links of the sets of a group with its set nearest to the middle, from their differences alone."""
    nearest = groups.groupBy("hub").agg(F.min(F.struct("d", "id")).alias("m")).select("hub", F.col("m.id").alias("id"))
    nearest = groups.join(nearest, ["hub", "id"]).select("hub", F.struct("id", "n", "delta").alias("y"))
    both = groups.select("hub", F.struct("id", "n", "delta").alias("x")).join(nearest, "hub").where("x.id <> y.id")
    return both.where(F.size(either("x.delta", "y.delta")) <= F.expr(room("x", "y", percent))).select(F.col("x.id").alias("a"), F.col("y.id").alias("b"))


def facts_of(classes: DataFrame, groups: DataFrame) -> DataFrame:
    """(_id, component, hub, d) of the sets that have a class or a hub."""
    named = classes.withColumnRenamed("node", "id").join(groups.select("id", "hub", "d"), "id", "full_outer")
    return named.withColumnRenamed("id", "_id")


def difference_pairs(lists: DataFrame, facts: DataFrame, few: bool, percent: int) -> DataFrame:
    """(a, b, an, bn): pairs of sets of different classes that may link, with their sizes, but for sets of one hub whose differences share nothing and are too many."""
    known = lists.join(F.broadcast(facts) if few else facts, lists["id"] == facts["_id"], "left")
    # Sets further from the middle than half of what linked sets may differ in are all too far from each other: one class in the lists.
    heavy = F.expr(f"d * {100 + percent} > n * {100 - percent}")
    classed = known.withColumn("component", F.coalesce("component", "id")).select(
        "shingle", "id", "n", "at", "hub", "d", "component", F.when(heavy, -1 - F.col("hub")).otherwise(F.col("component")).alias("class"))
    counts = classed.groupBy("shingle", "class").agg(F.count("*").alias("k"))
    main = counts.groupBy("shingle").agg(F.max(F.struct("k", "class")).alias("m"), F.count("*").alias("classes"), F.sum("k").alias("k"))
    # Lists of one class are skipped whole.
    open_ = main.where("classes > 1").select("shingle", F.col("m.class").alias("main"), "k")
    # Long lists have blocks by size: sets link only within their own block and the two beside it.
    band = F.when(F.col("k") > BLOCKED, F.floor(F.log("n") / F.log(F.lit(100 / percent)))).otherwise(F.lit(0)).cast("int")
    held = classed.join(open_, "shingle").withColumn("band", band)
    beside = F.when(F.col("k") > BLOCKED, F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)).otherwise(F.array("band"))
    visitors = held.where("class <> main").withColumn("band", F.explode(beside))
    x, y = visitors.alias("x"), held.alias("y")
    return x.join(y, F.expr(
        f"x.shingle = y.shingle AND x.band = y.band AND x.class <> y.class AND (y.class = y.main OR x.id < y.id) AND x.component <> y.component "
        f"AND {can_link('x', 'y', percent)} AND NOT coalesce(x.hub = y.hub AND x.d + y.d > {room('x', 'y', percent)}, false)"
    )).select(F.expr("least(x.id, y.id)").alias("a"), F.expr("greatest(x.id, y.id)").alias("b"),
              F.expr("if(x.id < y.id, x.n, y.n)").alias("an"), F.expr("if(x.id < y.id, y.n, x.n)").alias("bn")
    ).groupBy("a", "b", "an", "bn").agg(F.count("*").alias("met")).where(f"met >= {first_meetings('an', 'bn', percent)}").drop("met")


def meeting_often(spark: SparkSession, pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b): the stored pairs whose prefixes share as many shingles as those of linked sets do."""
    ids = checkpointed(spark, pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct())
    sets = among(spark, sets.select("doc_id", "prefix"), "doc_id", ids)

    def run(batches):
        for b in sliced(batches):
            prefixes = [[np.frombuffer(p, np.int64) for p in b.column(i).to_pylist()] for i in (3, 4)]
            met = np.array([len(np.intersect1d(x, y, assume_unique=True)) for x, y in zip(*prefixes)], np.int64)
            yield b.select(["a", "b"]).filter(pa.array(met >= b.column(2).to_numpy()))

    first = pairs.join(sets.select(F.col("doc_id").alias("a"), F.col("prefix").alias("x")), "a")
    both = first.join(sets.select(F.col("doc_id").alias("b"), F.col("prefix").alias("y")), "b")
    least = F.expr(least_meetings("an", "bn", percent)).cast("long").alias("least")
    return both.select("a", "b", least, "x", "y").mapInArrow(run, "a bigint, b bigint")


def delta_pairs(groups: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """(a, b): pairs of sets of one hub and of different classes whose differences share enough to link.

    Sets differ in x.d + y.d - 2 * shared shingles. Differences are put in order,
    rare first, and meet in the part before the last shared ones they need: what
    many sets of a group lack or add is not looked up.
    """
    facts = groups.where("d > 0").join(classes, F.col("id") == classes["node"], "left")
    spread = facts.select("hub", "id", "n", "d", F.coalesce("component", "id").alias("class"), F.explode("delta").alias("shingle"))
    counts = spread.groupBy("hub", "shingle").agg(F.count("*").alias("k"), F.min("class").alias("low"), F.max("class").alias("high"))
    order = Window.partitionBy("id").orderBy("k", "shingle")
    placed = spread.join(counts, ["hub", "shingle"]).withColumn("at", F.row_number().over(order) - 1)
    lists = placed.where(f"low < high AND at * {percent} <= n * {100 - percent}").select("hub", "shingle", "id", "n", "d", "class", "at")
    x, y = lists.alias("x"), lists.alias("y")
    need = f"greatest(1, (x.d + y.d - {room('x', 'y', percent)} + 1) DIV 2)"
    return x.join(y, F.expr(
        f"x.hub = y.hub AND x.shingle = y.shingle AND x.id < y.id AND x.class <> y.class AND x.n * 100 >= y.n * {percent} AND y.n * 100 >= x.n * {percent} "
        f"AND x.at + {need} <= x.d AND y.at + {need} <= y.d AND 1 + least(x.d - x.at - 1, y.d - y.at - 1) + least(x.at, y.at) >= {need}"
    )).select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct()


def join(spark: SparkSession, docs: DataFrame, k: int = 3, percent: int = 90) -> DataFrame:
    """doc_id, n_shingles, component_id: one row per input row."""
    signs = checkpointed(spark, signatures(spark, docs, k, percent))
    filled = signs.where("n_shingles > 0 AND doc_id IS NOT NULL")
    chosen = checkpointed(spark, filled.groupBy("doc_id").agg(F.min("digest").alias("digest"), F.count("*").alias("rows")))
    sets = chosen.groupBy("digest").agg(F.min("doc_id").alias("set_id"))
    copies = chosen.join(sets, "digest").select("doc_id", "set_id", "rows").where("doc_id <> set_id OR rows > 1")
    copies = checkpointed(spark, copies)
    distinct = without(spark, filled, "doc_id", copies.select("doc_id"))
    # Of rows that share an id, those of the chosen set are alike.
    shared_ids = checkpointed(spark, copies.where("doc_id = set_id").select("doc_id"))
    if not shared_ids.isEmpty():
        alike = among(spark, filled, "doc_id", shared_ids).groupBy("doc_id").agg(F.min_by(F.struct("n_shingles", "digest", "prefix"), "digest").alias("row"))
        distinct = distinct.unionByName(alike.select("doc_id", "row.*"))
    lists = index(distinct)
    shared = lists.groupBy("shingle").agg(F.count("*").alias("k")).where("k > 1").select("shingle")
    lists = checkpointed(spark, lists.join(shared, "shingle", "left_semi"))
    hubs = checkpointed(spark, hub_pairs(lists, percent))
    seen = checkpointed(spark, compared(spark, docs, hubs, k, percent))
    links = seen.where("linked").select("a", "b")
    groups = checkpointed(spark, groups_of(seen))
    for _ in range(RAISES):
        groups = checkpointed(spark, raised(groups))
    sizes = distinct.select(F.col("doc_id").alias("id"), F.col("n_shingles").cast("int").alias("n"))
    groups = checkpointed(spark, centred(groups, sizes))
    links = checkpointed(spark, links.union(middle_links(groups, percent)))
    classes = checkpointed(spark, components(spark, links))
    facts = checkpointed(spark, facts_of(classes, groups))
    open_pairs = checkpointed(spark, difference_pairs(lists, facts, facts.count() <= BROADCAST_IDS, percent))
    rest = meeting_often(spark, open_pairs, distinct, percent).union(delta_pairs(groups, classes, percent)).distinct()
    more = compared(spark, docs, checkpointed(spark, rest), k, percent).where("linked").select("a", "b")
    final = checkpointed(spark, components(spark, links.union(more).union(copies.where("doc_id <> set_id").select("doc_id", "set_id"))))
    named = signs.join(final, signs["doc_id"] == final["node"], "left")
    return named.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def first_of_each(spark: SparkSession, docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The documents with the smallest id of each component; other columns stay.

    Of rows that repeat an id one stays, with the set that stood for the id in
    linking. Rows with a null id link with nothing and stay, all of them.
    """
    grouped = join(spark, docs.select("doc_id", "text"), k, percent).groupBy("doc_id", "component_id").agg(F.count("*").alias("_rows"))
    # Texts are dealt by id only where that cannot be told before: those of the ids to leave out, which are fewer than the others.
    left = checkpointed(spark, grouped.where("doc_id IS NOT NULL AND (component_id <> doc_id OR _rows > 1)"))
    kept = without(spark, docs, "doc_id", left.select("doc_id"))
    repeated = left.where("component_id = doc_id").select("doc_id")
    if repeated.isEmpty():
        return kept

    def ranked(text):
        from xxhash import xxh128_digest

        sets = [shingles(t, k) for t in text]
        return [(not len(x), xxh128_digest(x.tobytes())) for x in sets]

    names = docs.columns
    rows = docs.join(repeated, "doc_id", "left_semi").select(*names)
    rank = F.pandas_udf(lambda text: pd.DataFrame(ranked(text), columns=["empty", "digest"]), "empty boolean, digest binary")
    rows = rows.select(F.struct(*names).alias("row"), F.struct(rank("text").alias("set"), "text", F.to_json(F.struct(*names)).alias("all")).alias("rank"))
    first = rows.groupBy("row.doc_id").agg(F.min_by("row", "rank").alias("row")).select("row.*")
    return kept.unionByName(first)


SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s FROM w
), d AS (
  SELECT s, min(doc_id) AS set_id, len(s) AS n FROM (SELECT doc_id, list_sort(s) AS s FROM s) GROUP BY s
), m AS (
  SELECT a.doc_id, d.set_id FROM s a JOIN d ON list_sort(a.s) = d.s WHERE d.n > 0
), x AS (
  SELECT set_id, n, unnest(s) AS g FROM d WHERE n > 0
), links AS (
  SELECT a.set_id AS a, b.set_id AS b FROM x a JOIN x b ON a.g = b.g AND a.set_id < b.set_id AND a.n * 100 >= b.n * 90 AND b.n * 100 >= a.n * 90
  GROUP BY a.set_id, b.set_id, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))
), both_ways AS (
  SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach AS (
  SELECT a AS start, b AS node FROM both_ways
  UNION
  SELECT r.start, e.b FROM reach r JOIN both_ways e ON r.node = e.a
), component AS (
  SELECT start, least(start, min(node)) AS component FROM reach GROUP BY start
)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, coalesce(c.component, m.set_id, s.doc_id) AS component_id
FROM s LEFT JOIN m ON m.doc_id = s.doc_id LEFT JOIN component c ON c.start = m.set_id
"""
