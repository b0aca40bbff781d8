"""Benchmark decontamination with SimHash windows, in DataFrame functions only.

A document holds an item if one of its item-sized windows has a weighted
similarity of at least `LEAST` with it on shingles of five words (all words of
an item with fewer): the sum of the smaller by the sum of the larger weighted
counts. A shingle weighs 1 / number of different item texts that hold it, so that
what items share counts less and repeats of an item change nothing; a shingle of
no item weighs as much as the item's shingles on average.

1. Windows: such a window shares a shingle with the item, so positions that hold
   a shingle of some item are looked up first, and a window as long as the item
   is laid where the shingle stands at its place in the item. Inserted and
   missing words give a window each before and after.
2. Fingerprints: a 64-bit SimHash of each window and item. In it, shingles of no
   item weigh as much as the others of the window on average.
3. Multi-index: the fingerprint is cut into `RADIUS + 1` blocks. Two
   fingerprints within `RADIUS` bits agree in one block at least, so an equi-join
   on (length, block, value) finds all of them; the distance is checked after it.
   At a similarity of 0.8 the expected distance is under 10 bits, with a standard
   deviation under 3.
4. Verification: exact weighted similarity of window and item.

Words are runs of anything but ASCII white space, lower-cased. Null and short
texts hold nothing; null and empty items are held by nothing. Rows that repeat
an id are one document, which holds what any of its different texts holds; rows
without an id are told apart by their texts. Texts that repeat an item_id, or
have none, are items of their own, given by that id. Of equally similar windows
the first is given. Shingles
of the items are broadcast up to `BROADCAST_ROWS` of them, beyond that all
look-ups are shuffle joins. Other columns are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from zonecast.session import checkpointed

K = 5
LEAST = 0.8
RADIUS = 20
BITS = 64
BROADCAST_ROWS = 1_000_000


def words_col(text: Column) -> Column:
    """The words of a text, lower-cased."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[\x20\x09-\x0D]+"), "")


def shingles_col(words: Column, k: int) -> Column:
    """Hashes of all k-word shingles, in order; none for fewer words."""
    starts = F.when(F.size(words) >= k, F.sequence(F.lit(0), F.size(words) - k)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(k)]))


def hinted(df: DataFrame, few: bool) -> DataFrame:
    return F.broadcast(df) if few else df


def fingerprints(parts: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, fp): SimHash over rows (keys, h, weight)."""
    votes = parts.groupBy(*keys).agg(*[
        F.sum(F.when(F.shiftright("h", b).bitwiseAND(F.lit(1)) == 1, F.col("weight")).otherwise(-F.col("weight"))).alias(f"v{b}") for b in range(BITS)
    ])
    bits = [F.when(F.col(f"v{b}") >= 0, F.shiftleft(F.lit(1).cast("long"), b)).otherwise(F.lit(0).cast("long")) for b in range(BITS)]
    return votes.select(*keys, reduce(lambda x, y: x.bitwiseOR(y), bits).alias("fp"))


def blocks_col(fp: Column) -> Column:
    """(block, value) of each of RADIUS + 1 blocks of almost equal width."""
    n = RADIUS + 1
    edges = [BITS * i // n for i in range(n + 1)]
    return F.array(*[
        F.struct(F.lit(i).alias("block"), F.shiftrightunsigned(fp, lo).bitwiseAND(F.lit((1 << (hi - lo)) - 1)).alias("value"))
        for i, (lo, hi) in enumerate(zip(edges, edges[1:]))
    ])


def item_shingles(items: DataFrame) -> DataFrame:
    """(item, wording, length, k, at, h): the shingles of each different text of each item_id, null ids alike.

    `item` holds the id and `wording`, which tells different texts apart.
    """
    words = items.select(F.col("item_id").cast("long").alias("id"), words_col(F.col("text")).alias("words")).where(F.size("words") > 0)
    worded = words.select(F.struct("id", F.xxhash64("words").alias("wording")).alias("item"), "words").dropDuplicates(["item"])
    cases = [F.when(F.size("words") == k, shingles_col(F.col("words"), k)) for k in range(1, K)]
    hashes = F.coalesce(*cases, shingles_col(F.col("words"), K))
    return worded.select(
        "item", F.col("item.wording").alias("wording"), F.size("words").alias("length"), F.least(F.size("words"), F.lit(K)).alias("k"), F.posexplode(hashes).alias("at", "h"))


def windows_of(docs: DataFrame, shingles: DataFrame, ks: list[int], few: bool) -> DataFrame:
    """(doc, start, length, k): item-sized windows laid over each shingle that an item has too."""
    out = None
    for k in ks:
        words = words_col(F.col("text"))
        spread = docs.select("doc", words.alias("w")).select("doc", F.size("w").alias("n"), F.posexplode(shingles_col(F.col("w"), k)).alias("p", "h"))
        met = spread.join(hinted(shingles.where(F.col("k") == k), few), "h")
        laid = met.select("doc", F.greatest(F.lit(0), F.least(F.col("p") - F.col("at"), F.col("n") - F.col("length"))).alias("start"), "length", "k")
        out = laid if out is None else out.union(laid)
    return out.distinct()


def doc_key() -> Column:
    """The id and a hash of the text, which tells texts of one id, or of none, apart."""
    return F.struct(F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("body"))


def found_windows(spark: SparkSession, docs: DataFrame, items: DataFrame, least: float = LEAST) -> DataFrame:
    """(doc, item, start, similarity) of all windows found, at least `least` similar."""
    docs = docs.select(doc_key().alias("doc"), "text")
    shingles = checkpointed(spark, item_shingles(items))
    few = shingles.count() <= BROADCAST_ROWS
    ks = [r["k"] for r in shingles.select("k").distinct().orderBy("k").collect()] or [K]
    # What several items hold weighs less.
    weights = checkpointed(spark, shingles.groupBy("h").agg((1 / F.count_distinct("wording")).alias("weight")))
    counts = shingles.groupBy("item", "length", "k", "h").agg(F.count("*").alias("c")).join(hinted(weights, few), "h")
    counts = checkpointed(spark, counts)
    prints = fingerprints(counts.withColumn("weight", F.col("weight") * F.col("c")), ["item", "length", "k"]).select(
        "item", "length", "fp", F.explode(blocks_col(F.col("fp"))).alias("b")).select("item", "length", "fp", "b.block", "b.value")

    windows = checkpointed(spark, windows_of(docs, shingles, ks, few))
    ids = checkpointed(spark, windows.select("doc").distinct())
    held = docs.join(hinted(ids, ids.count() <= BROADCAST_ROWS), "doc", "left_semi").dropDuplicates(["doc"])
    held = held.select("doc", words_col(F.col("text")).alias("w"))
    cut = held.join(windows, "doc").select("doc", "start", "length", "k", F.slice("w", F.col("start") + 1, F.col("length")).alias("w"))
    cases = [F.when(F.col("k") == k, shingles_col(F.col("w"), k)) for k in ks]
    key = ["doc", "start", "length"]
    spread = cut.select(*key, F.explode(F.coalesce(*cases)).alias("h"))
    parts = spread.groupBy(*key, "h").agg(F.count("*").alias("c")).join(hinted(weights, few), "h", "left")
    parts = checkpointed(spark, parts)
    # A null weight: a shingle of no item.
    mass = parts.groupBy(*key).agg(
        F.sum(F.col("c") * F.col("weight")).alias("known"), F.sum(F.when(F.col("weight").isNull(), F.col("c")).otherwise(0)).alias("foreign"),
        (F.sum(F.col("c") * F.col("weight")) / F.sum(F.when(F.col("weight").isNotNull(), F.col("c")))).alias("mean"))
    light = checkpointed(spark, mass.where("mean < 1 AND foreign > 0").select(*key, "mean"))
    votes = parts.join(hinted(light, light.count() <= BROADCAST_ROWS), key, "left")

    seen = fingerprints(votes.withColumn("weight", F.coalesce("weight", "mean", F.lit(1.0)) * F.col("c")), key)
    blocked = seen.select(*key, F.col("fp").alias("wfp"), F.explode(blocks_col(F.col("fp"))).alias("b")).select(*key, "wfp", "b.block", "b.value")
    near = blocked.join(hinted(prints, few), ["length", "block", "value"]).where(
        F.bit_count(F.col("wfp").bitwiseXOR(F.col("fp"))) <= RADIUS).select(*key, "item").distinct()

    item_mass = counts.groupBy("item").agg(
        F.sum(F.col("c") * F.col("weight")).alias("i_mass"), (F.sum(F.col("c") * F.col("weight")) / F.sum("c")).alias("i_mean"))
    common = (
        near.join(parts.select(*key, "h", "c", "weight"), key)
        .join(hinted(counts.select("item", "h", F.col("c").alias("ic")), few), ["item", "h"])
        .groupBy(*key, "item").agg(F.sum(F.least("c", "ic") * F.col("weight")).alias("both"))
    )
    w_mass = F.col("known") + F.col("foreign") * F.col("i_mean")
    scored = common.join(mass.drop("mean"), key).join(hinted(item_mass, few), "item").withColumn("w_mass", w_mass).withColumn(
        "similarity", F.round(F.col("both") / (F.col("w_mass") + F.col("i_mass") - F.col("both")), 6))
    return scored.where(F.col("similarity") >= least).select("doc", "item", "start", "similarity")


def contaminated(spark: SparkSession, docs: DataFrame, items: DataFrame, least: float = LEAST) -> DataFrame:
    """doc_id, item_id, start, similarity: the best window of each document and item it holds."""
    good = found_windows(spark, docs, items, least).select(F.col("doc.id").alias("doc_id"), F.col("item.id").alias("item_id"), "start", "similarity")
    best = good.groupBy("doc_id", "item_id").agg(F.max(F.struct("similarity", (-F.col("start")).alias("back"))).alias("m"))
    return best.select("doc_id", "item_id", (-F.col("m.back")).cast("long").alias("start"), F.col("m.similarity").alias("similarity"))


def clean_of(spark: SparkSession, docs: DataFrame, items: DataFrame) -> DataFrame:
    """The documents that hold no item; of an id all rows go if one holds an item, of rows without an id only those whose text does."""
    key = F.struct(F.col("doc.id").alias("id"), F.when(F.col("doc.id").isNull(), F.col("doc.body")).alias("body")).alias("_doc")
    bad = checkpointed(spark, found_windows(spark, docs, items).select(key).distinct())
    own = F.struct(F.col("doc_id").cast("long").alias("id"), F.when(F.col("doc_id").isNull(), F.xxhash64("text")).alias("body"))
    kept = docs.select(F.struct(*docs.columns).alias("row"), own.alias("_doc")).join(hinted(bad, bad.count() <= BROADCAST_ROWS), "_doc", "left_anti")
    return kept.select("row.*")


SQL = r"""
WITH items AS (
  SELECT row_number() OVER () AS item, item_id, w, len(w) AS length, least(len(w), 5) AS k FROM (
    SELECT DISTINCT item_id, regexp_extract_all(lower(coalesce(text, '')), '[^\x20\x09-\x0D]+') AS w FROM benchmark) WHERE len(w) > 0
), ish AS (
  SELECT item, w AS wording, length, k, o, array_to_string(w[o + 1:o + k], ' ') AS h
  FROM (SELECT *, unnest(range(0, length - k + 1)) AS o FROM items)
), weights AS (
  SELECT h, 1.0::DOUBLE / count(DISTINCT wording) AS weight FROM ish GROUP BY h
), icount AS (
  SELECT item, length, k, h, count(*) AS c, any_value(weight) AS weight FROM ish JOIN weights USING (h) GROUP BY ALL
), docs AS (
  SELECT row_number() OVER () AS doc, doc_id, regexp_extract_all(lower(coalesce(text, '')), '[^\x20\x09-\x0D]+') AS w FROM documents
), ks AS (
  SELECT DISTINCT k FROM items
), dsh AS (
  SELECT doc, n, k, p, array_to_string(w[p + 1:p + k], ' ') AS h
  FROM (SELECT doc, w, len(w) AS n, k, unnest(range(0, len(w) - k + 1)) AS p FROM docs, ks)
), windows AS (
  SELECT DISTINCT doc, greatest(0, least(p - o, n - length)) AS start, length, dsh.k
  FROM dsh JOIN ish ON dsh.h = ish.h AND dsh.k = ish.k
), wsh AS (
  SELECT doc, start, length, k, array_to_string(x[a + 1:a + k], ' ') AS h
  FROM (SELECT doc, start, length, k, x, unnest(range(0, len(x) - k + 1)) AS a
        FROM (SELECT windows.*, w[start + 1:start + length] AS x FROM windows JOIN docs USING (doc)))
), wcount AS (
  SELECT doc, start, length, k, h, count(*) AS c, any_value(weight) AS weight
  FROM wsh LEFT JOIN weights USING (h) GROUP BY ALL
), wmass AS (
  SELECT doc, start, length, coalesce(sum(c * weight), 0) AS known, coalesce(sum(c) FILTER (weight IS NULL), 0) AS strange FROM wcount GROUP BY ALL
), imass AS (
  SELECT item, sum(c * weight) AS mass, sum(c * weight) / sum(c) AS usual FROM icount GROUP BY ALL
), both_sides AS (
  SELECT doc, start, w.length, item, sum(least(w.c, i.c) * w.weight) AS common
  FROM wcount w JOIN icount i ON w.h = i.h AND w.length = i.length GROUP BY ALL
), scored AS (
  SELECT doc_id, item_id, start, round(common / (w.known + w.strange * i.usual + i.mass - common), 6) AS similarity
  FROM both_sides JOIN wmass w USING (doc, start, length) JOIN imass i USING (item) JOIN items USING (item) JOIN docs USING (doc)
)
SELECT doc_id, item_id, arg_min(start, (-similarity, start))::BIGINT AS start, max(similarity) AS similarity
FROM scored WHERE similarity >= 0.8 GROUP BY doc_id, item_id
"""
