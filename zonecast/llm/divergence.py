"""How far the sources of a language differ in their words, over run-length columns.

A group is a (language, source) with documents, a term a word of at least
`LEAST_DOCS` documents of the language. With N occurrences of kept terms in a
group and V kept terms in its language, a term with count c has the share
p = 1 + floor(10^9 * (c + 2) / (N + 2 * V)), and two shares differ by
f = floor((p - q)^2 / (p + q)).

1. Terms are counted per document in batches, combined before the shuffle and
   again after it.
2. The vocabulary is reordered: terms get their counts by source as a sorted
   list of (source, count), sources numbered from the largest down; equal lists
   become one row with the number of terms, and rows are sorted by list. So
   equal counts lie side by side, those of the large sources in few, long runs.
3. Each batch of the sorted rows is a stretch of the vocabulary. Every group's
   column over it is run-length encoded, zeros included. Shares are computed
   once per distinct count, not per term.
4. For a pair of groups the run boundaries are intersected, f is computed once
   per piece and multiplied by its length. Stretches add up to the pair's value.

Part `term` needs the terms themselves: those with a larger share in the group
than in the language, the ten of the largest f. The best ten of a group are
picked per task before they meet.

Nulls in text, lang and source count as empty strings; a group without kept
terms is still paired, with count 0 everywhere. If a language keeps no term
all its values are 0. Ties are ordered by the item's UTF-8 bytes. Rows that
repeat are documents of their own. Other columns, doc_id included, are not
read. An empty table gives an empty result. All arithmetic is on whole numbers.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from zonecast.session import checkpointed

LEAST_DOCS = 10
TOP = 10
SHARE = 10**9
#: Entries of a counting table that is handed on when it has grown to this.
HELD = 300_000
#: Documents after which a table is handed on at the latest.
HELD_DOCS = 1 << 20
#: A held entry is the occurrences plus this for each document; both fit into 63 bits for HELD_DOCS documents.
DOC = 1 << 40
#: Bytes of UTF-8 that belong to terms: letters of ASCII and all of other characters.
TERM = re.compile(rb"[A-Za-z\x80-\xff]+")


def term_counts(docs: DataFrame) -> DataFrame:
    """Occurrences and documents per (l, g, term) of rows (text, l, g), combined per task; rows may repeat a key."""
    names = ["l", "g", "term", "n", "docs"]

    def emit(held: dict) -> Iterator[pa.RecordBatch]:
        for (lang, group), terms in held.items():
            both = np.fromiter(terms.values(), dtype=np.int64, count=len(terms))
            keys = [pa.repeat(pa.scalar(k, pa.int64()), len(terms)) for k in (lang, group)]
            term = pa.array(list(terms), pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([*keys, term, pa.array(both & (DOC - 1)), pa.array(both // DOC)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, dict[bytes, int]] = {}
        size = read = 0
        for batch in batches:
            for text, lang, group in zip(*(batch.column(i).to_pylist() for i in range(3))):
                terms = held.setdefault((lang, group), {})
                before, get = len(terms), terms.get
                for term, n in Counter(TERM.findall(text.encode("utf-8", "surrogatepass").lower())).items():
                    terms[term] = get(term, 0) + n + DOC
                size, read = size + len(terms) - before, read + 1
                if size >= HELD or read >= HELD_DOCS:
                    yield from emit(held)
                    held, size, read = {}, 0, 0
        yield from emit(held)

    return docs.select("text", "l", "g").mapInArrow(run, "l bigint, g bigint, term string, n bigint, docs bigint")


def share(count: int, total: int, terms: int) -> int:
    return 1 + SHARE * (count + 2) // (total + 2 * terms)


def shares(counts: np.ndarray, total: int, terms: int) -> np.ndarray:
    """The shares of many counts; each distinct count is computed once, in whole numbers of any size."""
    kinds, which = np.unique(counts, return_inverse=True)
    return np.array([share(int(c), total, terms) for c in kinds], dtype=np.int64)[which]


def run_lengths(starts: np.ndarray, lengths: np.ndarray, counts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Runs over [0, size) as (first positions, counts) from stretches with counts above 0; the rest is 0."""
    ends = starts + lengths
    before = np.concatenate(([0], ends[:-1]))
    gaps = starts > before
    firsts = np.concatenate((starts, before[gaps]))
    values = np.concatenate((counts, np.zeros(gaps.sum(), dtype=np.int64)))
    last = int(ends[-1]) if len(ends) else 0
    if last < size:
        firsts, values = np.append(firsts, last), np.append(values, 0)
    order = np.argsort(firsts, kind="stable")
    firsts, values = firsts[order], values[order]
    new = np.concatenate(([True], values[1:] != values[:-1]))
    return firsts[new], values[new]


def distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """floor((p - q)^2 / (p + q)); shares stay under 2^30, so squares fit."""
    return (p - q) ** 2 // (p + q)


def pair_value(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], size: int) -> int:
    """Sum of f over [0, size) from two columns of runs (first positions, shares)."""
    cuts = np.union1d(a[0], b[0])
    p = a[1][np.searchsorted(a[0], cuts, side="right") - 1]
    q = b[1][np.searchsorted(b[0], cuts, side="right") - 1]
    return int((distance(p, q) * np.diff(np.append(cuts, size))).sum())


def stretch_values(offsets: np.ndarray, group: np.ndarray, count: np.ndarray, terms: np.ndarray, totals: np.ndarray,
                   vocabulary: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(group, other group, sum of f) for all pairs of groups over a stretch of the vocabulary.

    Row i of the stretch stands for `terms[i]` terms with counts `count[j]` in
    groups `group[j]`, j from `offsets[i]` to `offsets[i + 1]`; `totals` has the
    groups' N by number.
    """
    starts = np.concatenate(([0], np.cumsum(terms)))
    size = int(starts[-1])
    row = np.repeat(np.arange(len(terms)), np.diff(offsets))
    order = np.argsort(group, kind="stable")
    cuts = np.searchsorted(group[order], np.arange(len(totals) + 1))
    columns = []
    for s, total in enumerate(totals.tolist()):
        own = order[cuts[s]:cuts[s + 1]]
        firsts, counts = run_lengths(starts[row[own]], terms[row[own]], count[own], size)
        columns.append((firsts, shares(counts, total, vocabulary)))
    a, b = np.tril_indices(len(totals), -1)
    return a, b, np.array([pair_value(columns[i], columns[j], size) for i, j in zip(a, b)], dtype=np.int64)


_STRETCH = "l bigint, vectors array<array<struct<s: int, n: bigint>>>, terms array<bigint>"


def stretches(rows: DataFrame) -> DataFrame:
    """Sorted rows (l, vector, terms) as one row per batch and language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(langs[1:] != langs[:-1]) + 1).tolist(), len(langs)]
            for low, high in zip(cuts, cuts[1:]) if len(langs) else ():
                both = [pa.ListArray.from_arrays(pa.array([0, high - low], pa.int32()), batch.column(i).slice(low, high - low)) for i in (1, 2)]
                yield pa.RecordBatch.from_arrays([pa.array([int(langs[low])], pa.int64()), *both], names=["l", "vectors", "terms"])

    return rows.select("l", "vector", "terms").mapInArrow(run, _STRETCH)


def pair_sums(packs: DataFrame) -> DataFrame:
    """Sum of f per stretch and pair of groups; `packs` are stretches with the groups' totals and V of the language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang, vectors, terms, totals, v = (batch.column(i) for i in range(5))
            for i in range(batch.num_rows):
                rows = vectors[i].values
                cells = rows.flatten()
                found = stretch_values(
                    rows.offsets.to_numpy() - rows.offsets[0].as_py(), cells.field("s").to_numpy(), cells.field("n").to_numpy(),
                    terms[i].values.to_numpy(), totals[i].values.to_numpy(), v[i].as_py())
                yield pa.RecordBatch.from_arrays([pa.repeat(lang[i], len(found[0])), *[pa.array(x.astype(np.int64)) for x in found]], names=["l", "a", "b", "f"])

    return packs.select("l", "vectors", "terms", "totals", "v").mapInArrow(run, "l bigint, a bigint, b bigint, f bigint")


def divergence(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """(lang, source, part, item, value, rank) for all pairs of sources of a language and each group's leading terms."""
    texts = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source")])
    # Numbers stand for languages (l) and groups (g) in all that is shuffled by term.
    groups = checkpointed(spark, texts.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("_docs")).drop("_docs"))
    groups = checkpointed(spark, groups.withColumn("g", F.monotonically_increasing_id()))
    langs = groups.groupBy("lang").agg(F.min("g").alias("l"))
    groups = checkpointed(spark, groups.join(langs, "lang"))
    counted = term_counts(texts.join(groups, ["lang", "source"])).groupBy("l", "g", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    by_term = counted.groupBy("l", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("lang_n"), F.collect_list(F.struct("g", "n")).alias("by_group"))
    kept = checkpointed(spark, by_term.where(F.col("docs") >= LEAST_DOCS).drop("docs"))

    # Per language: V and N; per group: N and its number s in the language, the largest group first.
    by_lang = kept.groupBy("l").agg(F.count(F.lit(1)).alias("v"), F.sum("lang_n").alias("lang_total"))
    by_group = kept.select(F.explode("by_group").alias("e")).groupBy("e.g").agg(F.sum("e.n").alias("total"))
    sized = groups.select("l", "g").join(by_group, "g", "left").fillna(0, subset=["total"])
    tables = sized.groupBy("l").agg(F.sort_array(F.collect_list(F.struct((-F.col("total")).alias("less"), "g"))).alias("sorted"))
    tables = checkpointed(spark, tables.join(by_lang, "l", "left").select(
        "l", F.col("sorted.g").alias("gs"), F.transform("sorted", lambda e: -e["less"]).alias("totals"), F.coalesce("v", F.lit(0)).alias("v"), "lang_total"))
    numbers = tables.select("l", F.posexplode("gs").alias("s", "g"), "totals", "v", "lang_total")
    numbers = checkpointed(spark, numbers.withColumn("total", F.get("totals", "s")).drop("totals").join(groups.drop("l"), "g"))

    # Part pair: equal vectors of counts together, sorted by vector, run by run.
    cells = kept.select("l", "term", "lang_n", F.explode("by_group").alias("e")).select("l", "term", "lang_n", "e.g", "e.n")
    cells = checkpointed(spark, cells.join(numbers.select("g", "s", "total", "v", "lang_total"), "g"))
    vectors = cells.groupBy("l", "term").agg(F.sort_array(F.collect_list(F.struct("s", "n"))).alias("vector"))
    alike = vectors.groupBy("l", "vector").agg(F.count(F.lit(1)).alias("terms"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    columns = alike.repartitionByRange(parts, "l", "vector").sortWithinPartitions("l", "vector")
    packs = checkpointed(spark, stretches(columns))
    summed = pair_sums(packs.join(tables, "l")).groupBy("l", "a", "b").agg(F.sum("f").alias("f"))

    def named(number: str, name: str) -> DataFrame:
        return numbers.select("l", F.col("s").cast("long").alias(number), F.col("source").alias(name))

    found = summed.join(named("a", "x"), ["l", "a"]).join(named("b", "y"), ["l", "b"])
    ways = F.array(F.struct(F.col("x").alias("source"), F.col("y").alias("item")), F.struct(F.col("y").alias("source"), F.col("x").alias("item")))
    found = found.select("l", "f", F.explode(ways).alias("way")).select("l", "f", "way.source", "way.item")
    # The result itself has a row for every two sources of a language, also where no term is kept.
    every = groups.select("lang", "l", "source").join(groups.select("l", F.col("source").alias("item")), "l").where("source <> item")
    pairs = every.join(found, ["l", "source", "item"], "left").select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("f", F.lit(0)).cast("long").alias("value"))

    # Part term: all cells above the language's share; the leading ones get their names last.
    def share_of(count: str, total: str) -> Column:
        return F.expr(f"1 + CAST({SHARE} AS DECIMAL(10,0)) * CAST({count} + 2 AS DECIMAL(19,0)) DIV CAST({total} + 2 * v AS DECIMAL(19,0))")

    shared = cells.select("g", F.col("term").alias("item"), share_of("n", "total").alias("p"), share_of("lang_n", "lang_total").alias("q"))
    terms = shared.where("p > q").select("g", "item", F.expr("(p - q) * (p - q) DIV (p + q)").alias("value"))
    ranked = "row_number() OVER (PARTITION BY {} ORDER BY value DESC, item)"
    terms = terms.withColumn("rank", F.expr(ranked.format("g"))).where(f"rank <= {TOP}").join(groups.drop("l"), "g")
    pairs = pairs.withColumn("rank", F.expr(ranked.format("lang, source")))
    names = ["lang", "source", "part", "item", "value", F.col("rank").cast("int").alias("rank")]
    return pairs.select(names).unionByName(terms.withColumn("part", F.lit("term")).select(names))


_WORDS = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
SQL = f"""WITH docs AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
words AS (SELECT id, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORDS}')) AS term FROM docs),
kept AS (SELECT lang, term FROM words GROUP BY lang, term HAVING count(DISTINCT id) >= {LEAST_DOCS}),
held AS (SELECT w.lang, w.source, w.term, count(*) AS n FROM words w JOIN kept k ON k.lang = w.lang AND k.term = w.term GROUP BY 1, 2, 3),
grps AS (SELECT DISTINCT lang, source FROM docs),
vocabulary AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
cells AS (SELECT g.lang, g.source, k.term, coalesce(h.n, 0) AS n, sum(coalesce(h.n, 0)) OVER (PARTITION BY g.lang, g.source) AS total, v FROM grps g JOIN kept k ON k.lang = g.lang
 JOIN vocabulary y ON y.lang = g.lang LEFT JOIN held h ON h.lang = g.lang AND h.source = g.source AND h.term = k.term),
p AS (SELECT lang, source, term, n, 1 + (1000000000::HUGEINT * (n + 2)) // (total + 2 * v)::HUGEINT AS p FROM cells),
q AS (SELECT lang, term, 1 + (1000000000::HUGEINT * (n + 2)) // (total + 2 * v)::HUGEINT AS q FROM (SELECT lang, term, n, sum(n) OVER (PARTITION BY lang) AS total, v
 FROM (SELECT c.lang, c.term, sum(c.n) AS n, any_value(c.v) AS v FROM cells c GROUP BY 1, 2))),
sums AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value FROM grps a JOIN grps b ON a.lang = b.lang AND a.source <> b.source
 LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
terms AS (SELECT p.lang, p.source, 'term' AS part, p.term AS item, (p - q) * (p - q) // (p + q) AS value FROM p JOIN q ON q.lang = p.lang AND q.term = p.term WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM ranked WHERE part = 'pair' OR rank <= {TOP}"""
