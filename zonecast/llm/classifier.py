"""Quality classifier: ordinal cumulative-link regression on graded ratings.

Ratings are grades 0..G-1. One weight per hashed feature is shared by all
grades; ordered thresholds turn the sum into tail probabilities,
P(grade >= g) = sigmoid(sum - threshold g), g = 1..G-1. The expected grade is
the sum of the tails. Documents are selected by the tail of one grade.

Features are the distinct lower-cased words, stripped of signs at both ends,
their beginnings, and a few marks for the shares of signs, capitals and separators, hashed to
`BUCKETS` weights. The fit takes a sample of at most about `SAMPLE` rated
documents, chosen by the hash of their id (a documented bound for fitting only);
scoring covers every row. Each step of the fit sums gradients per partition on
the cluster; the driver holds the weights. Features in under a share `LEAST` of
the sampled documents, in fewer than three, or in over a share `MOST`, which tell
no documents apart, get no weight. A mark is hashed `MARKED` times, so that it
weighs as much as several words.

A null text has no features and gets the grade of the thresholds alone. Ratings
without a document, null ratings and null ids are not learned from; a document
rated more than once counts once per rating. With no rating at all, every score
is 0 and nothing is selected.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from zonecast.session import checkpointed

BUCKETS = 1 << 17
SAMPLE = 20_000
LEAST = 0.003
MOST = 0.4
STEPS = 40
RATE = 0.2
DECAY = 2e-3
FOLDS, HELD = 5, 0

MARKED = 4
#: Lengths in bytes of the beginnings of words that are features too.
PREFIXES = (5, 6, 7)
EDGE = b".,;:!?\"'()[]{}|*#$%&<>-_/\\="
SIGNS = "#*$%&|<>!"


def share_mark(name: str, part: int, whole: int) -> set[bytes]:
    """Features for the size class of a share."""
    share = part / max(whole, 1)
    step = sum(share > x for x in (0, 0.005, 0.02, 0.05, 0.1, 0.3))
    return {f"\x00{name}{step} {i}".encode() for i in range(MARKED)}


def features(text: str | None) -> set[int]:
    """Hashed features of a text."""
    if not text:
        return set()
    words = {w.strip(EDGE) for w in set(text.encode("utf-8", "surrogatepass").lower().split())}
    begun = set()
    for n in PREFIXES:
        begun |= {b"\x01" + w[:n] for w in words if len(w) > n}
    capitals = len(text) - len(text.translate(_NO_CAPITALS))
    words |= share_mark("signs", sum(map(text.count, SIGNS)), len(text)) | share_mark("bars", text.count("|"), len(text))
    words |= share_mark("capitals", capitals, len(text)) | share_mark("kinds", len(words), len(text))
    return {zlib.crc32(w) % BUCKETS for w in words | begun}


_NO_CAPITALS = dict.fromkeys(range(ord("A"), ord("Z") + 1))


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def tails(total: float, thresholds: np.ndarray) -> np.ndarray:
    return sigmoid(total - thresholds)


def gradient(flat: np.ndarray, lengths: np.ndarray, grades: np.ndarray, weights: np.ndarray, thresholds: np.ndarray):
    """Sum over rows of the gradient of the negative log likelihood of cumulative links, and that likelihood.

    `flat` has the features of all rows one after the other, `lengths` how many each has.
    """
    row = np.repeat(np.arange(len(lengths)), lengths)
    total = np.bincount(row, weights[flat], len(lengths))
    edges = np.concatenate(([-np.inf], thresholds, [np.inf]))
    upper, lower = sigmoid(edges[grades + 1] - total), sigmoid(edges[grades] - total)
    upper[grades == len(thresholds)], lower[grades == 0] = 1.0, 0.0
    p = np.maximum(upper - lower, 1e-12)
    du, dl = upper * (1 - upper), lower * (1 - lower)
    by_total = (du - dl) / p
    out_w = np.bincount(flat, by_total[row], len(weights))
    out_t = np.zeros(len(thresholds))
    for g in range(len(thresholds)):
        out_t[g] = -(du / p)[grades == g].sum() + (dl / p)[grades == g + 1].sum()
    return out_w, out_t, float(-np.log(p).sum())


class Model:
    def __init__(self, weights: np.ndarray, thresholds: np.ndarray):
        self.weights, self.thresholds = weights, thresholds

    def total(self, text: str | None) -> float:
        found = features(text)
        return float(self.weights[np.fromiter(found, np.int64, len(found))].sum())


def sample_of(rated: DataFrame, sample: int) -> DataFrame:
    """About `sample` rows by the hash of their id, or all if there are no more."""
    n = rated.count()
    return rated if n <= sample else rated.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(1_000_000 * sample / n))


def fit(spark: SparkSession, rated: DataFrame, grades: int, sample: int = SAMPLE, steps: int = STEPS) -> Model | None:
    """A model from rows (doc_id, text, grade), grade in 0..grades-1."""
    rated = rated.where("grade IS NOT NULL AND doc_id IS NOT NULL")

    def featurize(batches):
        for b in batches:
            found = [sorted(features(t)) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.list_(pa.int32())), b.column(2)], ["doc_id", "f", "grade"])

    rows = checkpointed(spark, sample_of(rated, sample).select(F.col("doc_id").cast("long"), "text", F.col("grade").cast("long"))
                        .mapInArrow(featurize, "doc_id bigint, f array<int>, grade bigint"))
    counts = {r["grade"]: r["n"] for r in rows.groupBy("grade").agg(F.count("*").alias("n")).collect()}
    n = sum(counts.values())
    if not n:
        return None
    # At most BUCKETS rows.
    common = rows.select(F.explode("f").alias("f")).groupBy("f").agg(F.count("*").alias("n")).where(F.col("n").between(max(3, LEAST * n), max(3, MOST * n))).toArrow()
    used = np.zeros(BUCKETS, bool)
    used[common["f"].to_numpy()] = True
    keep = spark.sparkContext.broadcast(used)

    def thin(batches):
        for b in batches:
            flat, lengths = b.column(0).flatten().to_numpy(), np.diff(b.column(0).offsets.to_numpy())
            stays = keep.value[flat]
            left = np.bincount(np.repeat(np.arange(len(lengths)), lengths), stays, len(lengths)).astype(np.int32)
            kept = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(left))).astype(np.int32)), pa.array(flat[stays]))
            yield pa.RecordBatch.from_arrays([kept, b.column(1)], ["f", "grade"])

    rows = checkpointed(spark, rows.select("f", "grade").mapInArrow(thin, "f array<int>, grade bigint"))
    # Thresholds of the grades' frequencies, half a row added so that no grade is impossible.
    below = np.cumsum([counts.get(g, 0) + 0.5 for g in range(grades)])[:-1] / (n + 0.5 * grades)
    thresholds, weights = np.log(below / (1 - below)), np.zeros(BUCKETS)
    first, second = [np.zeros(BUCKETS), np.zeros(grades - 1)], [np.zeros(BUCKETS), np.zeros(grades - 1)]
    for step in range(1, steps + 1):
        shared = spark.sparkContext.broadcast((weights, thresholds))

        def part(batches, shared=shared):
            w, t = shared.value
            sums, slope = np.zeros(BUCKETS), np.zeros(len(t))
            for b in batches:
                f = b.column(0)
                gw, gt, _ = gradient(f.flatten().to_numpy(), np.diff(f.offsets.to_numpy()), b.column(1).to_numpy(), w, t)
                sums += gw
                slope += gt
            yield pa.RecordBatch.from_arrays([pa.array([sums.tobytes()]), pa.array([slope.tobytes()])], ["w", "t"])

        # One row of fixed size per partition of the bounded sample.
        got = rows.select("f", "grade").mapInArrow(part, "w binary, t binary").toArrow()
        parts = sorted(zip(got["w"].to_pylist(), got["t"].to_pylist()), key=lambda x: x[1])
        slopes = [
            np.where(used, sum(np.frombuffer(w) for w, _ in parts) / n + DECAY * weights, 0.0), sum(np.frombuffer(t) for _, t in parts) / n,
        ]
        rate = RATE * (1 - (step - 1) / steps)
        for i, x in enumerate((weights, thresholds)):
            first[i] = 0.9 * first[i] + 0.1 * slopes[i]
            second[i] = 0.99 * second[i] + 0.01 * slopes[i] ** 2
            x -= rate * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.99**step)) + 1e-6)
        thresholds.sort()
    return Model(weights, thresholds)


def grade(spark: SparkSession, docs: DataFrame, model: Model | None, least_grade: int, cut: float = 0.5) -> DataFrame:
    """expected_grade, tail (probability of `least_grade` or better) and selected: one row per input row."""
    shared = spark.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        for b in batches:
            if m is None:
                expected = tail = [0.0] * b.num_rows
            else:
                p = [tails(m.total(t), m.thresholds) for t in b.column(1).to_pylist()]
                expected, tail = [float(x.sum()) for x in p], [float(x[least_grade - 1]) for x in p]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(expected, pa.float64()), pa.array(tail, pa.float64()), pa.array([t >= cut for t in tail], pa.bool_())],
                ["doc_id", "expected_grade", "tail", "selected"],
            )

    schema = "doc_id bigint, expected_grade double, tail double, selected boolean"
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)


def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % FOLDS == HELD, F.lit(True))


def ratings(labels: DataFrame) -> DataFrame:
    """Grades of the labels: 0 toxic, 1 poor, 2 good; null where a label is missing."""
    rated = F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).when((F.col("quality") == 1) & (F.col("toxic") == 0), 2)
    return labels.select("doc_id", rated.alias("grade"))


def select_quality(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Learn from the rated documents outside the held-out fold and grade all documents."""
    texts = docs.select("doc_id", "text").where(~held_out())
    rated = ratings(labels).where("grade IS NOT NULL").join(texts, "doc_id")
    model = fit(spark, rated, 3)
    return grade(spark, docs, model, 2).select("doc_id", held_out().alias("held_out"), "expected_grade", "tail", "selected")
