"""Language identification with language-bitmask n-gram filters.

Learning counts the character n-grams of the training texts per language. An
n-gram belongs to a language if its share there is at least `KEEP` of its
largest share in any language, and was seen `LEAST` times. All pairs go into
bit-sliced Bloom filters: one table of cells, where each cell is a bit mask of
languages; an n-gram sets its language's bit in `HASHES` cells. The AND of
those cells gives, in one look-up, all languages that hold an n-gram.

Prediction counts, per language, the n-grams of the text whose mask has its bit
(popcount by language), corrects the count for the filter's false positives
(share of set bits of that language's slice to the power of the hashes), and
takes the language with the largest corrected share; the score is that share.
Ties go to the language that comes first by code point.

`und` with score 0 is given for a null text and for one without a letter. With
nothing to learn from, every text is `und`. The table is `CELLS` cells of one
64-bit word per 64 languages, whatever the corpus; what is shuffled are counts.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from zonecast.session import checkpointed

N = 3
CELLS = 1 << 20
HASHES = 3
KEEP = 0.1
LEAST = 3
FOLDS, HELD = 5, 0
BATCH_CHARS = 300_000


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """For each code point, whether it is a letter."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def codes_of(text: str) -> np.ndarray:
    """Lowered code points, each run of others than letters as one space, with a space at both ends."""
    points = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    keep = letters()[points]
    out = np.where(keep, points, np.uint32(32))
    gap = ~keep
    return out[~(gap & np.concatenate(([False], gap[:-1])))].astype(np.uint64)


def grams_of(codes: np.ndarray) -> np.ndarray:
    """Exact keys of the n-grams: 21 bits a character."""
    return (codes[:-2] << np.uint64(42)) | (codes[1:-1] << np.uint64(21)) | codes[2:]


def cells_of(grams: np.ndarray) -> list[np.ndarray]:
    """The cells of each n-gram in the Bloom filter, by double hashing."""
    x = grams * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    step = (x >> np.uint64(20)) | np.uint64(1)
    mask = np.uint64(CELLS - 1)
    return [((x + np.uint64(i) * step) & mask).astype(np.int64) for i in range(HASHES)]


def has_letter(codes: np.ndarray) -> bool:
    return bool((codes != 32).any())


def gram_counts(docs: DataFrame) -> DataFrame:
    """(lang, gram, n) over all given rows, combined inside each task before the shuffle."""

    def run(batches):
        held: dict[str, list] = {}
        size = 0

        def merged(keys: list, counts: list):
            keys, counts = np.concatenate(keys), np.concatenate(counts)
            distinct, where = np.unique(keys, return_inverse=True)
            return distinct, np.bincount(where, counts, len(distinct)).astype(np.int64)

        def out():
            for lang, pairs in held.items():
                keys, counts = merged([k for k, _ in pairs], [n for _, n in pairs])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(keys), pa.string()), pa.array(keys.astype(np.int64)), pa.array(counts)], ["lang", "gram", "n"]
                )

        for batch in batches:
            waiting: dict[str, list] = {}
            chars = 0

            def settle():
                nonlocal size
                for lang, parts in waiting.items():
                    keys, n = np.unique(np.concatenate(parts), return_counts=True)
                    held.setdefault(lang, []).append((keys, n))
                    size += len(keys)
                waiting.clear()

            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                codes = codes_of(text or "")
                if len(codes) >= N and has_letter(codes):
                    waiting.setdefault(lang, []).append(grams_of(codes))
                    chars += len(codes)
                if chars > BATCH_CHARS:
                    settle()
                    chars = 0
            settle()
            if size > 4_000_000:
                for lang in held:
                    held[lang] = [merged([k for k, _ in held[lang]], [n for _, n in held[lang]])]
                size = sum(len(p[0][0]) for p in held.values())
                if size > 2_000_000:
                    yield from out()
                    held.clear()
                    size = 0
        yield from out()

    parts = docs.select("lang", "text").mapInArrow(run, "lang string, gram bigint, n bigint")
    return parts.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


class Filters:
    """The cells, the languages of the bits, and the false positive rate of each."""

    def __init__(self, langs: list[str], cells: np.ndarray):
        self.langs, self.cells = langs, cells
        fill = [float(((cells[:, i // 64] >> np.uint64(i % 64)) & np.uint64(1)).mean()) for i in range(len(langs))]
        self.false = np.array(fill) ** HASHES

    def shares(self, grams: np.ndarray) -> np.ndarray:
        """Per language, the corrected share of the n-grams that it holds."""
        masks = None
        for at in cells_of(grams):
            masks = self.cells[at] if masks is None else masks & self.cells[at]
        hits = np.array([
            int(np.count_nonzero(masks[:, i // 64] & np.uint64(1 << (i % 64)))) for i in range(len(self.langs))
        ], float)
        shares = (hits / len(grams) - self.false) / np.maximum(1 - self.false, 1e-9)
        return np.clip(shares, 0, 1)

    def predict(self, text: str | None) -> tuple[str, float]:
        codes = codes_of(text or "")
        if not self.langs or not has_letter(codes):
            return "und", 0.0
        shares = self.shares(grams_of(codes))
        best = int(np.argmax(shares))
        return self.langs[best], float(shares[best])


def learn(spark: SparkSession, docs: DataFrame) -> Filters:
    """Filters from the rows with a language; the languages (distinct labels) are what the driver lists."""
    counts = checkpointed(spark, gram_counts(docs.where("lang IS NOT NULL")))
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    langs = sorted(r["lang"] for r in totals.collect())
    share = counts.join(totals, "lang").withColumn("share", F.col("n") / F.col("total"))
    top = share.groupBy("gram").agg(F.max("share").alias("top"))
    members = share.join(top, "gram").where((F.col("share") >= KEEP * F.col("top")) & (F.col("n") >= LEAST))
    number = {lang: i for i, lang in enumerate(langs)}
    words = max(1, -(-len(langs) // 64))

    def slices(batches):
        cells = np.zeros((CELLS, words), np.uint64)
        for batch in batches:
            bits = np.array([number[x] for x in batch.column(0).to_pylist()], np.int64)
            grams = batch.column(1).to_numpy().astype(np.uint64)
            for at in cells_of(grams):
                np.bitwise_or.at(cells, (at, bits // 64), np.left_shift(np.uint64(1), (bits % 64).astype(np.uint64)))
        for word in range(words):
            used = np.flatnonzero(cells[:, word])
            yield pa.RecordBatch.from_arrays(
                [pa.array(used), pa.array(np.full(len(used), word)), pa.array(cells[used, word].view(np.int64))], ["cell", "word", "mask"]
            )

    # At most CELLS rows per 64 languages reach the driver, whatever the corpus.
    parts = members.select("lang", "gram").mapInArrow(slices, "cell bigint, word bigint, mask bigint")
    found = parts.groupBy("cell", "word").agg(F.bit_or("mask").alias("mask")).toArrow()
    cells = np.zeros((CELLS, words), np.uint64)
    cells[found["cell"].to_numpy(), found["word"].to_numpy()] = found["mask"].to_numpy().view(np.uint64)
    return Filters(langs, cells)


def predict(spark: SparkSession, docs: DataFrame, filters: Filters) -> DataFrame:
    """doc_id, lang_pred, score: one row per input row, from the text alone."""
    shared = spark.sparkContext.broadcast(filters)

    def run(batches):
        for batch in batches:
            found = [shared.value.predict(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())],
                ["doc_id", "lang_pred", "score"],
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id bigint, lang_pred string, score double")


def held_out(folds: int = FOLDS, held: int = HELD):
    """Whether a document is kept from learning; a null id counts as held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % folds == held, F.lit(True))


def identify(spark: SparkSession, docs: DataFrame) -> DataFrame:
    filters = learn(spark, docs.where(~held_out()))
    return predict(spark, docs, filters).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
