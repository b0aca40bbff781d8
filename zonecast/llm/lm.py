"""Language-model scores from a class-based bigram model.

Words are sorted into classes by exchange clustering: the classes that maximise
the likelihood of the class bigrams. A text's probability is the product, over
its tokens, of the class transition and of the word's share in its class; a
text starts after an end token and ends with one.

* Counting: all training words, combined in each task before the shuffle.
* Exchange: the words seen at least `SEEN` times with a share of at least
  `FREQUENT` of all tokens are moved between `CLASSES` classes; end tokens and
  all other words have classes of their own. Word bigrams over these are counted
  once, from all training texts, and stored by word in blocks: all neighbours of
  a word lie in one row, so that rounds read them in place and shuffle nothing.
  In each round half of the words move to the class with the largest gain; a
  round whose moves together lose likelihood is tried again with half of them,
  and half of those, before it is given up.
* Scoring: words with a share of at least `FREQUENT` (at most 1 / FREQUENT of
  them, whatever the corpus) are looked up in a broadcast table; the counts of
  the others are joined on the cluster.

Smoothing: transitions add `ALPHA` to each count; shares inside a class add one
to each count, and the class of the remaining words keeps one count for words
never seen. Base score: add-one unigrams. Words are compared by 64-bit hash when
joined.

A null text counts as empty: one end token. Documents with a null id are held
out. Every row is scored by itself, also repeated ones. With no training text
all counts are 0.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from zonecast.llm.base import lower_words_of, sliced
from zonecast.session import checkpointed

FOLDS, HELD = 7, 2
FREQUENT = 1e-6
SEEN = 20
CLASSES = 64
ROUNDS = 6
HALVINGS = 3
ALPHA = 0.1
#: Training tokens and words to a block of the stored bigrams; a word's neighbours stay together.
BLOCK_TOKENS, BLOCK_WORDS = 500_000, 1_000
#: Stands for the end token among words; no word holds a space.
END = " "


def held_out():
    """Whether a document is kept from learning; one without an id is."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % FOLDS == HELD, F.lit(True))


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, c) over all given texts, with the end token."""

    def run(batches):
        held: Counter = Counter()

        def out():
            words = list(held)
            return pa.RecordBatch.from_arrays(
                [pa.array([w.decode("utf-8", "replace") for w in words], pa.string()), pa.array([held[w] for w in words], pa.int64())],
                ["word", "c"],
            )

        for batch in batches:
            texts = batch.column(0).to_pylist()
            held[END.encode()] += len(texts)
            for text in texts:
                held.update(lower_words_of(text))
            if len(held) > 1_000_000:
                yield out()
                held.clear()
        yield out()

    return docs.select("text").mapInArrow(run, "word string, c bigint").groupBy("word").agg(F.sum("c").alias("c"))


def bigram_counts(spark: SparkSession, docs: DataFrame, words: list[str]) -> DataFrame:
    """(a, b, n): numbers of neighbouring words; 0 is the end, 1 + i the i-th word, len + 1 any other."""
    shared = spark.sparkContext.broadcast(words)
    base = len(words) + 2

    def run(batches):
        number = Numbers({w.encode(): i + 1 for i, w in enumerate(shared.value)}, base - 1)
        waiting, size = [], 0

        def out():
            distinct, n = np.unique(np.concatenate(waiting), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(distinct // base), pa.array(distinct % base), pa.array(n)], ["a", "b", "n"])

        for batch in sliced(batches):
            for text in batch.column(0).to_pylist():
                ids = np.array([0, *map(number.__getitem__, lower_words_of(text)), 0], np.int64)
                waiting.append(ids[:-1] * base + ids[1:])
                size += len(ids)
                if size > 4_000_000:
                    yield out()
                    waiting, size = [], 0
        if waiting:
            yield out()

    return docs.select("text").mapInArrow(run, "a bigint, b bigint, n bigint").groupBy("a", "b").agg(F.sum("n").alias("n"))


def packed(bigrams: DataFrame, n_words: int, tokens: int) -> DataFrame:
    """The bigrams by word: blocks of words with the followers and predecessors of each.

    A block holds the words with one remainder, in ascending order, so that
    frequent ones are dealt evenly and a block has words of one parity. Numbers
    are little-endian in binary columns: `words`; `sizes`, how many followers and
    predecessors each has; `right` and `right_n`, the followers and how often
    they follow; `left` and `left_n` likewise; `last`, how often the end and any
    other word follow. The end and the other words come with each other only: the
    rest of their neighbours is stored with these.
    """
    blocks = 2 * max(1, -(-tokens // BLOCK_TOKENS), -(-n_words // (2 * BLOCK_WORDS)))

    def dealt(batches):
        held, size = [], 0

        def out():
            w, other, n = (np.concatenate(x) for x in zip(*held))
            block = (w >> 1) % blocks
            order = np.argsort(block, kind="stable")
            w, other, n = w[order], other[order], n[order]
            block, at = np.unique(block[order], return_index=True)
            cut = [*at.tolist(), len(w)]
            binary = lambda x: pa.array([x[i:j].tobytes() for i, j in zip(cut, cut[1:])], pa.binary())
            return pa.RecordBatch.from_arrays(
                [pa.array(block, pa.int64()), binary(w), binary(other), binary(n)], ["block", "w", "other", "n"])

        for batch in batches:
            a, b, n = (batch.column(i).to_numpy() for i in range(3))
            inner_a, inner_b = (a > 0) & (a <= n_words), (b > 0) & (b <= n_words)
            for right, w, other, mine in ((1, a, b, inner_a), (0, b, a, inner_b | ~inner_a)):
                held.append(((w[mine] * 2 + right).astype("<i4"), other[mine].astype("<i4"), n[mine].astype("<i8")))
                size += len(held[-1][0])
            if size > 1_000_000:
                yield out()
                held, size = [], 0
        if size:
            yield out()

    def joined(table):
        whole = lambda name, kind: np.frombuffer(b"".join(table[name].to_pylist()), kind)
        w, other, n = whole("w", "<i4"), whole("other", "<i4"), whole("n", "<i8")
        order = np.argsort(w, kind="stable")
        w, other, n = w[order], other[order], n[order]
        words = np.unique(w >> 1)
        place, right = np.searchsorted(words, w >> 1), w & 1 == 1
        sizes = np.bincount(place * 2 + (1 - (w & 1)), minlength=2 * len(words))
        last = np.zeros((len(words), 2), np.int64)
        for column, number in enumerate((0, n_words + 1)):
            mine = right & (other == number)
            last[place[mine], column] = n[mine]
        # Four bytes a count where they do.
        narrow = "<u4" if n.max(initial=0) < 1 << 32 else "<i8"
        row = {
            "words": words.astype("<i4"), "sizes": sizes.astype("<i4"), "right": other[right], "right_n": n[right].astype(narrow),
            "left": other[~right], "left_n": n[~right].astype(narrow), "last": last.astype("<i8"),
        }
        return pa.table({"block": table["block"][:1], **{k: pa.array([v.tobytes()], pa.binary()) for k, v in row.items()}})

    return bigrams.mapInArrow(dealt, "block bigint, w binary, other binary, n binary").groupBy("block").applyInArrow(
        joined, "block bigint, words binary, sizes binary, right binary, right_n binary, left binary, left_n binary, last binary")


def numbers(value, like=None) -> np.ndarray:
    """The numbers of a binary value: four bytes each, or eight where there are half as many as in `like`."""
    buffer = value.as_buffer()
    return np.frombuffer(buffer, "<i4" if like is None else "<u4" if buffer.size == like.nbytes else "<i8")


class Numbers(dict):
    """Numbers of words, with one for all others."""

    def __init__(self, known: dict, other: int):
        super().__init__(known)
        self.other = other

    def __missing__(self, key):
        return self.other


def xlogx(x: np.ndarray) -> np.ndarray:
    """x log x for counts; 0 for 0."""
    log = np.maximum(x, 1.0)
    np.log(log, out=log)
    log *= x
    return log


def likelihood(table: np.ndarray) -> float:
    """Log likelihood of the class bigrams, less a part that no exchange changes."""
    return float(xlogx(table).sum() - xlogx(table.sum(1)).sum() - xlogx(table.sum(0)).sum())


def best_class(left: np.ndarray, right: np.ndarray, own: int, table: np.ndarray, classes: int) -> int:
    """The class in which a word raises the likelihood most."""
    return int(best_classes(left[None], right[None], np.array([own]), table, classes)[0])


def best_classes(left: np.ndarray, right: np.ndarray, own: np.ndarray, table: np.ndarray, classes: int) -> np.ndarray:
    """The class in which each word raises the likelihood most.

    `right[i, c]` and `left[i, c]` count the followers and predecessors of word i
    in class c, `own[i]` is its class, `table` the class bigrams of all words.
    """
    known, found = xlogx(table), own.copy()
    for start in range(0, len(own), 32):
        part = slice(start, start + 32)
        r, l, k = right[part], left[part], own[part]  # noqa: E741
        i = np.arange(len(k))
        rest = np.repeat(table[None], len(k), 0)
        rest[i, k] -= r
        rest[i, :, k] -= l
        np.maximum(rest, 0, out=rest)
        # Only the row and the column of the word's class differ from those of the table.
        before = np.repeat(known[None], len(k), 0)
        before[i, k] = xlogx(rest[i, k])
        before[i, :, k] = xlogx(rest[i, :, k])
        rows, cols = rest.sum(2), rest.sum(1)
        # Classes that are no neighbours add nothing.
        change = np.zeros_like(rest)
        at, c = np.nonzero(r)
        change[at, :, c] = xlogx(rest[at, :, c] + r[at, c][:, None]) - before[at, :, c]
        gain = change.sum(2)
        change[:] = 0
        at, c = np.nonzero(l)
        change[at, c] = xlogx(rest[at, c] + l[at, c][:, None]) - before[at, c]
        gain += change.sum(1)
        gain -= xlogx(rows + r.sum(1)[:, None]) - xlogx(rows) + xlogx(cols + l.sum(1)[:, None]) - xlogx(cols)
        best = gain[:, :classes].argmax(1)
        found[part] = np.where(gain[i, best] > gain[i, k] + 1e-9, best, k)
    return found


def cluster(spark: SparkSession, blocks: DataFrame, n_words: int, classes: int = CLASSES, rounds: int = ROUNDS) -> np.ndarray:
    """Class of each number: words in 0..classes-1, the end in `classes`, all others in `classes + 1`.

    Words start dealt by rank. A round sums the neighbours of each word, from the
    blocks of `packed`, to their classes on the cluster; the driver keeps one
    class per word.
    """
    total = classes + 2
    of = np.array([classes, *(i % classes for i in range(n_words)), classes + 1], np.int64)

    def class_table(of: np.ndarray) -> np.ndarray:
        shared = spark.sparkContext.broadcast(of)

        def run(batches):
            now, t = shared.value, np.zeros(total * total)
            for batch in batches:
                for row in zip(*batch.columns):
                    words, sizes, left, last = map(numbers, row[:4])
                    mine = now[words]
                    t += np.bincount(now[left] * total + np.repeat(mine, sizes[1::2]), numbers(row[4], left), total * total)
                    for other, n in zip((classes, classes + 1), last.view("<i8").reshape(-1, 2).T):
                        t += np.bincount(mine * total + other, n, total * total)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(total * total)), pa.array(t)], ["k", "n"])

        rows = blocks.select("words", "sizes", "left", "last", "left_n").mapInArrow(run, "k bigint, n double").groupBy("k").agg(F.sum("n").alias("n")).toArrow()
        t = np.zeros(total * total)
        t[rows["k"].to_numpy()] = rows["n"].to_numpy()
        return t.reshape(total, total)

    table = class_table(of)
    reached = likelihood(table)
    for turn in range(rounds if n_words else 0):
        now, tab = spark.sparkContext.broadcast(of), spark.sparkContext.broadcast(table)

        def choose(batches, now=now, tab=tab):
            """The best class of the words of this round, whose neighbours are all in the block."""
            of = now.value
            for batch in batches:
                for row in zip(*batch.columns):
                    words, sizes, right, left = map(numbers, row[:4])
                    both = np.zeros((2, len(words) * total))
                    for side, (other, n) in enumerate(((right, row[4]), (left, row[5]))):
                        place = np.repeat(np.arange(len(words)), sizes[side::2])
                        both[side] = np.bincount(place * total + of[other], numbers(n, other), len(words) * total)
                    mine = (words > 0) & (words <= n_words)
                    after, ahead = both.reshape(2, len(words), total)[:, mine]
                    w = words[mine].astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(w), pa.array(best_classes(ahead, after, of[w], tab.value, classes))], ["w", "best"])

        moves = blocks.where(F.col("block") % 2 == turn % 2).select("words", "sizes", "right", "left", "right_n", "left_n").mapInArrow(
            choose, "w bigint, best bigint").toArrow()
        moved = moves.filter(pc.not_equal(moves["best"], pa.array(of[moves["w"].to_numpy()])))
        w, best = moved["w"].to_numpy(), moved["best"].to_numpy()
        # A multiplicative hash of the word's number: which half is tried does not follow the ranks.
        lot = (w * 2654435761 + turn) % (1 << 32)
        for half in range(HALVINGS + 1 if len(w) else 0):
            taken = lot < (1 << (32 - half))
            new = of.copy()
            new[w[taken]] = best[taken]
            new_table = class_table(new)
            new_reached = likelihood(new_table)
            if new_reached > reached:
                of, table, reached = new, new_table, new_reached
                break
    return of, table


def hashed(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word) - (1 << 63)


class Model:
    """What scoring needs: transitions, and per frequent word its class, counts and logarithms."""

    def __init__(self, rows, of: np.ndarray, table: np.ndarray, clustered: list[str], train_tokens: int, vocabulary: int, classes: int):
        total = classes + 2
        self.train_tokens, self.vocabulary = train_tokens, vocabulary
        self.start, self.other = classes, classes + 1
        smooth = table + ALPHA
        self.steps = np.log10(smooth / smooth.sum(1, keepdims=True))
        number = {w: i + 1 for i, w in enumerate(clustered)}
        in_class = np.zeros(total)  # tokens and kinds of words of each class
        kinds = np.zeros(total)
        for word, c in rows:
            if word in number:
                in_class[of[number[word]]] += c
                kinds[of[number[word]]] += 1
        end = next((c for word, c in rows if word == END), 0)
        self.rest_tokens = train_tokens - end - in_class.sum()
        self.rest_kinds = vocabulary - (end > 0) - kinds.sum() + 1
        # The end token has number 0; no word of a text is equal to it.
        self.words, cls, base, emit, count = {END.encode(): 0}, [classes], [self.base_of(end)], [0.0], [end]
        for word, c in rows:
            if word == END:
                continue
            self.words[word.encode("utf-8", "surrogatepass")] = len(cls)
            k = int(of[number[word]]) if word in number else self.other
            cls.append(k)
            count.append(c)
            base.append(self.base_of(c))
            emit.append(self.rest_of(c) if k == self.other else float(np.log10((c + 1) / (in_class[k] + kinds[k]))))
        self.cls, self.base, self.emit = np.array(cls + [self.other]), np.array(base + [0.0]), np.array(emit + [0.0])
        self.count = np.array(count + [0])

    def base_of(self, c):
        return float(np.log10((c + 1) / (self.train_tokens + self.vocabulary + 1)))

    def rest_of(self, c):
        return float(np.log10((c + 1) / (self.rest_tokens + self.rest_kinds)))


def score(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Base and model score of every document: one row per input row."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    training = docs.where(~held_out())
    counts = checkpointed(spark, word_counts(training))
    facts = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v"), F.max(F.when(F.col("word") == END, F.col("c")))).first()
    train_tokens, vocabulary = facts["n"], facts["v"] if facts["n"] else 0
    # At most 1 / FREQUENT words can have that share.
    frequent = [(r["word"], r["c"]) for r in counts.where(
        (F.col("c") >= FREQUENT * train_tokens) & (F.col("c") > 0)).orderBy(F.desc("c"), "word").toLocalIterator()]
    clustered = [w for w, c in frequent if w != END and c >= SEEN]
    blocks = checkpointed(spark, packed(bigram_counts(spark, training, clustered), len(clustered), train_tokens))
    of, table = cluster(spark, blocks, len(clustered), CLASSES)
    model = Model(frequent, of, table, clustered, train_tokens, vocabulary, CLASSES)
    shared = spark.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        last = len(m.cls) - 1
        number = Numbers(m.words, last)
        for batch in sliced(batches):
            # All tokens of the piece in a row; an end token closes each text.
            words, ends = [], []
            for text in batch.column(2).to_pylist():
                words += lower_words_of(text)
                words.append(END.encode())
                ends.append(len(words))
            ids, ends = np.fromiter(map(number.__getitem__, words), np.int64, len(words)), np.array(ends)
            starts = np.concatenate(([0], ends[:-1]))
            cls = m.cls[ids]
            before = np.concatenate(([m.start], cls[:-1]))
            before[starts] = m.start
            known = np.add.reduceat(((ids != last) & (m.count[ids] > 0)).astype(np.int64), starts)
            spans = list(zip(starts.tolist(), ends.tolist()))
            sums = lambda x, spans=spans: np.array([x[i:j].sum() for i, j in spans])
            rare, times, upto = [], [], [0]
            places = np.flatnonzero(ids == last)
            cuts = np.searchsorted(places, ends).tolist()
            places = places.tolist()
            for i, j in zip([0, *cuts], cuts):
                found = Counter([words[k] for k in places[i:j]])
                rare += map(hashed, found)
                times += found.values()
                upto.append(len(rare))
            offsets = pa.array(upto, pa.int32())
            yield pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(1), pa.array(ends - starts), pa.array(known), pa.array(sums(m.base[ids])),
                pa.array(sums(m.steps[before, cls]) + sums(m.emit[ids])),
                pa.ListArray.from_arrays(offsets, pa.array(rare, pa.int64())), pa.ListArray.from_arrays(offsets, pa.array(times, pa.int64())),
            ], ["doc_id", "held_out", "n", "known", "base", "score", "rare", "tf"])

    schema = "doc_id bigint, held_out boolean, n bigint, known bigint, base double, score double, rare array<bigint>, tf array<bigint>"
    # Numbered by the file and the place in it once written, so that a lost executor changes nothing.
    first = checkpointed(spark, docs.select("doc_id", held_out().alias("held_out"), "text").mapInArrow(run, schema)
                         .withColumn("row", F.monotonically_increasing_id()))

    hash_words = F.pandas_udf(lambda words: words.map(lambda w: hashed(w.encode("utf-8", "surrogatepass"))), "bigint")
    rest = counts.where((F.col("c") < FREQUENT * train_tokens)).select(hash_words("word").alias("h"), "c")
    pairs = first.select("row", F.explode(F.arrays_zip("rare", "tf")).alias("x")).select("row", F.col("x.rare").alias("h"), F.col("x.tf").alias("tf"))
    c = F.coalesce("c", F.lit(0))
    base_of = F.log10((c + 1) / F.lit(float(train_tokens + vocabulary + 1)))
    rest_of = F.log10((c + 1) / F.lit(float(model.rest_tokens + model.rest_kinds)))
    sums = pairs.join(rest, "h", "left").groupBy("row").agg(
        F.sum(F.when(c > 0, F.col("tf")).otherwise(0)).alias("r_known"),
        F.sum(F.col("tf") * base_of).alias("r_base"), F.sum(F.col("tf") * rest_of).alias("r_score"),
    )
    full = first.drop("rare", "tf").join(sums, "row", "left")
    total = lambda a, b: F.col(a) + F.coalesce(b, F.lit(0))
    return full.select(
        "doc_id", "held_out", F.col("n").alias("n_tokens"), total("known", "r_known").cast("long").alias("n_known"),
        F.lit(train_tokens).cast("long").alias("train_tokens"), total("base", "r_base").alias("base_score"), total("score", "r_score").alias("score"),
    ).withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))
