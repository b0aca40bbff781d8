import random
import time

import numpy as np
import pytest
from conftest import TESTDATA  # noqa: F401
from xxhash import xxh128_digest
from zonecast.llm import links, setjoin
from zonecast.session import checkpointed

from .conftest import ODD


def brute(rows, k, percent):
    sets = {i: set(setjoin.shingles(t, k).tolist()) for i, t in rows if i is not None}
    top = {i: i for i in sets}

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1:]:
            same = len(sets[a] & sets[b])
            if same and 100 * same >= percent * (len(sets[a]) + len(sets[b]) - same):
                x, y = find(a), find(b)
                top[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def edited(base, edits, rng):
    words = list(base)
    for at in rng.sample(range(len(words)), edits):
        words[at] = f"x{rng.randrange(10**6)}"
    return " ".join(words)


def dense():
    """Groups around a few bases, at all distances, with edits shared by subgroups, cuts and additions."""
    rng = random.Random(7)
    texts = []
    for g in range(3):
        base = [f"w{g}-{rng.randrange(60)}" for _ in range(150)]
        texts += [edited(base, rng.randrange(0, 14), rng) for _ in range(70)]
        branch = edited(base, 6, rng).split()
        texts += [edited(branch, rng.randrange(0, 6), rng) for _ in range(40)]
        texts += [" ".join(base[:n]) for n in range(120, 150, 3)] + [" ".join(base[n:] + branch[:n // 2]) for n in range(0, 30, 3)]
        texts += [" ".join(base)] * 5
    texts += [" ".join(f"u{rng.randrange(50)}" for _ in range(rng.randrange(1, 12))) for _ in range(80)]
    rng.shuffle(texts)
    return texts


def test_matches_brute_force_in_dense_groups(spark, docs):
    texts = dense()
    table = docs(texts)
    for k, percent in ((3, 90), (5, 80), (2, 60)):
        want = brute(list(enumerate(texts)), k, percent)
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in setjoin.join(spark, table, k, percent).collect()}
        assert got == want, (k, percent)


def test_odd_rows(spark, docs):
    texts = [*ODD, None, "ONE"]
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in setjoin.join(spark, docs(texts, extra=True)).collect())
    want = brute(list(enumerate(texts)), 3, 90)
    assert got == [(i, *want[i]) for i in range(len(texts))]
    assert want[10] == (1, 3) and want[0] == (0, 0)


def test_repeated_and_null_ids(spark, docs):
    got = setjoin.join(spark, docs(["a b c d"] * 4, ids=[5, 5, 7, None])).collect()
    assert sorted((r["doc_id"] or 0, r["component_id"] or 0) for r in got) == [(0, 0), (5, 5), (5, 5), (7, 5)]


def test_empty_table(spark, docs):
    assert setjoin.join(spark, docs(["x"]).limit(0)).count() == 0


def test_first_of_each_keeps_one(spark, docs):
    texts = dense()
    want = brute(list(enumerate(texts)), 5, 80)
    kept = {r["doc_id"] for r in setjoin.first_of_each(spark, docs(texts)).collect()}
    assert kept == {c for _, c in want.values()}


def test_first_of_each_of_null_and_repeated_ids(spark, docs):
    words = [" ".join(f"{c}{i}" for i in range(30)) for c in "abcd"]
    texts = [words[0], words[0], words[0], words[1], words[2], words[2], "", words[3], words[3]]
    ids = [5, 5, 7, 5, None, None, 9, 9, None]
    got = sorted((r["doc_id"] or -1, r["text"]) for r in setjoin.first_of_each(spark, docs(texts, ids=ids, extra=True)).collect())
    stands = min(words[:2], key=lambda t: xxh128_digest(setjoin.shingles(t, 5).tobytes()))
    want = [(-1, words[2]), (-1, words[2]), (-1, words[3]), (5, stands), (9, words[3])]
    assert got == sorted(want if stands == words[0] else [*want, (7, words[0])])


def test_components_of_a_long_chain_and_a_star(spark):
    pairs = [(i, i + 1) for i in range(100)] + [(1000, 1000 + i) for i in range(1, 50)] + [(5, 5)]
    got = {r["node"]: r["component"] for r in links.components(spark, spark.createDataFrame(pairs, "a bigint, b bigint")).collect()}
    assert got == {**{i: 0 for i in range(101)}, **{1000 + i: 1000 for i in range(50)}}


def test_pairs_that_meet_once_are_not_looked_at(spark, docs, monkeypatch):
    """Many texts with one common passage, which too few counters do not show to be common: no pair of them is formed for its prefixes."""
    rng = random.Random(3)
    passage = next(p for p in (f"a{i} b c" for i in range(10**6)) if setjoin.shingles(p, 3)[0] < 2**64 // 1000)
    texts = [f"{passage} " + " ".join(f"u{rng.randrange(10**9)}" for _ in range(100)) for _ in range(40)]
    texts += [edited(texts[0].split()[:3] + [f"n{i}" for i in range(100)], 2, rng) for _ in range(3)]
    looked = []
    often = setjoin.meeting_often

    def counted(*given):
        looked.append(next(x for x in given if hasattr(x, "columns") and "an" in x.columns).count())
        return often(*given)

    monkeypatch.setattr(setjoin, "commonness", lambda *_: np.zeros(setjoin.SKETCH, np.uint8))
    monkeypatch.setattr(setjoin, "meeting_often", counted)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in setjoin.join(spark, docs(texts)).collect()}
    assert got == brute(list(enumerate(texts)), 3, 90)
    assert looked == [0]


@pytest.mark.parametrize("bits", [1 << 28, 1 << 16])
def test_many_ids_are_told_by_a_filter(spark, docs, monkeypatch, bits):
    """Beyond the broadcast texts are dealt by id only if the filter cannot tell; the results are those of the joins."""
    monkeypatch.setattr(setjoin, "FILTER_BITS", bits)
    monkeypatch.setattr(setjoin, "BROADCAST_IDS", 0)
    ids = [None, 5, 5, -1, 2**62, 7, *range(1000, 20_000)]
    table = docs(["x"] * len(ids), ids=ids)
    picked = checkpointed(spark, spark.range(1000, 20_000, 3).union(spark.createDataFrame([(5,), (-1,), (2**62,), (99,)], "id bigint")))
    wanted = {5, -1, 2**62, *range(1000, 20_000, 3)}
    key = lambda i: (i is None, i or 0)
    found = [r["doc_id"] for r in setjoin.among(spark, table, "doc_id", picked).collect()]
    assert sorted(found) == sorted(i for i in ids if i in wanted)
    rest = [r["doc_id"] for r in setjoin.without(spark, table, "doc_id", picked).collect()]
    assert sorted(rest, key=key) == sorted((i for i in ids if i not in wanted), key=key)
    sure = table.where(~setjoin.filter_of(spark, picked, picked.count())("doc_id")).count()
    assert sure > (0.95 if bits > 1 << 16 else 0.7) * len(rest)


def test_first_of_each_with_many_ids(spark, docs, monkeypatch):
    """With more ids than a broadcast takes, texts that stay are not dealt by id."""
    monkeypatch.setattr(setjoin, "BROADCAST_IDS", 0)
    texts = dense()[::4]
    ids = [*range(len(texts)), 3, 3, 10_000, 10_001, None, None]
    texts = [*texts, texts[3], "one two three four five six", texts[0], "seven words that are not found elsewhere", texts[1], None]
    table = docs(texts, ids=ids)
    own = {}
    for i, t in zip(ids, texts):
        if i is not None:
            own[i] = min((own[i], t), key=lambda t: xxh128_digest(setjoin.shingles(t, 5).tobytes())) if i in own else t
    want = brute(list(own.items()), 5, 80)
    kept = [r["doc_id"] for r in setjoin.first_of_each(spark, table).collect()]
    assert sorted(i for i in kept if i is not None) == sorted({c for _, c in want.values()})
    assert kept.count(None) == 2


def test_stored_tables_leave_no_shuffle_files(spark):
    """The shuffle files of a stored table go with its query, and the session's setting stays as it was."""
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffled():
        return {name for name in (str(f.getName()) for f in iterate(files.getAllFiles())) if name.startswith("shuffle_")}

    def iterate(seq):
        it = seq.iterator()
        while it.hasNext():
            yield it.next()

    setting = spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", None)
    before = shuffled()
    stored = checkpointed(spark, spark.range(10_000).selectExpr("id % 100 AS k").groupBy("k").count())
    for _ in range(50):
        if not (left := shuffled() - before):
            break
        time.sleep(0.1)
    assert not left
    assert stored.count() == 100
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", None) == setting
