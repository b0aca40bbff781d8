"""The manifest, the divergence audit and the vector near duplicates against plain versions."""

import zlib
from hashlib import sha256

import numpy as np
import pytest

from tests.llm.conftest import ODD
from zonecast.llm import divergence, manifest, neardup

IDS = [5, 3, None, 3, 7, 7, 12, 21, -4]
LANGS = ["en", "en", None, "de", "en", "en", None, "é", ""]


def H(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def part(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def level_up(nodes):
    return [H(*nodes[i:i + 2]) for i in range(0, len(nodes), 2)]


def tree(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append(level_up(levels[-1]))
    return levels


def plain_manifest(rows):
    leaf = lambda r, n: H(*map(part, (r["doc_id"], r["source"], r["lang"], n, r["text"])))
    langs = sorted({r["lang"] for r in rows}, key=lambda v: (v is not None, (v or "").encode()))
    trees = []
    for lang in langs:
        own = sorted((r["doc_id"] is not None, r["doc_id"] or 0, leaf(r, r["n_chars"]), i) for i, r in enumerate(rows) if r["lang"] == lang)
        trees.append((own, tree([x[2] for x in own])))
    top = tree([levels[-1][0] for _, levels in trees])
    out = []
    for t, (own, levels) in enumerate(trees):
        for at, (_, _, h, i) in enumerate(own):
            r, steps = rows[i], []
            for nodes, pos in [(x, at >> k) for k, x in enumerate(levels[:-1])] + [(x, t >> k) for k, x in enumerate(top[:-1])]:
                steps.append((pos % 2, nodes[pos ^ 1] if pos ^ 1 < len(nodes) else ""))
            shaken = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 7 == 0 and r["n_chars"] is not None
            got = leaf(r, r["n_chars"] + 1) if shaken else h
            for right, sibling in steps:
                got = H(sibling, got) if right else H(got, sibling)
            out.append((r["doc_id"], h, levels[-1][0], top[-1][0], H(*[s for _, s in steps]), got, got == top[-1][0]))
    return sorted(out, key=str)


COLUMNS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


@pytest.mark.parametrize("levels", [1, 3, 12])
def test_manifest_equals_a_plain_one(spark, docs, monkeypatch, levels):
    monkeypatch.setattr(manifest, "LEVELS", levels)
    texts = ODD + [f"text {i % 5}" for i in range(60)]
    table = docs(texts, langs=LANGS + ["en"] * 60, ids=IDS + [i % 23 for i in range(60)], extra=True)
    got = manifest.audit(spark, table).select(COLUMNS).collect()
    assert sorted(map(tuple, got), key=str) == plain_manifest([r.asDict() for r in table.collect()])


def test_manifest_of_one_and_of_no_document(spark, docs):
    (row,) = manifest.audit(spark, docs(["a"], ids=[1])).collect()
    assert row["leaf"] == row["subroot"] == row["root"] and row["proof_sha256"] == H() and row["verified"]
    assert manifest.audit(spark, docs([])).count() == 0


def test_partitions_fetch_only_what_their_leaves_do_not_give(spark, docs, monkeypatch):
    assert manifest.missing([0, 1, 2, 3], 8) == [(2, 1)]
    assert manifest.missing(range(8), 8) == []
    assert manifest.missing([0, 5], 8) == [(0, 1), (0, 4), (1, 1), (1, 3)]
    assert manifest.missing([4], 5) == [(2, 0)]
    monkeypatch.setattr(manifest, "LEVELS", 2)
    table = docs([f"t {i}" for i in range(50)])
    whole = {r["doc_id"]: r for r in manifest.audit(spark, table).collect()}
    built = manifest.build(spark, table)
    some = manifest.proofs(spark, built, "doc_id % 3 = 1").drop("siblings").collect()
    assert len(some) == 17 and all(r == whole[r["doc_id"]] for r in some)


# Divergence -------------------------------------------------------------------


def plain_divergence(rows):
    import re
    from collections import Counter

    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    counts, seen = {}, Counter()
    for r in rows:
        lang, source = r["lang"] or "", r["source"] or ""
        words = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (r["text"] or "").translate(lower))
        counts.setdefault((lang, source), Counter()).update(words)
        seen.update((lang, w) for w in set(words))
    out = []
    for lang in {g[0] for g in counts}:
        kept = sorted(w for (at, w), n in seen.items() if at == lang and n >= 10)
        own = {s: c for (at, s), c in counts.items() if at == lang}
        whole = sum(own.values(), Counter())

        def p(c):
            total = sum(c[w] for w in kept)
            return {w: 1 + 10**9 * (c[w] + 2) // (total + 2 * len(kept)) for w in kept}

        f = lambda a, b: (a - b) ** 2 // (a + b)
        shares, q = {s: p(c) for s, c in own.items()}, p(whole)
        for s in own:
            pairs = [(-sum(f(shares[s][w], shares[o][w]) for w in kept), o) for o in own if o != s]
            terms = [(-f(shares[s][w], q[w]), w) for w in kept if own[s][w] and shares[s][w] > q[w]]
            for name, found in (("pair", sorted(pairs, key=lambda x: (x[0], x[1].encode()))), ("term", sorted(terms, key=lambda x: (x[0], x[1].encode()))[:10])):
                out += [(lang, s, name, item, -v, k + 1) for k, (v, item) in enumerate(found)]
    return sorted(out)


def test_divergence_equals_a_plain_version(spark, docs, monkeypatch):
    monkeypatch.setattr(divergence, "HELD", 50)
    rng = np.random.default_rng(3)
    texts, langs, sources = [], [], []
    for i in range(300):
        words = [f"W{'abcdefghijklmnopqrstuvwxyz'[k % 26]}{'é' * (k // 26)}" for k in rng.zipf(1.4, 30) % 60]
        texts.append(" ".join(words))
        langs.append([None, "en", "en", "de"][i % 4])
        sources.append([None, "a", "b", "é", "zz", ""][int(rng.integers(6))])
    texts += [None, "", "\x00!1", "same same", "same same", "LONG é " * 20_000]
    langs += ["en", "xx", "xx", "xx", "xx", "en"]
    sources += ["empty", "s", "t", "s", None, "a"]
    table = docs(texts, langs, sources, extra=True)
    got = divergence.divergence(spark, table).select("lang", "source", "part", "item", "value", "rank").collect()
    assert sorted(map(tuple, got)) == plain_divergence([r.asDict() for r in table.collect()])
    assert divergence.divergence(spark, docs([])).count() == 0


def test_runs_and_their_pieces_give_the_sum_over_terms():
    rng = np.random.default_rng(1)
    a, b = np.sort(rng.integers(0, 4, 200)), rng.integers(0, 3, 200)
    p, q = divergence.shares(a, 500, 200), divergence.shares(b, 400, 200)
    columns = []
    for counts, shared in ((a, p), (b, q)):
        some = np.flatnonzero(counts)
        firsts, values = divergence.run_lengths(some, np.ones(len(some), dtype=np.int64), counts[some], 200)
        assert (np.repeat(values, np.diff(np.append(firsts, 200))) == counts).all() and (np.diff(values) != 0).all()
        columns.append((firsts, shared[firsts]))
    assert divergence.pair_value(*columns, 200) == divergence.distance(p, q).sum()


# Vectors ----------------------------------------------------------------------


def plain_vectors(rows):
    good, near = [], []
    for i, (_, e) in enumerate(rows):
        if e and all(v is not None and np.isfinite(v) for v in e) and any(e):
            good.append(i)
    links = {i: set() for i in range(len(rows))}
    for i in good:
        for j in good:
            if i < j and len(rows[i][1]) == len(rows[j][1]):
                x, y = np.array(rows[i][1]), np.array(rows[j][1])
                x, y = x / abs(x).max(), y / abs(y).max()
                if x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.95:
                    near.append((i, j))
                    links[i].add(j)
                    links[j].add(i)
    out = []
    for i, (vec_id, _) in enumerate(rows):
        seen, left = {i}, [i]
        while left:
            new = links[left.pop()] - seen
            seen |= new
            left += new
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        least = min(ids) if ids else None
        out.append((vec_id, len(links[i]), least, vec_id == least))
    return sorted(out, key=str), near


def vector_rows(rng, width):
    base = rng.normal(size=(40, width)) * np.linspace(3, 0.2, width)
    rows = [list(map(float, v)) for v in base]
    for k in range(60):  # near copies around the threshold, and chains of them
        rows.append(list(map(float, base[k % 7] + rng.normal(size=width) * rng.choice([0.05, 0.3, 0.6]))))
    rows += [rows[0]] * 5 + [[v * 3 for v in rows[1]], [v * 1e200 for v in rows[2]], [-v for v in rows[3]]]
    rows += [None, [], [0.0] * width, [float("nan")] * width, [float("inf")] + [1.0] * (width - 1), [None] + [1.0] * (width - 1), rows[0][:-1], [1.0], [2.0]]
    ids = [None if i % 29 == 5 else i // 2 if i > 90 else i for i in range(len(rows))]
    return list(zip(ids, rows))


@pytest.mark.parametrize("width, tile, block", [(5, 16, 4), (40, 32, 32), (40, 4096, 1024)])
def test_vector_links_equal_brute_force(spark, monkeypatch, width, tile, block):
    monkeypatch.setattr(neardup, "TILE", tile)
    monkeypatch.setattr(neardup, "BLOCK", block)
    rows = vector_rows(np.random.default_rng(width + tile), width)
    table = spark.createDataFrame([(i, e, "x", "y") for i, e in rows], "vec_id bigint, embedding array<double>, label string, digest string").repartition(3)
    got = neardup.near_duplicates(spark, table).collect()
    want, near = plain_vectors(rows)
    assert near and sorted(map(tuple, got), key=str) == want


def test_no_vectors(spark):
    empty = spark.createDataFrame([], "vec_id bigint, embedding array<float>")
    assert neardup.near_duplicates(spark, empty).count() == 0
    odd = spark.createDataFrame([(1, None), (None, [0.0]), (1, [])], "vec_id bigint, embedding array<float>")
    assert sorted(map(tuple, neardup.near_duplicates(spark, odd).collect()), key=str) == [(1, 0, 1, True), (1, 0, 1, True), (None, 0, None, True)]


def test_bounds_give_pairs_up_before_all_dimensions_are_read():
    rng = np.random.default_rng(0)
    whole = rng.normal(size=(200, 64)) * np.linspace(3, 0.1, 64)
    whole /= np.linalg.norm(whole, axis=1, keepdims=True)
    rest = [np.sqrt((whole[:, e:] ** 2).sum(axis=1)) for e in (16, 32, 48, 64)]
    block = {"turned": whole, "rest": rest, "raw": whole, "dims": np.full(200, 64)}
    reachable = whole[:, :16] @ whole[:, :16].T + np.outer(rest[0], rest[0]) >= 0.95
    assert reachable.mean() < 0.05
    assert (neardup.linked(block, block, 0.95) == (whole @ whole.T >= 0.95)).all()


def test_far_tiles_are_not_paired(spark):
    rows = [(i, i * 4096, [x, 0.0], [x + 0.1, 0.1]) for i, x in enumerate((-0.9, -0.8, -0.2, 0.1, 0.7))]
    boxes = spark.createDataFrame(rows, "tile bigint, first bigint, low array<double>, high array<double>")
    pairs = {tuple(r) for r in neardup.tile_pairs(boxes, 0.95).collect()}
    assert pairs == {(i, i) for i in range(5)} | {(0, 1), (2, 3)}
