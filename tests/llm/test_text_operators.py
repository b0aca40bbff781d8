import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from check_queries import compare, connect
from zonecast.llm import base, chat, classifier, decontam, langid, lm, mixing, pii, queries, rules, tokens

from .conftest import ODD

SMALL = "/root/testdata/sf0.001"
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(?:\.[0-9]+){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def base_spans(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            bad = kind == "ip" and any(int(p) > 255 for p in m[0].split("."))
            bad |= kind == "card" and not (13 <= len(digits) <= 19 and pii.luhn(digits))
            bad |= kind == "phone" and not 9 <= len(digits) <= 15
            if not bad:
                out.append((kind, m.start(), m.end()))
    return out


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_matches_sql(spark, name):
    got = queries.QUERIES[name](spark, SMALL).toPandas()
    assert compare(got, connect(SMALL).execute(queries.ORACLES[name]).df()) == ""


# Personal data


def test_pii_base_spans_equal_the_patterns():
    rng = random.Random(3)
    for alphabet in ("0123456789.@+- ()ab", "a@.b-", "+12 ()-.", "0.12 55-"):
        for _ in range(4000):
            text = "".join(rng.choice(alphabet) for _ in range(rng.randrange(50)))
            assert [s for s in pii.find_spans(text) if s[0] in PATTERNS] == base_spans(text), text


def test_pii_method_adds_spans_and_masks():
    text = 'See ftp://bob:pw@host.org/x, mailto:a@b.co and IBAN: GB82 WEST 1234 5698 7654 32 end; token = "ab12cd34ef56".'
    found = {(k, text[s:e]) for k, s, e in pii.find_spans(text)}
    assert found >= {
        ("address", "ftp://bob:pw@host.org/x"), ("address", "mailto:a@b.co"), ("account", "GB82 WEST 1234 5698 7654 32"), ("account", "ab12cd34ef56"),
    }
    hidden = pii.masked(text)
    assert "WEST" not in hidden and "a@b" not in hidden and hidden.startswith("See [ADDRESS], [ADDRESS] and IBAN: [ACCOUNT] end;")
    assert pii.masked("a clean account of 12 items, no token at all") == "a clean account of 12 items, no token at all"
    assert pii.masked(None) is None


def test_pii_rows(spark, docs):
    rows = pii.find_pii(docs([*ODD, "a@b.cd 1.2.3.4"], extra=True)).orderBy("doc_id").collect()
    assert len(rows) == len(ODD) + 1 and rows[0]["base_sha256"] == hashlib.sha256(b"").hexdigest() and rows[-1]["spans"] == "email:0:6,ip:7:14"
    assert pii.find_pii(docs(["x"]).limit(0)).count() == 0


# Mixing


def test_mix_meets_targets(spark, docs):
    rng = random.Random(5)
    texts = ["w " * int(rng.lognormvariate(3, 1)) for _ in range(600)] + [None, ""] + ["same size text"] * 200
    sources = [rng.choice(["a", "b", "c", None, "hot", "hot", "hot"]) for _ in texts]
    table = docs(texts, sources=sources, extra=True)
    got = mixing.report(spark, table).toPandas()
    again = mixing.report(spark, table.repartition(7)).toPandas()
    key = ["doc_id", "taken"]
    assert len(got) == len(texts) and sorted(got[key].itertuples(index=False)) == sorted(again[key].itertuples(index=False))
    assert (got["taken"] <= 2 * got["size"]).all() and (got["taken"] % got["size"].where(got["size"] > 0, 1) == 0).all()
    got["source"] = [sources[i] or "~" for i in got["doc_id"]]
    by = got.groupby("source").agg(taken=("taken", "sum"), target=("target", "first"), size=("size", "sum"), given=("source_size", "first"))
    assert (by["size"] == by["given"]).all() and ((by["taken"] - by["target"]).abs() <= 3).all() and (by["target"] <= 2 * by["size"] + 1e-6).all()


def test_mix_targets_water_filling(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 100), (None, 1000), ("c", 50)], "source string, words bigint")
    # 1740 words: a is full at 20, b (2) at 200, c (1) at 100; null (5) gets the rest.
    assert mixing.targets(sizes) == pytest.approx({"a": 20, "b": 200, "c": 100, None: 1420})


def test_mix_of_nothing(spark, docs):
    assert mixing.report(spark, docs(["x"]).limit(0)).count() == 0
    assert [r["taken"] for r in mixing.report(spark, docs([None, ""])).collect()] == [0, 0]


def test_mix_extra_copies_are_exact_across_slices(spark, docs, monkeypatch):
    monkeypatch.setattr(mixing, "SLICE", 16)
    got = mixing.report(spark, docs(["a b"] * 500 + ["a b c"] * 500, sources=["p"] * 500 + ["q"] * 500)).toPandas()
    by = got.groupby("source_size").agg(taken=("taken", "sum"), target=("target", "first"))
    assert ((by["taken"] - by["target"]).abs() <= 3).all()


def test_mix_of_null_and_repeated_ids_meets_targets(spark, docs):
    texts = [f"a b {i % 50}" for i in range(300)] + ["c d"] * 200 + ["e f g h"] * 300 + [f"i {i % 3}" for i in range(200)]
    sources = ["null"] * 500 + ["repeated"] * 300 + ["mixed"] * 200
    ids = [None] * 500 + [7] * 300 + [i % 20 if i % 2 else None for i in range(200)]
    # One source is cut, one grows, one is full.
    got = mixing.report(spark, docs(texts, sources=sources, ids=ids).repartition(5)).toPandas()
    assert len(got) == len(texts)
    by = got.groupby("source_size").agg(taken=("taken", "sum"), target=("target", "first"))
    assert len(by) == 3 and ((by["taken"] - by["target"]).abs() <= 3).all()


# Tokens


def test_token_counts_equal_the_library(spark, docs):
    rng = random.Random(1)
    odd = "".join(map(chr, [0x558, 0x85, 0x1C, 0x2028, 0x3000, 0x200B, 0x1F600, 0x0660, 0xE9]))
    texts = [*ODD[:-1], "w " * 3000, "a<|endoftext|>b <|endoftext|>", "don't  we'll\n\n 've", "x\r\n\ty "] + [
        "".join(rng.choice("ab '19é\n .,<|>世" + odd) for _ in range(rng.randrange(60))) for _ in range(400)]
    got = tokens.count_tokens(spark, docs(texts, extra=True)).orderBy("doc_id").collect()
    library = tokens.tokenizer(tokens.vocabulary_path())
    for row, text in zip(got, texts):
        n = len(library.encode(text or "", add_special_tokens=False).ids)
        assert (row["n_tokens"], row["over_limit"], row["n_bytes"]) == (n, n > 1024, len((text or "").encode())), text


def test_whole_tokens_are_one_token():
    path = tokens.vocabulary_path()
    whole = tokens.whole_tokens(path)
    assert len(whole) > 40_000 and " the" in whole
    library = tokens.tokenizer(path)
    assert all(len(library.encode(t, add_special_tokens=False).ids) == 1 for t in list(whole)[:500])


# Rules


def test_rules_lines_and_documents(spark, docs):
    clean = "A plain line of ten words that all should keep here.\n"
    good = clean.replace("plain", "first") + clean.replace("plain", "second") + " ".join(f"w{i}" for i in range(60))
    junk = " ".join(f"w{i}***" for i in range(60))
    table = docs([good, junk, good + "\nHome\nAll rights reserved\n" + good.split("\n")[0], *ODD], extra=True)
    rows = rules.judge(table).orderBy("doc_id").collect()
    assert [r["kept"] for r in rows] == [True, False, True] + [False] * len(ODD)
    assert rows[2]["lost_lines"] == 3 and rows[2]["n_dup_lines"] == 1
    kept = {r["doc_id"]: r["text"] for r in rules.cleaned(table).collect()}
    assert kept[0] == good and kept[2] == good and set(kept) == {0, 2}


# Chat


def test_chat_round_trip_and_sharing(spark, monkeypatch):
    rng = random.Random(2)
    bits = ["<|", "<\\|", "<\\\\|", "|>", "<|im_end|>\n", "\\", "\n", "<|im_start|>user\n", "x", "é", "\\n"]
    talk = lambda n: "".join(rng.choice(bits) for _ in range(n))
    for _ in range(300):
        text = talk(12)
        assert chat.unescape(chat.escape(text)) == text and chat.role_back(chat.role_line(text)) == text and "<|" not in chat.escape(text)
    rows = []
    for c in range(120):
        first = "common start" if c % 3 else f"start {c}"
        rows += [(c, 0, "user", first), (c, 1, "assistant", talk(c % 7) if c % 5 else "same answer"), (c, 2, rng.choice(["user", None, "a\nb"]), None)]
        rows += [(c, 3 + i, "assistant", talk(4)) for i in range(c % 3)]
    rows += [(500, 1, "user", "copy"), (501, 1, "user", "copy"), (502, None, "user", ""), (502, None, "user", "")]
    turns = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").selectExpr("*", "'x' AS digest", "1 AS pack")
    want = {}
    for c in {r[0] for r in rows}:
        own = [(r or "", t or "") for _, _, r, t in sorted((x for x in rows if x[0] == c), key=lambda x: (x[1] or -1, x[2] or "", x[3] or ""))]
        loss = "".join(t for r, t in own if r == "assistant")
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        want[c] = (len(own), sha("".join(f"{r}\n{t}\n" for r, t in own)), len(loss), sha(loss), sum(len(chat.turn_text(r, t)) for r, t in own))
    for limit in (200, 100_000):
        packs, members = chat.format_chat(spark, turns, limit)
        got = {r["conv_id"]: tuple(r)[1:] for r in chat.read_back(packs, members).select(
            "conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars").collect()}
        assert got == want
        sizes = packs.selectExpr("length(text) AS n", "size(leaves) AS k").collect()
        assert all(s["n"] <= limit or s["k"] == 1 for s in sizes)
    assert max(s["k"] for s in sizes) > 50 and sum(s["n"] for s in sizes) < sum(w[4] for w in want.values())


def test_chat_hot_prompt_and_null_id(spark):
    prompt = "p" * 300
    rows = [(c, n, "system" if n == 0 else "user", prompt if n == 0 else f"question {c}") for c in range(400) for n in (0, 1)]
    rows += [(900, 0, "system", prompt), (901, 0, "user", "y" * 5000), (None, 0, "user", "only here")]
    turns = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    packs, members = chat.format_chat(spark, turns, 2000)
    packs = packs.selectExpr("text", "length(text) AS n", "size(leaves) AS k").collect()
    assert all(p["n"] <= 2000 or p["k"] == 1 for p in packs)
    hot = [p for p in packs if prompt in p["text"]]
    assert all(p["text"].count(prompt) == 1 for p in hot) and sum(p["k"] for p in hot) == 401
    own, above = len(chat.turn_text("user", "question 100")), len(chat.turn_text("system", prompt))
    assert len(hot) <= 400 // ((2000 - above) // own) + 3
    got = {r["conv_id"]: r["n_turns"] for r in chat.read_back(*chat.format_chat(spark, turns, 2000)).collect()}
    assert got == {**dict.fromkeys(range(400), 2), 900: 1, 901: 1, None: 1}


def test_chat_of_nothing(spark):
    turns = spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")
    assert chat.read_back(*chat.format_chat(spark, turns)).count() == 0


# Language model


def test_lm_base_counts_and_model(spark, docs, monkeypatch):
    monkeypatch.setattr(lm, "FREQUENT", 0.01)
    monkeypatch.setattr(lm, "CLASSES", 4)
    rng = random.Random(4)
    texts = [" ".join(rng.choice(["The", "a", "Big", "red"]) + " " + rng.choice(["cat", "dog", f"n{rng.randrange(300)}"]) for _ in range(20)) for _ in range(150)]
    texts += [None, "", "unseen-word here", texts[0], texts[0]]
    got = {r["doc_id"]: r for r in lm.score(spark, docs(texts, extra=True)).collect()}
    count = Counter()
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in range(len(texts))}
    for i, t in enumerate(texts):
        if not held[i]:
            count.update([*base.lower_words_of(t), b" "])
    n, v = sum(count.values()), len(count)
    for i, t in enumerate(texts):
        own = [*base.lower_words_of(t), b" "]
        want = sum(math.log10((count[w] + 1) / (n + v + 1)) for w in own)
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[i], len(own), sum(count[w] > 0 for w in own), n)
        assert r["base_score"] == pytest.approx(want) and r["score"] < 0
    model, unigram = (sum(r[c] for i, r in got.items() if held[i]) for c in ("score", "base_score"))
    assert model > unigram  # adjectives and nouns alternate, which only classes can tell


def test_lm_scores_equal_a_plain_class_model(spark, docs, monkeypatch):
    """Classes are taken from the operator; counts, transitions and shares are made anew without it."""
    classes = 4
    monkeypatch.setattr(lm, "CLASSES", classes)
    monkeypatch.setattr(lm, "FREQUENT", 1e-3)
    kept, cluster = {}, lm.cluster
    monkeypatch.setattr(lm, "cluster", lambda *a, **k: kept.setdefault("out", cluster(*a, **k)))
    rng = random.Random(9)
    texts = [" ".join(rng.choice(["the", "a", "big"]) + " " + rng.choice(["cat", "dog", f"n{rng.randrange(12)}", f"r{i}"]) for _ in range(12)) for i in range(160)]
    texts += [None, "", texts[3], "never seen", "the " * 3000]
    got = {r["doc_id"]: r for r in lm.score(spark, docs(texts)).collect()}
    lines = {i: [" ", *((t or "").split()), " "] for i, t in enumerate(texts)}
    train = [w for i, w in lines.items() if zlib.crc32(str(i).encode()) % 7 != 2]
    count = Counter(t for w in train for t in w[1:])
    # All words seen often enough are sorted into classes, however small their share above the bound.
    ranked = sorted((w for w in count if w != " " and count[w] >= max(20, 1e-3 * sum(count.values()))), key=lambda w: (-count[w], w))
    assert len(ranked) > 10 and len(kept["out"][0]) == len(ranked) + 2
    cls = dict(zip(ranked, kept["out"][0][1:-1].tolist())) | {" ": classes}
    assert all(0 <= cls[w] < classes for w in ranked)
    at = lambda w: cls.get(w, classes + 1)
    steps = Counter((at(a), at(b)) for w in train for a, b in zip(w, w[1:]))
    table = np.array([[steps[i, j] for j in range(classes + 2)] for i in range(classes + 2)], float)
    np.testing.assert_array_equal(table, kept["out"][1])
    tokens, kinds = Counter(), Counter()
    for w, c in count.items():
        tokens[at(w)] += c
        kinds[at(w)] += 1
    kinds[classes + 1] += 1  # words never seen

    def share(w):
        return 1.0 if w == " " else (count[w] + 1) / (tokens[at(w)] + kinds[at(w)])

    for i, w in lines.items():
        want = sum(
            math.log10((steps[at(a), at(b)] + 0.1) / (table[at(a)].sum() + 0.1 * (classes + 2)) * share(b)) for a, b in zip(w, w[1:]))
        assert got[i]["score"] == pytest.approx(want), i


def test_lm_exchange_finds_alternating_classes():
    table = np.zeros((5, 5))
    table[0, 1], table[1, 0], table[2, 0], table[0, 2] = 50, 50, 30, 30
    right, left = np.array([0, 10.0, 0, 0, 0]), np.array([0, 10.0, 0, 0, 0])
    table[2] += right
    table[:, 2] += left
    assert lm.best_class(left, right, 2, table, 3) == 0


def test_lm_blocks_hold_all_neighbours_of_a_word(spark, docs, monkeypatch):
    """Rounds need no shuffle: a word lies in one block, with every follower and predecessor."""
    monkeypatch.setattr(lm, "BLOCK_TOKENS", 300)
    rng = random.Random(5)
    words = [f"w{i}" for i in range(30)]
    texts = [" ".join(rng.choice([*words, f"r{i}"]) for _ in range(rng.randrange(25))) for i in range(90)] + [None, "", "x y", "w1 w1 w1"]
    number = {" ": 0} | {w: i + 1 for i, w in enumerate(words)}
    want = Counter()
    for t in texts:
        ids = [number.get(w, 31) for w in [" ", *(t or "").split(), " "]]
        want.update(zip(ids, ids[1:]))
    rows = lm.packed(lm.bigram_counts(spark, docs(texts), words), 30, sum(want.values())).collect()
    assert len(rows) > 4
    right, left, last, at = Counter(), Counter(), Counter(), {}
    for r in rows:
        x = {k: np.frombuffer(r[k], "<i8" if k == "last" else "<u4") for k in ("words", "sizes", "right", "right_n", "left", "left_n", "last")}
        for i, w in enumerate(x["words"].tolist()):
            assert at.setdefault(w, r["block"]) == r["block"] and (not 0 < w <= 30 or w % 2 == r["block"] % 2)
            last[w, 0], last[w, 31] = x["last"].reshape(-1, 2)[i].tolist()
        for found, sizes, other, n in ((right, x["sizes"][::2], x["right"], x["right_n"]), (left, x["sizes"][1::2], x["left"], x["left_n"])):
            for w, o, k in zip(np.repeat(x["words"], sizes).tolist(), other.tolist(), n.tolist(), strict=True):
                assert (w, o) not in found
                found[w, o] = k
    word = range(1, 31)
    assert len(at) == 32
    assert right == {(a, b): n for (a, b), n in want.items() if a in word}
    assert left == {(b, a): n for (a, b), n in want.items() if b in word or a not in word}
    assert +last == {(a, b): n for (a, b), n in want.items() if a in word and b not in word}


def test_lm_best_classes_of_many_words_equal_those_word_by_word():
    """The gains of all words at once, of neighbours only, against sums over every cell."""
    rng = np.random.default_rng(3)
    classes, total, n = 6, 8, 90
    own = rng.integers(0, classes, n)
    pairs = rng.poisson(rng.random((n, 1)) * 0.4, (n, n))
    one = np.eye(total, dtype=int)[own]
    table = (one.T @ pairs @ one).astype(float)
    left, right = pairs.T @ one, pairs @ one
    assert (left == 0).any() and (right == 0).any()
    f = lambda x: x * math.log(x) if x > 0 else 0.0

    def gains(i):
        rest = table.copy()
        rest[own[i]] -= right[i]
        rest[:, own[i]] -= left[i]
        rest = np.maximum(rest, 0)
        for k in range(total):
            cells = sum(f(rest[k, j] + right[i, j]) - f(rest[k, j]) + f(rest[j, k] + left[i, j]) - f(rest[j, k]) for j in range(total))
            row, col = rest[k].sum(), rest[:, k].sum()
            yield cells - (f(row + right[i].sum()) - f(row) + f(col + left[i].sum()) - f(col))

    got = lm.best_classes(left, right, own, table, classes)
    for i in range(n):
        of_each = list(gains(i))[:classes]
        assert of_each[got[i]] == pytest.approx(max(of_each), abs=1e-6)
    assert (got != own).any()


def test_lm_of_nothing(spark, docs):
    assert lm.score(spark, docs(["x"]).limit(0)).count() == 0


# Decontamination


def test_decontamination_finds_near_copies_only(spark, docs):
    rng = random.Random(6)
    items = [" ".join(f"b{rng.randrange(900)}" for _ in range(n)) for n in (40, 40, 30, 14, 5, 3, 1)] + [None, ""]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")
    filler = [f"f{i}" for i in range(200)]
    near = items[0].split()
    near[0] = "changed"
    broken = items[1].split()
    broken[10], broken[25] = "other", "words"
    texts = [
        " ".join(filler[:20] + items[0].upper().split() + filler[20:]), " ".join(near), " ".join(broken), " ".join(items[2].split()[:29]),
        " ".join(filler), *ODD, items[3], " ".join(filler[:3] + items[4].split() + filler[:3]), items[5], items[6],
    ]
    got = {(r["doc_id"], r["item_id"]) for r in decontam.contaminated(spark, docs(texts, extra=True), bench).collect()}
    at = 5 + len(ODD)
    assert got == {(0, 0), (1, 0), (3, 2), (at, 3), (at + 1, 4), (at + 2, 5), (at + 3, 6)}
    left = {r["doc_id"] for r in decontam.clean_of(spark, docs(texts), bench).collect()}
    assert left == set(range(len(texts))) - {d for d, _ in got}


@pytest.mark.parametrize("times", [2, 3, 10])
def test_decontamination_of_repeated_and_similar_items(spark, docs, times):
    item = [f"b{i}" for i in range(60)]
    near = item[:30] + ["changed"] + item[31:]
    # Listed several times as it is, and several times with another last word: both share most shingles.
    bench = spark.createDataFrame(
        [(i, " ".join(item).upper() if i % 2 else " ".join(item)) for i in range(times)], "item_id bigint, text string")
    got = {r["item_id"]: r["similarity"] for r in decontam.contaminated(spark, docs([" ".join(near)]), bench).collect()}
    assert got == {i: pytest.approx(51 / 61, abs=1e-5) for i in range(times)}
    bench = spark.createDataFrame([(i, " ".join([*item[:-1], f"end{i}"])) for i in range(times)], "item_id bigint, text string")
    got = {r["item_id"] for r in decontam.contaminated(spark, docs([" ".join([*near[:-1], "end0"])]), bench).collect()}
    assert 0 in got


def test_decontamination_of_repeated_ids(spark, docs):
    item = " ".join(f"b{i}" for i in range(30))
    bench = spark.createDataFrame([(1, item)], "item_id bigint, text string")
    filler = " ".join(f"f{i}" for i in range(40))
    table = docs([item, item, filler, item, filler, filler], ids=[5, 5, 6, 6, 7, 7])
    got = {r["doc_id"]: (r["start"], r["similarity"]) for r in decontam.contaminated(spark, table, bench).collect()}
    assert got == {5: (0, 1.0), 6: (0, 1.0)}
    assert [r["doc_id"] for r in decontam.clean_of(spark, table, bench).collect()] == [7, 7]


def test_every_text_of_an_item_and_documents_without_id_are_looked_at(spark, docs):
    item = {c: " ".join(f"{c}{i}" for i in range(30)) for c in "abc"}
    bench = spark.createDataFrame([(1, item["b"]), (1, item["a"]), (None, item["c"]), (1, item["a"])], "item_id bigint, text string")
    table = docs([item["a"], item["b"], item["c"], "clean words", item["c"], "other words", None], ids=[1, 2, 3, 4, None, None, None], extra=True)
    got = {(r["doc_id"], r["item_id"], r["similarity"]) for r in decontam.contaminated(spark, table, bench).collect()}
    assert got == {(1, 1, 1.0), (2, 1, 1.0), (3, None, 1.0), (None, None, 1.0)}
    left = decontam.clean_of(spark, table, bench)
    assert left.columns == table.columns
    assert sorted([(r["doc_id"], r["text"]) for r in left.collect()], key=str) == [(4, "clean words"), (None, "other words"), (None, None)]


def test_decontamination_equals_its_sql_on_shared_shingles_and_repeated_ids(spark, docs):
    import duckdb

    rng = random.Random(4)
    stem = [f"s{i}" for i in range(40)]
    items = [(i // 2, " ".join([*stem[:30], *[f"e{i}-{j}" for j in range(12)]])) for i in range(8)] + [(9, " ".join(stem)), (9, " ".join(stem)), (None, "x y z"), (5, "")]
    texts, ids = [], []
    for k in range(60):
        words = items[rng.randrange(len(items))][1].split()
        for at in rng.sample(range(len(words)), min(len(words), rng.randrange(0, 3))):
            words[at] = f"q{rng.randrange(9)}"
        texts.append(" ".join([f"f{k}" for k in range(rng.randrange(6))] + words + ["tail"] * rng.randrange(4)))
        ids.append(rng.choice([None, 1, 2, 3, *range(10, 60)]))
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = decontam.contaminated(spark, docs(texts, ids=ids), bench)
    con = duckdb.connect()
    con.register("documents", docs(texts, ids=ids).toPandas().astype({"doc_id": "Int64"}))
    con.register("benchmark", bench.toPandas().astype({"item_id": "Int64"}))
    want = con.execute(decontam.SQL).fetchall()
    names = ("doc_id", "item_id", "start", "similarity")
    assert len(want) > 20 and sorted([tuple(r[n] for n in names) for r in got.collect()], key=str) == sorted(want, key=str)


def test_decontamination_of_nothing(spark, docs):
    bench = spark.createDataFrame([(1, "a b c d e f")], "item_id bigint, text string")
    assert decontam.contaminated(spark, docs(["x"]).limit(0), bench).count() == 0
    assert decontam.contaminated(spark, docs(["a b c d e f"]), bench.limit(0)).count() == 0


def test_decontamination_plan_is_native(spark, docs):
    bench = spark.createDataFrame([(1, "a b c d e f")], "item_id bigint, text string")
    plan = decontam.contaminated(spark, docs(["a b c d e f"]), bench)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow(?!Eval)", plan.split("== Physical Plan ==")[1])


# Language identification


def test_language_held_out_accuracy(spark):
    got = queries.op10_language_id(spark, "/root/testdata/sf0.01").join(
        base.documents(spark, "/root/testdata/sf0.01").select("doc_id", "lang"), "doc_id").where("held_out AND lang IS NOT NULL").toPandas()
    assert (got["lang_pred"] == got["lang"]).mean() > 0.97 and got["score"].between(0, 1).all()


def test_language_odd_rows(spark, docs):
    texts = [*ODD, "12 + 3", "abc def " * 9] + ["the abc def ghi"] * 20
    got = {r["doc_id"]: r for r in langid.identify(spark, docs(texts, extra=True)).collect()}
    assert [got[i]["lang_pred"] for i in (0, 1, 2, 6, 9)] == ["und"] * 5 and got[10]["lang_pred"] == "en"
    assert {r["lang_pred"] for r in langid.identify(spark, docs(["abc"], langs=[None])).collect()} == {"und"}
    assert langid.identify(spark, docs(["x"]).limit(0)).count() == 0


def test_language_more_than_64_languages(spark, docs):
    names = [f"l{i:02}" for i in range(70)]
    letters = "abcdefghijklmnopqrstuvwxyz"
    rng = random.Random(9)
    alphabets = ["".join(rng.sample(letters, 6)) for _ in names]
    texts, langs = [], []
    for name, own in zip(names, alphabets):
        for _ in range(8):
            texts.append(" ".join("".join(rng.choice(own) for _ in range(6)) for _ in range(40)))
            langs.append(name)
    got = langid.identify(spark, docs(texts, langs=langs)).toPandas()
    assert np.mean([langs[i] == p for i, p in zip(got["doc_id"], got["lang_pred"])]) > 0.95


# Classifier


def test_classifier_gradient():
    rng = np.random.default_rng(0)
    f = (np.concatenate([rng.choice(30, 5, replace=False) for _ in range(20)]), np.full(20, 5))
    y, w, t = rng.integers(0, 3, 20), rng.normal(size=30) * 0.3, np.array([-0.5, 0.7])
    gw, gt, _ = classifier.gradient(*f, y, w, t)
    for i in range(3):
        e = np.zeros(30)
        e[i] = 1e-5
        assert gw[i] == pytest.approx((classifier.gradient(*f, y, w + e, t)[2] - classifier.gradient(*f, y, w - e, t)[2]) / 2e-5, abs=1e-4)
    for i in range(2):
        e = np.zeros(2)
        e[i] = 1e-5
        assert gt[i] == pytest.approx((classifier.gradient(*f, y, w, t + e)[2] - classifier.gradient(*f, y, w, t - e)[2]) / 2e-5, abs=1e-4)


def test_classifier_learns_grades(spark, docs):
    rng = random.Random(8)
    texts, grades = [], []
    for _ in range(300):
        g = rng.randrange(3)
        mark = {0: "awful", 1: "plain***", 2: "fine"}[g]
        texts.append(" ".join([f"w{rng.randrange(80)}" for _ in range(20)] + [mark] * 2))
        grades.append(g)
    labels = spark.createDataFrame([(i, int(g == 2), int(g == 0)) for i, g in enumerate(grades)], "doc_id bigint, quality int, toxic int")
    got = classifier.select_quality(spark, docs([*texts, *ODD], extra=True), labels).toPandas().set_index("doc_id")
    assert len(got) == len(texts) + len(ODD)
    held = got[got["held_out"] & (got.index < 300)]
    assert np.mean([held.loc[i, "selected"] == (grades[i] == 2) for i in held.index]) > 0.9
    means = got.loc[range(300)].groupby(np.array(grades))["expected_grade"].mean()
    assert means[0] < means[1] < means[2]


def test_classifier_without_ratings(spark, docs):
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert [r["selected"] for r in classifier.select_quality(spark, docs(["a"]), labels).collect()] == [False]


# Stages on tables with clashing names


def test_stages_keep_columns_of_any_name(spark, docs):
    names = ("k", "extra", "whole", "_draw", "rate", "size", "target", "copies", "source_size", "row", "draw", "more", "n")
    texts = ["a b c", None, "a b c", "d " * 40, ""]
    table = docs(texts, sources=["x", None, "x", "y", "y"], ids=[1, None, 1, None, 5])
    for i, name in enumerate(names):
        table = table.selectExpr("*", f"'v{i}' AS {name}")
    mixed = mixing.mix(spark, table)
    results = ("size", "source_size", "target", "rate", "copies")
    assert mixed.columns == [f"given_{c}" if c in results else c for c in table.columns] + list(results)
    rows = mixed.collect()
    assert len(rows) == 5 and all(r[f"given_{n}" if n in results else n] == f"v{i}" for r in rows for i, n in enumerate(names))
    plain = mixing.report(spark, docs(texts, sources=["x", None, "x", "y", "y"], ids=[1, None, 1, None, 5]))
    assert sorted([(r["doc_id"], r["size"], r["copies"] * r["size"]) for r in rows], key=str) == sorted([(r["doc_id"], r["size"], r["taken"]) for r in plain.collect()], key=str)
    hidden = pii.mask_pii(table)
    assert hidden.columns == table.columns and hidden.count() == 5 and rules.cleaned(table).columns == table.columns
