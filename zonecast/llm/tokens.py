"""Token counts with a whole-token shortcut.

Offline, on the driver, every string of the vocabulary is encoded by the
library: those that come out as one token are proved whole. A text is cut into
pre-tokens; a proved one counts as one token without any merging, and only the
rest go through the library's merges, each distinct one once per batch of work.

The cut must be the library's own, so the letter, digit and space classes of
the pattern are compared, code point by code point, with what the library does
(`class_differences`, covered by a test); texts holding a code point on which
both differ are pre-cut by the library itself.

A null text counts as empty. Special strings inside a text are found first, as
the library does by default, and count as one token each. Each row stands
alone, so repeats, ties and other columns do not matter.
"""

from __future__ import annotations

import os
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from zonecast.llm.base import per_batch

LIMIT = 1024
#: Entries of the memo of merged pre-tokens; it is emptied when full, which never changes a count.
MEMO = 1_500_000
#: The cut of byte-level vocabularies: fixed, it is part of the vocabulary's definition.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def plain_strings(tok) -> list[str]:
    """The vocabulary as text: ids decoded one by one; those that are no whole UTF-8 are left out."""
    texts = tok.decode_batch([[i] for i in range(tok.get_vocab_size(with_added_tokens=False))])
    return [t for t in texts if t and "�" not in t]


@lru_cache(maxsize=4)
def whole_tokens(path: str) -> frozenset[str]:
    """Vocabulary strings that are one pre-token and that the library encodes as one token."""
    import regex

    tok = tokenizer(path)
    texts = [t for t in plain_strings(tok) if regex.fullmatch(PATTERN, t)]
    return frozenset(t for t, e in zip(texts, tok.encode_batch(texts, add_special_tokens=False)) if len(e.ids) == 1)


#: Code points looked at: the planes that hold assigned characters. In all others every character is a sign to both sides.
PLANES = ((0, 0xD800), (0xE000, 0x34000), (0xE0000, 0xE1000))


@lru_cache(maxsize=4)
def class_differences(path: str) -> frozenset[str]:
    """Code points that the pattern and the library do not put in the same class (letter, digit, sign, space).

    A code point joins a letter, a digit or a sign before it into one pre-token
    exactly if it is of that class, and joins none if it is a space.
    """
    import regex

    pre = tokenizer(path).pre_tokenizer
    cut = regex.compile(PATTERN)
    points = [chr(i) for low, high in PLANES for i in range(low, high)]
    odd: set[str] = set()
    for before in "a1-":
        for at in range(0, len(points), 50_000):
            some = points[at:at + 50_000]
            probe = "".join(f"{before}{c}\n" for c in some)
            theirs = {s // 3 for _, (s, e) in pre.pre_tokenize_str(probe) if s % 3 == 0 and e - s == 2}
            ours = {m.start() // 3 for m in cut.finditer(probe) if m.start() % 3 == 0 and m.end() - m.start() == 2}
            odd.update(some[i] for i in theirs ^ ours)
    return frozenset(odd)


class Counter:
    """Counts tokens of texts for one vocabulary; one per Python worker."""

    def __init__(self, path: str, whole: frozenset[str], odd: frozenset[str]):
        import regex

        self.tok = tokenizer(path)
        self.whole, self.memo = whole, {}
        self.cut = regex.compile(PATTERN).findall
        self.odd = odd
        added = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.special = regex.compile("|".join(regex.escape(t) for t in sorted(added, key=len, reverse=True))) if added else None

    def pieces(self, text: str) -> list[str]:
        if not self.odd.isdisjoint(text):
            return [text[s:e] for _, (s, e) in self.tok.pre_tokenizer.pre_tokenize_str(text)]
        return self.cut(text)

    def merge(self, rest: set[str]) -> None:
        """Memoize the counts of pre-tokens that are no proved whole token."""
        new = [p for p in rest if p not in self.memo]
        if len(self.memo) + len(new) > MEMO:
            self.memo.clear()
            new = list(rest)
        for p, e in zip(new, self.tok.encode_batch_fast(new, add_special_tokens=False)):
            self.memo[p] = len(e.ids)

    def counts(self, texts: list[str]) -> list[int]:
        """Tokens of each text; distinct pre-tokens of all the texts are merged together."""
        totals, parts = [], []  # parts: number of the text, pre-tokens to merge
        for i, text in enumerate(texts):
            split = [text]
            if self.special and self.special.search(text):
                split = self.special.split(text)
            totals.append(len(split) - 1)
            for part in split:
                if part:
                    found = self.pieces(part)
                    rest = [p for p in found if p not in self.whole]
                    totals[i] += len(found) - len(rest)
                    parts.append((i, rest))
        self.merge(set().union(*(rest for _, rest in parts)))
        for i, rest in parts:
            totals[i] += sum(map(self.memo.__getitem__, rest))
        return totals


def groups(texts: list[str], chars: int = 400_000):
    """Runs of texts of about so many characters, so that the pre-tokens held at once stay few."""
    run, size = [], 0
    for text in texts:
        if run and size + len(text) > chars:
            yield run
            run, size = [], 0
        run.append(text)
        size += len(text)
    if run:
        yield run


def count_tokens(
    spark: SparkSession, docs: DataFrame, path: str | None = None, limit: int = LIMIT,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """Bytes, tokens and whether they are over `limit`: one row per input row.

    The broadcast holds vocabulary strings only: at most as many as the
    vocabulary has entries, whatever the size of `docs`.
    """
    path = path or vocabulary_path()
    shared = spark.sparkContext.broadcast((whole_tokens(path), class_differences(path)))
    held: dict = {}

    def measure(batch: dict[str, list]) -> dict[str, list]:
        if not held:
            # One thread: Spark already runs a task per core.
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            held["counter"] = Counter(path, *shared.value)
        texts = [t or "" for t in batch["text"]]
        n = [c for run in groups(texts) for c in held["counter"].counts(run)]
        return {
            "doc_id": batch["doc_id"], "n_bytes": [len(t.encode("utf-8", "surrogatepass")) for t in texts], "n_tokens": n,
            "over_limit": [c > limit for c in n],
        }

    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return per_batch(chosen, measure, "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean")
