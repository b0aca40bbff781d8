"""Quality rules, line first.

Every line is judged by itself; failing lines are removed; a document that
loses too much of its text, or fails the base rules, is rejected. A line with
words fails if one of these holds:

* signs: more than 30 of `#*$%&|<>` per 100 words;
* punctuation: more than 30 runs of `!` or `?` of two or more per 100 words;
* navigation: more than 20 of `| » › • ·` per 100 words, or the whole line is a
  menu entry;
* boilerplate: it holds one of the phrases below;
* repetition: it equals an earlier line.

A document is rejected if the failing lines hold more than 40 of 100 words, if
it has under 50 words, or if more than half of its words lie in three-word
windows found twice or more in it.

A null text has no words and is rejected. Lines are cut at `\\n` only. Repeated
rows are judged alike; other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zonecast.llm.base import per_row, rewritten

MIN_WORDS = 50
REPEAT_SHARE = 50
LOST_SHARE = 40
SIGNS = "#*$%&|<>"
SEPARATORS = "|»›•·"
BOILERPLATE = (
    "cookie policy", "privacy policy", "terms of use", "terms of service", "all rights reserved", "enable javascript",
    "subscribe to our newsletter", "lorem ipsum",
)
MENU = (
    "home", "menu", "search", "share", "login", "log in", "sign in", "sign up", "register", "next", "previous", "next page",
    "previous page", "read more", "skip to content", "back to top", "contact us", "about us",
)

SPACES = " \t\n\x0b\x0c\r"
bangs = re.compile(r"[!?]{2,}").findall
boilerplate = re.compile("|".join(BOILERPLATE)).search
A_TO_Z = str.maketrans({chr(c): chr(c + 32) for c in range(ord("A"), ord("Z") + 1)})


def line_fails(line: str, n_words: int) -> bool:
    """The verdict of all rules but repetition on a line with `n_words` words, one at least."""
    signs = sum(map(line.count, SIGNS))
    if 100 * signs > 30 * n_words or 100 * sum(map(line.count, SEPARATORS)) > 20 * n_words:
        return True
    if ("!!" in line or "??" in line or "!?" in line or "?!" in line) and 100 * len(bangs(line)) > 30 * n_words:
        return True
    low = line.translate(A_TO_Z) if not line.islower() else line
    return low.strip(SPACES) in MENU or boilerplate(low) is not None


def repeated_words(words: list[bytes]) -> int:
    """Words inside three-word windows that the text has twice or more, each word once."""
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) == len(windows):
        return 0
    counts = Counter(windows)
    total, upto = 0, 0  # words before `upto` are counted
    for i, w in enumerate(windows):
        if counts[w] > 1:
            total += i + 3 - max(i, upto)
            upto = i + 3
    return total


def clean(text: str | None) -> dict:
    """All measures, the verdict and the kept text of one document."""
    text = text or ""
    words = text.encode("utf-8", "surrogatepass").split()
    seen: set[str] = set()
    kept: list[str] = []
    dup = lost = lost_lines = 0
    for line in text.split("\n"):
        n = len(line.encode("utf-8", "surrogatepass").split())
        if not n:
            kept.append(line)
            continue
        again = line in seen
        seen.add(line)
        dup += again
        if again or line_fails(line, n):
            lost += n
            lost_lines += 1
        else:
            kept.append(line)
    repeats = repeated_words(words)
    base_failed = len(words) < MIN_WORDS or 100 * repeats > REPEAT_SHARE * len(words)
    return {
        "n_words": len(words), "word_chars": len(text) - sum(map(text.count, SPACES)), "n_symbols": sum(map(text.count, SIGNS)),
        "n_dup_lines": dup, "n_repeat_words": repeats, "base_failed": base_failed,
        "kept": not base_failed and 100 * lost <= LOST_SHARE * len(words),
        "lost_lines": lost_lines, "lost_words": lost, "text": "\n".join(kept) if lost_lines else text,
    }


MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "lost_lines", "lost_words")


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Measures and verdict: one row per input row."""

    def row(doc_id, text):
        found = clean(text)
        return doc_id, *(found[m] for m in MEASURES)

    kinds = ", ".join(f"{m} {'boolean' if m in ('base_failed', 'kept') else 'bigint'}" for m in MEASURES)
    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return per_row(chosen, row, f"doc_id bigint, {kinds}")


def cleaned(docs: DataFrame) -> DataFrame:
    """The documents that pass, without their failing lines; all columns stay, `n_chars` is counted anew."""
    return rewritten(docs, lambda text: found["text"] if (found := clean(text))["kept"] else None)


def _sql() -> str:
    """The same verdict as DuckDB SQL."""
    word = r"[^\x20\x09-\x0D]+"
    signs = "len(regexp_extract_all({}, '[#*$%&|<>]'))"
    phrases = "|".join(BOILERPLATE)
    menu = ", ".join(f"'{m}'" for m in MENU)
    low = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents
), l0 AS (
  SELECT r, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM d
), l1 AS (
  SELECT r, k, line, len(regexp_extract_all(line, '{word}')) AS n,
    row_number() OVER (PARTITION BY r, line ORDER BY k) > 1 AS again FROM l0
), l2 AS (
  SELECT r, n, again, again
    OR 100 * {signs.format('line')} > 30 * n
    OR 100 * len(regexp_extract_all(line, '[|»›•·]')) > 20 * n
    OR 100 * len(regexp_extract_all(line, '[!?]{{2,}}')) > 30 * n
    OR trim({low.format('line')}, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) IN ({menu})
    OR regexp_matches({low.format('line')}, '{phrases}') AS fails
  FROM l1 WHERE n > 0
), lines AS (
  SELECT r, count_if(again)::BIGINT AS n_dup_lines, count_if(fails)::BIGINT AS lost_lines, sum(CASE WHEN fails THEN n ELSE 0 END)::BIGINT AS lost_words
  FROM l2 GROUP BY r
), w AS (
  SELECT r, unnest(regexp_extract_all(text, '{word}')) AS w, generate_subscripts(regexp_extract_all(text, '{word}'), 1) AS i FROM d
), w3 AS (
  SELECT r, i, w, lead(w, 1) OVER p AS w1, lead(w, 2) OVER p AS w2 FROM w WINDOW p AS (PARTITION BY r ORDER BY i)
), c AS (
  SELECT r, i, w, CASE WHEN w2 IS NOT NULL AND count(*) OVER (PARTITION BY r, w, w1, w2) > 1 THEN 1 ELSE 0 END AS twice FROM w3
), covered AS (
  SELECT r, w, max(twice) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS x FROM c
), words AS (
  SELECT r, count(*) AS n_words, sum(length(w))::BIGINT AS word_chars, sum(x)::BIGINT AS n_repeat_words FROM covered GROUP BY r
), m AS (
  SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0) AS word_chars, {signs.format('text')} AS n_symbols,
    coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
    coalesce(lost_lines, 0) AS lost_lines, coalesce(lost_words, 0) AS lost_words
  FROM d LEFT JOIN words USING (r) LEFT JOIN lines USING (r)
)
SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {REPEAT_SHARE} * n_words AS base_failed,
  NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {REPEAT_SHARE} * n_words) AND 100 * lost_words <= {LOST_SHARE} * n_words AS kept
FROM m
"""


SQL = _sql()
