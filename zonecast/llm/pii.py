"""Personal data by anchor expansion.

One pass of an Aho-Corasick automaton over a text finds anchors: at-signs,
plus-signs, digits, schemes and cues of identifiers. A small parser for each
kind starts at an anchor, expands to the left and right by fixed character
classes, and checks what it got. Nothing is ever searched twice, so the time is
linear in the text.

Kinds, in the order of the output:
* `email`, `ip`, `card`, `phone`: the leftmost, longest, non-overlapping
  matches of the four base patterns; a match that fails its check (part over
  255, digit count, Luhn) is dropped and not retried from a later start.
* `address`: a URI of a person: `mailto:`, `tel:`, `sip:`, `sips:`, `xmpp:`
  with a target, or `scheme://user[:password]@host`.
* `account`: an identifier after a cue such as `iban`, `passport` or `token`:
  an IBAN with a right check sum, or 6 to 64 letters, digits and hyphens with
  at least four digits.

Spans of different kinds may overlap. A null text counts as empty and gives no
spans. Repeated rows and clashing columns are no matter: each row stands alone
and only the named id and text columns are read.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zonecast.llm.base import per_row, rewritten

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "address", "account")

DIGITS = frozenset("0123456789")
LETTERS = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")
ALNUM = DIGITS | LETTERS
LOCAL = ALNUM | frozenset("._%+-")
LABEL = ALNUM | frozenset("-")
PHONE = DIGITS | frozenset(" ().-")
URI = ALNUM | frozenset("-._~:/?#[]@!$&'()*+,;=%")

PERSONAL_SCHEMES = ("mailto:", "tel:", "sip:", "sips:", "xmpp:")
CUES = (
    "account", "acct", "iban", "passport", "ssn", "social security", "customer id", "member id", "user id", "username",
    "routing", "tax id", "api key", "api_key", "apikey", "password", "passwd", "secret", "token",
)
CONNECTORS = frozenset(("number", "no", "nr", "num", "id", "code", "key", "is"))


@lru_cache(maxsize=1)
def automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    found.add_word("@", ("email", 1))
    found.add_word("+", ("phone", 1))
    found.add_word("://", ("scheme", 3))
    for digit in DIGITS:
        found.add_word(digit, ("digit", 1))
    for word, kind in [(s, "personal") for s in PERSONAL_SCHEMES] + [(c, "cue") for c in CUES]:
        for form in {word, word.upper(), word.capitalize(), word.title()}:
            found.add_word(form, (kind, len(form)))
    found.make_automaton()
    return found


def run_right(text: str, at: int, allowed: frozenset) -> int:
    n = len(text)
    while at < n and text[at] in allowed:
        at += 1
    return at


def run_left(text: str, at: int, allowed: frozenset, floor: int = 0) -> int:
    while at > floor and text[at - 1] in allowed:
        at -= 1
    return at


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (2 if i % 2 else 1)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def email_at(text: str, at: int, floor: int) -> tuple[int, int] | None:
    """Span of the address around the at-sign at `at`, starting at `floor` at the earliest."""
    start = run_left(text, at, LOCAL, floor)
    end = run_right(text, at + 1, LABEL)
    if start == at or end == at + 1:
        return None
    dots = 0
    while text[end:end + 1] == "." and (then := run_right(text, end + 1, LABEL)) > end + 1:
        end, dots = then, dots + 1
    return (start, end) if dots else None


def ip_at(text: str, start: int) -> tuple[int, int] | None:
    """Span of four dotted digit runs from the digit run at `start`."""
    end = run_right(text, start, DIGITS)
    for _ in range(3):
        if text[end:end + 1] != "." or (then := run_right(text, end + 1, DIGITS)) == end + 1:
            return None
        end = then
    return start, end


def part_fits(part: str) -> bool:
    """At most 255; leading zeros do not count, and very long parts are never converted."""
    short = part.lstrip("0")
    return len(short) <= 3 and int(short or "0") <= 255


def card_at(text: str, start: int) -> int:
    """End of the digits from `start` that stand together or one space or hyphen apart."""
    end = start + 1
    while True:
        if text[end:end + 1] in DIGITS and end < len(text):
            end += 1
        elif text[end:end + 1] in (" ", "-") and text[end + 1:end + 2] in DIGITS:
            end += 2
        else:
            return end


def phone_at(text: str, at: int) -> int | None:
    """End of the number after the plus-sign at `at`: its last digit, three or more places on."""
    if text[at + 1:at + 2] not in DIGITS or at + 1 >= len(text):
        return None
    end = run_right(text, at + 2, PHONE)
    while end > at + 3 and text[end - 1] not in DIGITS:
        end -= 1
    return end if end > at + 3 else None


def uri_around(text: str, at: int, size: int, floor: int) -> tuple[int, int] | None:
    """Span of `scheme://user@host...` around the separator that starts at `at`."""
    start = run_left(text, at, LETTERS | DIGITS | frozenset("+.-"), floor)
    while start < at and text[start] not in LETTERS:
        start += 1
    end = run_right(text, at + size, URI)
    while end > at + size and text[end - 1] in ".,;:!?)'":
        end -= 1
    authority = text[at + size:end].split("/", 1)[0]
    user, sign, host = authority.rpartition("@")
    return (start, end) if start < at and sign and user and host[:1] in ALNUM and host else None


def personal_uri(text: str, start: int, size: int) -> tuple[int, int] | None:
    """Span of `mailto:target` and the like."""
    if start and text[start - 1] in ALNUM:
        return None
    end = run_right(text, start + size, URI)
    while end > start + size and text[end - 1] in ".,;:!?)'":
        end -= 1
    target = text[start + size:end]
    telephone = text[start:start + 3].lower() == "tel"
    good = sum(c in DIGITS for c in target) >= 5 if telephone else "@" in target[1:-1]
    return (start, end) if good else None


def iban(value: str) -> bool:
    flat = value.replace(" ", "")
    if not (15 <= len(flat) <= 34 and flat[:2].isalpha() and flat[2:4].isdigit()):
        return False
    return int("".join(str(int(c, 36)) for c in flat[4:] + flat[:4])) % 97 == 1


def account_after(text: str, start: int, size: int) -> tuple[int, int] | None:
    """Span of the identifier that follows the cue of `size` characters at `start`."""
    at = start + size
    if start and text[start - 1] in ALNUM or text[at:at + 1] in ALNUM and at < len(text):
        return None
    for _ in range(3):
        begin = at
        while at < len(text) and at - begin < 8 and text[at] in " \t:=#.\"'":
            at += 1
        end = run_right(text, at, LABEL)
        if text[at:end].lower() not in CONNECTORS:
            break
        at = end
    if at == start + size or end == at:
        return None
    # An IBAN may be written in groups of four.
    long = end
    while text[long:long + 1] == " " and (then := run_right(text, long + 1, ALNUM)) > long + 1 and then - at <= 42 and then - long <= 5:
        long = then
    while long > end and not iban(text[at:long]):
        long = text.rfind(" ", at, long)
    if long > end and iban(text[at:long]):
        return at, long
    end = at + len(text[at:end].rstrip("-"))
    value = text[at:end]
    return (at, end) if 6 <= len(value) <= 64 and sum(c in DIGITS for c in value) >= 4 else None


def find_spans(text: str | None) -> list[tuple[str, int, int]]:
    """All spans of a text, as (kind, start, end) in code points, by kind and start."""
    if not text:
        return []
    out: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    free = dict.fromkeys(("email", "ip", "card", "phone", "address"), 0)  # where the next match may start
    account_end = 0
    for last, (anchor, size) in automaton().iter(text):
        at = last - size + 1
        if anchor == "digit":
            before = text[at - 1] if at else ""
            if at >= free["ip"] and (before not in DIGITS or not before) and (span := ip_at(text, at)):
                free["ip"] = span[1]
                if all(part_fits(p) for p in text[span[0]:span[1]].split(".")):
                    out["ip"].append(span)
            if at >= free["card"]:
                free["card"] = end = card_at(text, at)
                digits = [c for c in text[at:end] if c in DIGITS] if end - at >= 13 else ()
                if 13 <= len(digits) <= 19 and luhn("".join(digits)):
                    out["card"].append((at, end))
        elif anchor == "email":
            if at >= free["email"] and (span := email_at(text, at, free["email"])):
                free["email"] = span[1]
                out["email"].append(span)
        elif anchor == "phone":
            if at >= free["phone"] and (end := phone_at(text, at)):
                free["phone"] = end
                if 9 <= sum(c in DIGITS for c in text[at:end]) <= 15:
                    out["phone"].append((at, end))
        elif anchor == "cue":
            if at >= account_end and (span := account_after(text, at, size)):
                account_end = span[1]
                out["account"].append(span)
        elif at >= free["address"]:
            span = uri_around(text, at, size, free["address"]) if anchor == "scheme" else personal_uri(text, at, size)
            if span:
                free["address"] = span[1]
                out["address"].append(span)
    return [(k, s, e) for k in KINDS for s, e in out[k]]


def masked(text: str | None) -> str | None:
    """The text with each run of overlapping spans replaced by the kind of its first span."""
    spans = sorted(((s, -e, k) for k, s, e in find_spans(text)))
    if not spans:
        return text
    out, at, i = [], 0, 0
    while i < len(spans):
        start, end, kind = spans[i][0], -spans[i][1], spans[i][2]
        while i < len(spans) and spans[i][0] < end:
            end = max(end, -spans[i][1])
            i += 1
        out += [text[at:start], f"[{kind.upper()}]"]
        at = end
    return "".join(out) + text[at:]


def report(doc_id, text: str | None) -> tuple:
    spans = find_spans(text)
    written = [f"{k}:{s}:{e}" for k, s, e in spans]
    base = [w for w, (k, _, _) in zip(written, spans) if k in BASE_KINDS]
    counts = [sum(k == b for k, _, _ in spans) for b in BASE_KINDS]
    return doc_id, *counts, hashlib.sha256(",".join(base).encode()).hexdigest(), ",".join(written)


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts by kind, digest of the base spans, and all spans: one row per input row."""
    schema = "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string"
    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return per_row(chosen, report, schema)


def mask_pii(docs: DataFrame) -> DataFrame:
    """The documents with personal data replaced in `text` and `n_chars` counted anew; null texts (then with a null `n_chars`) and other columns stay."""
    return rewritten(docs, masked, keep_nulls=True)
