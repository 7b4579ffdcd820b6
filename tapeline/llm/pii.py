"""Personal data by anchor expansion.

One Aho-Corasick automaton finds anchors: at-signs, plus signs, digits, schemes
and identifier cues.  A local parser expands each anchor to the boundaries of
its kind and validates it; nothing else of the text is looked at.

Base kinds (the contract's expressions, leftmost and non-overlapping per kind):
email, ip, card, phone.  Added kinds, all validated:

* ``login``: ``user:password`` or ``user`` before the host of a ``scheme://`` address;
* ``iban``: after a cue, two letters, two digits, 11 to 30 characters, mod 97 = 1;
* ``ssn``: after a cue, 3-2-4 digits with hyphens or blanks, no zero group;
* ``handle``: the address of a ``tel:`` or ``sip:`` scheme.

Null and empty texts have no spans.  Offsets are code points, end exclusive.
Rows are independent; texts are scanned whole; an empty table gives an empty
result; other columns are not read."""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Order of kinds that start at the same place.
KINDS = ["email", "ip", "card", "phone", "login", "iban", "ssn", "handle"]
BASE = 4

_DIGITS = frozenset("0123456789")
_ALNUM = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ") | _DIGITS
_LOCAL = _ALNUM | frozenset("._%+-")
_HOST = _ALNUM | frozenset("-")
_PHONE = _DIGITS | frozenset(" ().-")
_USER = _ALNUM | frozenset("._%+-~!$&'()*,;=:")
#: Cues that announce an identifier, lower case.
CUES = {"iban": ("iban",), "ssn": ("ssn", "social security")}
SCHEMES = {"login": ("://",), "handle": ("tel:", "sip:", "sips:")}


@functools.cache
def _automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for c in "0123456789":
        a.add_word(c, ("digit", 1))
    a.add_word("@", ("email", 1))
    a.add_word("+", ("phone", 1))
    for kind, words in (CUES | SCHEMES).items():
        for w in words:
            for form in {w, w.upper(), w.title()}:
                a.add_word(form, (kind, len(form)))
    a.make_automaton()
    return a


def _run(text: str, at: int, allowed: frozenset) -> int:
    n = len(text)
    while at < n and text[at] in allowed:
        at += 1
    return at


def _email(text: str, at: int, free: int) -> tuple[int, int] | None:
    start = at
    while start > free and text[start - 1] in _LOCAL:
        start -= 1
    end = _run(text, at + 1, _HOST)
    if start == at or end == at + 1:
        return None
    dots = 0
    while end < len(text) and text[end] == "." and (label := _run(text, end + 1, _HOST)) > end + 1:
        end, dots = label, dots + 1
    return (start, end) if dots else None


def _dotted(text: str, start: int) -> tuple[list[tuple[int, int]], int]:
    """Addresses of four groups in the run of digits and single dots from ``start``, and the end of its first group."""
    groups, at = [], start
    while True:
        end = _run(text, at, _DIGITS)
        groups.append((at, end))
        if end + 1 < len(text) and text[end] == "." and text[end + 1] in _DIGITS:
            at = end + 1
        else:
            break
    out = []
    for k in range(0, len(groups) - 3, 4):
        four = groups[k : k + 4]
        if all(e - s <= 3 or not text[s : e - 3].strip("0") for s, e in four) and all(int(text[max(s, e - 3) : e]) <= 255 for s, e in four):
            out.append((four[0][0], four[3][1]))
    return out, groups[-1][1]


def _card_run(text: str, start: int) -> int:
    """End of the run of digits with at most one blank or hyphen between two."""
    at, n = start + 1, len(text)
    while at < n:
        if text[at] in _DIGITS:
            at += 1
        elif text[at] in " -" and at + 1 < n and text[at + 1] in _DIGITS:
            at += 2
        else:
            break
    return at


def _luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _only_digits(text: str) -> str:
    return "".join(c for c in text if c in _DIGITS)


def _phone(text: str, at: int) -> tuple[int, int] | None:
    if at + 1 >= len(text) or text[at + 1] not in _DIGITS:
        return None
    end = _run(text, at + 2, _PHONE)
    while end > at + 3 and text[end - 1] not in _DIGITS:
        end -= 1
    if end <= at + 3 or text[end - 1] not in _DIGITS:
        return None
    return at, end


def _login(text: str, at: int) -> tuple[int, int] | None:
    end = _run(text, at, _USER)
    return (at, end) if end > at and end < len(text) and text[end] == "@" else None


def _value(text: str, at: int) -> int:
    """The place after a cue where its value begins: blanks, colons and the like are passed, a few words are not."""
    while at < len(text) and text[at] in " :#=\t":
        at += 1
    return at


def _iban(text: str, at: int) -> tuple[int, int] | None:
    at = _value(text, at)
    end, chars = at, ""
    while end < len(text) and len(chars) < 34 and (text[end] in _ALNUM or (text[end] == " " and end + 1 < len(text) and text[end + 1] in _ALNUM)):
        if text[end] != " ":
            chars += text[end]
        end += 1
        whole = end >= len(text) or text[end] not in _ALNUM
        if whole and 15 <= len(chars) and chars[:2].isalpha() and chars[2:4].isdigit() and int("".join(str(int(c, 36)) for c in chars[4:] + chars[:4])) % 97 == 1:
            return at, end
    return None


def _ssn(text: str, at: int) -> tuple[int, int] | None:
    at = _value(text, at)
    end = at
    for k, size in enumerate((3, 2, 4)):
        group = text[end : end + size]
        if len(group) < size or not all(c in _DIGITS for c in group) or not group.strip("0"):
            return None
        end += size
        if k < 2:
            if text[end : end + 1] not in ("-", " "):
                return None
            end += 1
    return (at, end) if text[end : end + 1] not in _DIGITS else None


def spans(text: str) -> list[tuple[int, int, str]]:
    """All spans as (start, end, kind), by start and then by order of kinds."""
    out: list[tuple[int, int, str]] = []
    mail_free = dotted_free = card_free = phone_free = 0
    for last, (kind, size) in _automaton().iter(text):
        at = last - size + 1
        if kind == "digit":
            if at >= dotted_free:
                found, dotted_free = _dotted(text, at)
                out += [(s, e, "ip") for s, e in found]
            if at >= card_free:
                card_free = _card_run(text, at)
                digits = _only_digits(text[at:card_free])
                if 12 <= len(digits) <= 19 and _luhn(digits):
                    out.append((at, card_free, "card"))
        elif kind == "email":
            if got := _email(text, at, mail_free):
                mail_free = got[1]
                out.append((*got, "email"))
        elif kind == "phone":
            if at >= phone_free and (got := _phone(text, at)):
                phone_free = got[1]
                if 9 <= len(_only_digits(text[at : got[1]])) <= 15:
                    out.append((*got, "phone"))
        elif kind == "login":
            if got := _login(text, last + 1):
                out.append((*got, "login"))
        elif kind == "handle":
            end = _run(text, last + 1, _LOCAL)
            if end - last > 6 and (at == 0 or text[at - 1] not in _ALNUM) and any(c in _DIGITS for c in text[last + 1 : end]):
                out.append((last + 1, end, "handle"))
        else:
            outer = (at == 0 or text[at - 1] not in _ALNUM) and text[last + 1 : last + 2] not in _ALNUM
            if outer and (got := (_iban if kind == "iban" else _ssn)(text, last + 1)):
                out.append((*got, kind))
    return sorted(set(out), key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def _text(found: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in found)


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, number of spans of each base kind, digest of the base spans, all spans as text."""
    fields = [docs.schema[id_col]] + [T.StructField(f"n_{k}", T.LongType()) for k in KINDS[:BASE]] + [T.StructField(c, T.StringType()) for c in ("base_sha256", "spans")]
    schema = T.StructType(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: list[list[int]] = [[] for _ in range(BASE)]
            digests, listed = [], []
            for value in batch.column(text_col):
                found = spans(value.as_py() or "")
                base = [s for s in found if s[2] in KINDS[:BASE]]
                for k, c in zip(KINDS, counts, strict=False):
                    c.append(sum(s[2] == k for s in base))
                digests.append(hashlib.sha256(_text(base).encode()).hexdigest())
                listed.append(_text(found))
            yield pa.RecordBatch.from_arrays([batch.column(id_col), *(pa.array(c, pa.int64()) for c in counts), pa.array(digests, pa.string()), pa.array(listed, pa.string())], schema.names)

    return docs.select(id_col, text_col).mapInArrow(run, schema)


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents with every span replaced by its kind in brackets; overlapping spans become one."""

    def cover(text: str) -> str:
        out, at = [], 0
        for s, e, k in spans(text):
            if s >= at:
                out += [text[at:s], f"[{k.upper()}]"]
            at = max(at, e)
        return "".join(out) + text[at:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            texts = [None if (t := v.as_py()) is None else cover(t) for v in batch.column(at)]
            yield batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.column(at).type))

    return docs.mapInArrow(run, docs.schema)
