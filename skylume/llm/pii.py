"""Personal data: e-mail, IPv4, card and phone spans, disguised ones included.

Base spans are the leftmost non-overlapping matches of one pattern a kind, checked
afterwards (parts at most 255, Luhn, number of digits), found in linear time.

Method on top: transducers rewrite disguises (homoglyphs, full-width forms and invisible
characters; spelled digits; "at" and "dot" in words or brackets) while keeping for every
output character the source characters it stands for.  Identifiers are detected in the
normalised text, together with phones and cards that touch other digits so that the
base pattern swallowed both, and mapped back to the source.  A span found this way is
added if it overlaps no base span or is longer than all it overlaps and holds them whole;
base spans always stay.  Redaction takes overlapping spans as one, named for the longest.

Spans are in code points, end exclusive.  Defined cases: null and empty texts have no
spans; texts are read whole; repeated rows are judged one by one; a document without any
digit, "@" or trigger of a transducer is skipped, as nothing can match there.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

KINDS = ("email", "ip", "card", "phone")
Span = tuple[str, int, int]

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CHAIN = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")
_NUMBER = re.compile("[0-9]+")


#: What a digit adds at the doubled places of the Luhn sum.
_DOUBLED = {str(d): 2 * d // 10 + 2 * d % 10 for d in range(10)}


def luhn(digits: str) -> bool:
    return (sum(map(int, digits[::-2])) + sum(map(_DOUBLED.__getitem__, digits[-2::-2]))) % 10 == 0


def emails(text: str) -> Iterator[Span]:
    done = 0
    at = text.find("@")
    while at >= 0:
        s = at
        while s > done and _LOCAL.match(text[s - 1]):
            s -= 1
        found = _DOMAIN.match(text, at + 1) if s < at else None
        if found:
            done = found.end()
            yield "email", s, done
        at = text.find("@", max(at + 1, done))


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _part_ok(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= 255


def detect(text: str, failed: list[Span] | None = None) -> list[Span]:
    """Base spans; matches that fail their check go to ``failed``."""
    out = list(emails(text)) if "@" in text else []
    if not _DIGIT.search(text):
        return out
    bad = failed if failed is not None else []
    if "." in text:
        for m in _IP.finditer(text):
            (out if all(map(_part_ok, m[0].split("."))) else bad).append(("ip", *m.span()))
    for m in _CHAIN.finditer(text):
        d = _digits(m[0]) if m.end() - m.start() >= 14 else ""
        if d:
            (out if 14 <= len(d) <= 19 and luhn(d) else bad).append(("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            (out if 10 <= len(_digits(m[0])) <= 15 else bad).append(("phone", *m.span()))
    return out


def _swallowed(text: str, failed: list[Span]) -> Iterator[Span]:
    """Identifiers on number borders inside matches that failed because they held too much."""
    for kind, s, e in failed:
        runs = [(m.start() + s, m.end() + s) for m in _NUMBER.finditer(text[s:e])]
        if kind == "phone":
            total, end = 0, None
            for a, b in runs:
                total += b - a
                if 10 <= total <= 15:
                    end = b
                if total > 15:
                    break
            if total > 15 and end:
                yield "phone", s, end
        elif kind == "card":
            i, digits = 0, _digits(text[s:e])
            done = [0, *accumulate(b - a for a, b in runs)]  # digits before each run
            while i < len(runs):
                total, best, j = 0, None, i
                while j < len(runs) and total <= 19:
                    total = done[j + 1] - done[i]
                    if 14 <= total <= 19 and luhn(digits[done[i] : done[j + 1]]):
                        best = j
                    j += 1
                if best is not None and (i, best) != (0, len(runs) - 1):
                    yield "card", runs[i][0], runs[best][1]
                    i = best
                i += 1


# -------------------------------------------------------------------------- transducers

# Letters that look like ASCII ones.
_CYRILLIC = dict(zip("аАВсСеЕНіІјЈкКМоОрРѕЅТхХуУԁԛԝһ", "aABcCeEHiIjJkKMoOpPsSTxXyYdqwh", strict=True))
_GREEK = dict(zip("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧοανικρ", "ABEZHIKMNOPTYXoavikp", strict=True))
_POINTS = {"․": ".", "。": ".", "｡": ".", "﹒": ".", "﹫": "@", "‐": "-", "‑": "-", "‒": "-", "–": "-"}
_NOTHING = "­​‌‍⁠﻿"
# Digits in words.
_SPELLED = {
    "zero": 0, "oh": 0, "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9,
    "null": 0, "eins": 1, "zwei": 2, "drei": 3, "vier": 4, "fünf": 5, "sechs": 6, "sieben": 7, "acht": 8, "neun": 9,
    "zéro": 0, "un": 1, "deux": 2, "trois": 3, "quatre": 4, "cinq": 5, "sept": 7, "huit": 8, "neuf": 9,
    "cero": 0, "uno": 1, "dos": 2, "tres": 3, "cuatro": 4, "cinco": 5, "seis": 6, "siete": 7, "ocho": 8, "nueve": 9,
}


def _glyphs() -> dict[str, str]:
    wide = {chr(c): chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)}
    digits = {chr(c): str(unicodedata.digit(chr(c))) for c in range(0x80, 0x11000) if unicodedata.category(chr(c)) == "Nd"}
    return digits | wide | _CYRILLIC | _GREEK | _POINTS | dict.fromkeys(_NOTHING, "")


GLYPHS = _glyphs()
_GLYPH = re.compile("[" + "".join(map(re.escape, GLYPHS)) + "]")
_WORD = "|".join(sorted(_SPELLED, key=len, reverse=True))
_SPELLED_THREE = re.compile(rf"(?<!\w)(?:{_WORD})(?:[ \t,.-]+(?:{_WORD}|[0-9]+)){{2,}}(?!\w)", re.I)
_AT = re.compile(r"(?<!\s)\s*+[\[({<]\s*+(?:at|@)\s*+[\])}>]\s*+|(?<=[A-Za-z0-9_])\s++at\s++(?=[A-Za-z0-9-]++(?:\s*+[\[({<]\s*+dot\s*+[\])}>]\s*+[a-z]{2}|\s++dot\s++[a-z]{2}|\.(?-i:[a-z]{2})))", re.I)
_DOT = re.compile(r"(?<!\s)\s*+[\[({<]\s*+(?:dot|\.)\s*+[\])}>]\s*+|(?<=[A-Za-z0-9])\s++dot\s++(?=[A-Za-z0-9])", re.I)
_AT_HINT = re.compile(r"[\[({<]\s*+(?:at|dot|@|\.)\s*+[\])}>]|\sdot\s|\sat\s++[A-Za-z0-9-]++\.(?-i:[a-z]{2})", re.I)
_PLUS = re.compile(r"(?<!\w)plus\s++(?=[0-9])", re.I)


class Mapped:
    """A text with, for pieces of it, the source span each stands for."""

    def __init__(self, text: str):
        self.text, self.at, self.src, self.src_end, self.linear = text, [0], [0], [len(text)], [True]

    def source(self, start: int, end: int) -> tuple[int, int]:
        i, j = bisect_right(self.at, start) - 1, bisect_right(self.at, end - 1) - 1
        s = self.src[i] + (start - self.at[i] if self.linear[i] else 0)
        e = self.src[j] + (end - self.at[j]) if self.linear[j] else self.src_end[j]
        return s, e

    def rewrite(self, edits: list[tuple[int, int, str]]) -> Mapped:
        """The text with [start, end) replaced, sorted and apart; offsets composed."""
        out = Mapped("")
        out.at, out.src, out.src_end, out.linear = [], [], [], []
        pieces, size, done = [], 0, 0

        def keep(lo: int, hi: int) -> None:
            nonlocal size
            while lo < hi:
                i = bisect_right(self.at, lo) - 1
                stop = min(hi, self.at[i + 1] if i + 1 < len(self.at) else hi)
                s, e = self.source(lo, stop)
                out.at.append(size), out.src.append(s), out.src_end.append(e), out.linear.append(self.linear[i])
                pieces.append(self.text[lo:stop])
                size += stop - lo
                lo = stop

        for s, e, new in edits:
            keep(done, s)
            if new:
                a, b = self.source(s, e)
                out.at.append(size), out.src.append(a), out.src_end.append(b), out.linear.append(False)
                pieces.append(new)
                size += len(new)
            done = e
        keep(done, len(self.text))
        out.text = "".join(pieces)
        return out


def _spelled_edits(text: str) -> list[tuple[int, int, str]]:
    edits = []
    for run in _SPELLED_THREE.finditer(text):
        last = None
        for m in re.finditer(rf"(?<!\w)(?:{_WORD})(?!\w)|[0-9]+", run[0], re.I):
            a, b = m.start() + run.start(), m.end() + run.start()
            if last is not None and a > last:
                edits.append((last, a, ""))
            if not m[0][0].isdigit():
                edits.append((a, b, str(_SPELLED[m[0].lower()])))
            last = b
    return edits


def normalise(text: str) -> Mapped | None:
    """The text after all transducers; None if none applies."""
    glyph = not text.isascii() and _GLYPH.search(text)
    out = Mapped(text)
    if glyph:
        out = out.rewrite([(m.start(), m.end(), GLYPHS[m[0]]) for m in _GLYPH.finditer(text)])
    steps = [_spelled_edits] if _SPELLED_THREE.search(out.text) else []
    if _AT_HINT.search(out.text):
        steps += [lambda t: [(*m.span(), "@") for m in _AT.finditer(t)], lambda t: [(*m.span(), ".") for m in _DOT.finditer(t)]]
    if steps:
        steps.append(lambda t: [(*m.span(), "+") for m in _PLUS.finditer(t)])
    changed = bool(glyph)
    for step in steps:
        if edits := step(out.text):
            out, changed = out.rewrite(edits), True
    return out if changed else None


def find(text: str | None) -> tuple[list[Span], list[Span]]:
    """(base spans, added spans), each sorted by start, then kind."""
    if not text:
        return [], []
    failed: list[Span] = []
    base = detect(text, failed)
    more = list(_swallowed(text, failed))
    normal = normalise(text)
    if normal is not None:
        missed: list[Span] = []
        found = detect(normal.text, missed)
        found += _swallowed(normal.text, missed)
        more += [(kind, *normal.source(s, e)) for kind, s, e in found]
    order = lambda x: (x[1], KINDS.index(x[0]), x[2])
    base.sort(key=order)
    added: list[Span] = []
    done, first = 0, 0
    open_: list[Span] = []  # base spans that may reach into what comes
    for kind, s, e in sorted(set(more), key=lambda x: (x[1], -x[2], KINDS.index(x[0]))):
        if s < done:
            continue
        while first < len(base) and base[first][1] < e:
            open_.append(base[first])
            first += 1
        open_ = [x for x in open_ if x[2] > s]
        if all(s <= a and b <= e and (s, e) != (a, b) for _, a, b in open_ if a < e):
            added.append((kind, s, e))
            done = e
    return base, added


def join_spans(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(spans, key=lambda x: (x[1], KINDS.index(x[0]))))


FOUND = T.StructType(
    [
        *(T.StructField(f"n_{k}", T.LongType()) for k in KINDS),
        T.StructField("base_sha256", T.StringType()),
        T.StructField("spans", T.StringType()),
        T.StructField("n_added", T.LongType()),
        T.StructField("redacted", T.StringType()),
    ]
)


def redact(text: str | None, spans: list[Span]) -> str | None:
    """The text with each span replaced by its kind in brackets; of those that begin together the longest."""
    if not spans:
        return text
    out, at = [], 0
    for kind, s, e in sorted(spans, key=lambda x: (x[1], -x[2])):
        if e > at:
            out.append(text[at : max(s, at)] + f"[{kind.upper()}]" if s >= at else "")
            at = e
    return "".join(out) + text[at:]


def annotate(docs: DataFrame, text: str = "text", with_redacted: bool = False) -> DataFrame:
    """``docs`` plus counts of base spans by kind, their digest, all spans and ``n_added``;
    ``redacted`` on demand.  Columns of the names made are replaced, all others pass through.
    """
    docs = docs.drop(*(c for c in FOUND.names[: 7 + with_redacted] if c in docs.columns))
    schema = T.StructType([*docs.schema.fields, *FOUND.fields[: 7 + with_redacted]])
    place = docs.columns.index(text)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for value in batch.column(place):
                t = value.as_py()
                base, added = find(t)
                kinds = [k for k, _, _ in base]
                sha = hashlib.sha256(join_spans(base).encode()).hexdigest()
                row = (*(kinds.count(k) for k in KINDS), sha, join_spans(base + added), len(added))
                rows.append(row + ((redact(t, base + added),) if with_redacted else ()))
            cols = list(zip(*rows, strict=True)) if rows else [()] * (7 + with_redacted)
            types = [pa.int64()] * 4 + [pa.string(), pa.string(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c, t) for c, t in zip(cols, types, strict=False))], names=schema.names)

    return docs.mapInArrow(scan, schema)
