"""Quality rules: divergence of a document from the usual look of its language.

Method: the character-class histogram and the common-word histogram of a document are
compared with those of its language by Jensen-Shannon distance (base 2, 0 to 1).  Short
documents prove little, so each comparison has a minimum length below which it is
skipped.  The references are counted over all documents with a known language: tasks
count words and character classes, Spark adds up, and the ``common`` most frequent words
of each language stay.

A document without a known language is held against the closest reference.  The base
rules (words, symbols, repeated lines and 8-word windows) are exact.

Defined cases: null or empty text has no words and fails the base rules; an empty table
stays empty; without any reference the verdict is True; repeated rows count one by one;
a text of any length is read whole, as a slice of its own.  Columns of the names made are
replaced, all others of whatever names pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from . import common as C

_CLASS_NAMES = ("lower", "upper", "digit", "space", "line", "mark", "symbol", "control", "letter2", "letter3", "letter4", "inner")
_CLASS = np.zeros(256, dtype=np.int64)
_CLASS[:] = 6
_CLASS[0x61:0x7B], _CLASS[0x41:0x5B], _CLASS[0x30:0x3A] = 0, 1, 2
_CLASS[[0x20, 0x09]], _CLASS[[0x0A, 0x0D, 0x0B, 0x0C]] = 3, 4
_CLASS[[ord(c) for c in ".,;:?'\"()-"]] = 5
_CLASS[[*range(0x00, 0x09), *range(0x0E, 0x20), 0x7F]] = 7
_CLASS[0x80:0xC0], _CLASS[0xC0:0xE0], _CLASS[0xE0:0xF0], _CLASS[0xF0:] = 11, 8, 9, 10
_CLASSES = 11

_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_STRIP = b" \t\n\x0b\x0c\r"

BASE = [(n, T.LongType()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]


def class_counts(w: C.Words) -> np.ndarray:
    """Characters of each class in each text (the separator added after a text left out)."""
    n = len(w.text_start)
    owner = np.repeat(np.arange(n), w.text_end - w.text_start + 1)
    counts = np.bincount(owner * 12 + _CLASS[w.data], minlength=12 * n).reshape(n, 12)[:, :_CLASSES]
    counts[:, 4] -= 1
    return counts


def base_counts(texts: list[bytes], w: C.Words, h: np.ndarray, window: int = 8) -> np.ndarray:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of each text."""
    n = len(texts)
    out = np.zeros((n, 5), dtype=np.int64)
    out[:, 0] = np.diff(w.first)
    bounds = np.append(w.text_start, len(w.data))
    starts_char = (w.data & 0xC0) != 0x80
    out[:, 1] = C.per_text(starts_char & ~C.SPACE[w.data], bounds)
    out[:, 2] = C.per_text(_SYMBOL[w.data], bounds)
    for i, t in enumerate(texts):
        lines = t.split(b"\n")
        if len(lines) > 1 and len(set(lines)) < len(lines):
            lines = [x for x in lines if x.strip(_STRIP)]
            out[i, 3] = len(lines) - len(set(lines))
    g = C.window_hashes(h, window)
    if len(g):
        owner = w.owner()
        whole = np.flatnonzero(owner[: len(g)] == owner[window - 1 :])
        key = g[whole] ^ C.mix64(owner[whole].astype(np.uint64) + np.uint64(1))
        order = np.argsort(key)
        s = key[order]
        same = s[1:] == s[:-1]
        twice = np.zeros(len(s), dtype=bool)
        twice[1:] |= same
        twice[:-1] |= same
        mask = C.covered(np.sort(whole[order[twice]]), window, len(h))
        out[:, 4] = C.per_text(mask, w.first)
    return out


def js_distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance of each row of counts p from the counts q."""
    p = p / np.maximum(p.sum(axis=-1, keepdims=True), 1)
    q = q / max(q.sum(), 1)
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        a = np.where(p > 0, p * np.log2(p / m), 0).sum(axis=-1)
        b = np.where(q > 0, q * np.log2(q / m), 0).sum(axis=-1)
    return np.sqrt(np.clip((a + b) / 2, 0, 1))


# --------------------------------------------------------------------------- references


def _lower_words(texts: list[bytes]) -> tuple[C.Words, np.ndarray]:
    w = C.Words([C.lower_ascii(t) for t in texts], C.SPACE)
    return w, C.word_hashes(w)


def _slices(batches: Iterator[pa.RecordBatch]):
    for batch in batches:
        langs = batch.column(1).to_pylist()
        for lo, texts in C.text_slices(batch.column(0)):
            yield langs[lo : lo + len(texts)], texts


#: Distinct words a task gathers before it hands on their counts.
GATHER = 1 << 20


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, h, n) of the words and, with null h, (lang, k, n) of the character classes."""
    held: dict[str, list[np.ndarray]] = {}
    classes: dict[str, np.ndarray] = {}
    size = 0

    def out(lang: str, words: list[np.ndarray]) -> pa.RecordBatch:
        h, at = np.unique(np.concatenate([x[0] for x in words]), return_inverse=True)
        n = np.bincount(at, weights=np.concatenate([x[1] for x in words])).astype(np.int64)
        return pa.RecordBatch.from_arrays([pa.array([lang] * len(h), pa.string()), pa.array(h.view(np.int64)), pa.nulls(len(h), pa.int32()), pa.array(n)], names=["lang", "h", "k", "n"])

    for langs, texts in _slices(batches):
        w, h = _lower_words(texts)
        owner = w.owner()
        by_text = class_counts(C.Words(texts, C.SPACE))
        names = np.array(langs, dtype=object)
        for name in set(langs) - {None}:
            words, n = np.unique(h[(names == name)[owner]], return_counts=True)
            held.setdefault(name, []).append((words, n))
            size += len(words)
            classes[name] = classes.get(name, 0) + by_text[names == name].sum(axis=0)
        if size > GATHER:
            for name, words in held.items():
                yield out(name, words)
            held, size = {}, 0
    for name, words in held.items():
        yield out(name, words)
    for name, total in classes.items():
        yield pa.RecordBatch.from_arrays([pa.array([name] * _CLASSES, pa.string()), pa.nulls(_CLASSES, pa.int64()), pa.array(np.arange(_CLASSES), pa.int32()), pa.array(total)], names=["lang", "h", "k", "n"])


def references(docs: DataFrame, common: int = 64, text: str = "text", lang: str = "lang") -> dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """{language: (class counts, hashes of common words, their counts and the rest's)}, over all rows.

    All words are counted, so the result is the same however the rows lie.  Of words equally
    common those of lesser hashes count as more common.  The driver holds ``common`` numbers for
    each language, whatever the corpus size.
    """
    slim = docs.select(F.col(text).alias("t"), F.col(lang).alias("l")).filter("l is not null")
    counted = C.settle(slim.mapInArrow(_count, "lang string, h long, k int, n long").groupBy("lang", "h", "k").agg(F.sum("n").alias("n")))
    words = counted.filter("h is not null")
    # The rank is limited before the shuffle as well, so no task sorts a language's words.
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "h"))
    top = words.withColumn("r", rank).filter(F.col("r") <= common).select("lang", "h", "n").collect()
    totals = {r["lang"]: r["n"] for r in words.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    classes = counted.filter("k is not null").select("lang", "k", "n").collect()
    C.release(counted)
    out = {}
    for name in sorted({r["lang"] for r in classes}):
        mine = sorted((r["h"] % (1 << 64), r["n"]) for r in top if r["lang"] == name)
        n = np.array([c for _, c in mine], dtype=np.int64)
        by_class = {r["k"]: r["n"] for r in classes if r["lang"] == name}
        out[name] = (np.array([by_class[k] for k in range(_CLASSES)]), np.array([h for h, _ in mine], dtype=np.uint64), np.append(n, totals.get(name, 0) - n.sum()))
    return out


# ----------------------------------------------------------------------------- verdicts


def judge(
    docs: DataFrame,
    text: str = "text",
    lang: str = "lang",
    common: int = 64,
    max_class_distance: float = 0.3,
    max_word_distance: float = 0.42,
    min_chars: int = 400,
    min_words: int = 100,
    reference: dict | None = None,
) -> DataFrame:
    """``docs`` plus the base counts, ``class_distance``, ``word_distance`` (null where the
    text is too short to tell), ``base_failed`` and ``kept``; such columns are replaced.
    """
    more = [*BASE, ("class_distance", T.DoubleType()), ("word_distance", T.DoubleType()), ("base_failed", T.BooleanType()), ("kept", T.BooleanType())]
    known = references(docs, common, text, lang) if reference is None else reference
    docs = docs.drop(*(n for n, _ in more if n in docs.columns))
    shared = docs.sparkSession.sparkContext.broadcast(known)
    schema = T.StructType([*docs.schema.fields, *(T.StructField(n, t) for n, t in more)])
    at_text, at_lang = docs.columns.index(text), docs.columns.index(lang)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        refs = shared.value
        for batch in batches:
            langs = batch.column(at_lang).to_pylist()
            parts = []
            for lo, texts in C.text_slices(batch.column(at_text)):
                parts.append(_score_slice(texts, langs[lo : lo + len(texts)], refs, min_chars, min_words))
            base = np.concatenate([p[0] for p in parts]) if parts else np.zeros((0, 5), dtype=np.int64)
            far = np.concatenate([p[1] for p in parts]) if parts else np.zeros((0, 2))
            failed = (base[:, 0] < 20) | (100 * base[:, 4] > 30 * base[:, 0])
            odd = (far[:, 0] > max_class_distance) | (far[:, 1] > max_word_distance)
            cols = [pa.array(base[:, i]) for i in range(5)] + [pa.array(far[:, i], from_pandas=True) for i in range(2)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *cols, pa.array(failed), pa.array(~failed & ~odd)], names=schema.names)

    return docs.mapInArrow(score, schema)


def _score_slice(texts: list[bytes], langs: list[str | None], refs: dict, min_chars: int, min_words: int):
    w = C.Words(texts, C.SPACE)
    base = base_counts(texts, w, C.word_hashes(w))
    classes = class_counts(w)
    lower, h = _lower_words(texts)
    far = np.full((len(texts), 2, max(1, len(refs))), np.nan)
    names = list(refs)
    owner = lower.owner()
    for j, name in enumerate(names):
        class_ref, words, word_ref = refs[name]
        far[:, 0, j] = js_distance(classes, class_ref)
        if len(words):
            k = np.minimum(np.searchsorted(words, h), len(words) - 1)
            k[words[k] != h] = len(words)
            counts = np.bincount(owner * (len(words) + 1) + k, minlength=len(texts) * (len(words) + 1)).reshape(len(texts), -1)
            far[:, 1, j] = js_distance(counts, word_ref)
    out = np.full((len(texts), 2), np.nan)
    if names:
        own = np.array([names.index(x) if x in refs else -1 for x in langs])
        nearest = np.argmin(np.nan_to_num(far, nan=0).sum(axis=1), axis=1)
        pick = np.where(own >= 0, own, nearest)
        out = far[np.arange(len(texts)), :, pick]
    out[classes.sum(axis=1) < min_chars, 0] = np.nan
    out[base[:, 0] < min_words, 1] = np.nan
    return base, out
