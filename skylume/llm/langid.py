"""Language identification in two steps: family first, then close relatives.

Method: hashed byte n-grams (1 to 3) of the lower-cased text, square roots of their
shares, unit length.  Linear support vector machines first pick the language family (one
against one between families), then one-versus-one machines separate the languages
within it.  All machines are linear, so a document costs one histogram and one product.

Training uses a bounded sample: about ``per_language`` labelled rows a language (default
500, chosen by a hash of the id and text; all rows where there are fewer).  Prediction
reads every text whole and uses nothing but the text.

Defined cases: a null text or one without a letter is ``und`` with score 0; without any
training row all are ``und``; with one language all texts with a letter are that
language, score 1; a null id is neither learnt from nor held out; repeated rows are
judged one by one; unknown language codes form a family of their own.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as C

#: Features (a power of two), rows held at once.
DIM, ROWS = 1 << 12, 256

# Families of ISO 639-1 codes.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af lb fy yi",
    "romance": "fr es it pt ro ca gl oc",
    "slavic": "ru uk be pl cs sk sl hr sr bs mk bg",
    "baltic": "lt lv",
    "uralic": "fi et hu",
    "turkic": "tr az kk uz ky tk",
    "celtic": "ga cy gd br",
    "indic": "hi bn ur pa gu mr ne si",
    "semitic": "ar he am mt",
    "sinitic": "zh yue",
}
_FAMILY = {code: name for name, codes in FAMILIES.items() for code in codes.split()}


def family(lang: str) -> str:
    return _FAMILY.get(lang.lower().split("-")[0].split("_")[0], "other")


def features(texts: list[bytes]) -> np.ndarray:
    """One unit row of float32 a text (zero for an empty one)."""
    n = len(texts)
    data = np.frombuffer(b"".join(b" " + C.lower_ascii(t) + b" " for t in texts), dtype=np.uint8)
    length = np.fromiter((len(t) + 2 for t in texts), dtype=np.int64, count=n)
    b = data.astype(np.uint32)
    b[C.SPACE[data]] = 0x20
    owner = np.repeat(np.arange(n, dtype=np.int64) * DIM, length)
    shift = np.uint32(32 - DIM.bit_length() + 1)
    out = np.zeros(n * DIM, dtype=np.float32)
    for k in (1, 2, 3):
        if len(b) < k:
            break
        code = np.full(len(b) - k + 1, k, dtype=np.uint32)
        for j in range(k):
            code = code * np.uint32(257) + b[j : len(b) - k + 1 + j]
        at = (code * np.uint32(2654435761) >> shift).astype(np.int64)
        first, last = owner[: len(at)], owner[k - 1 :]
        ok = first == last
        out += np.bincount(first[ok] + at[ok], minlength=n * DIM).astype(np.float32)
    out = np.sqrt(out.reshape(n, DIM))
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


def train_svm(x: np.ndarray, y: np.ndarray, cost: float = 10.0, rounds: int = 300) -> tuple[np.ndarray, float]:
    """Linear machine with squared hinge loss (y is -1 or 1), by accelerated gradient steps."""
    weight = np.where(y > 0, len(y) / (2 * max(1, (y > 0).sum())), len(y) / (2 * max(1, (y < 0).sum())))
    w, b, vw, vb = np.zeros(x.shape[1], dtype=np.float32), 0.0, np.zeros(x.shape[1], dtype=np.float32), 0.0
    rate = 1.0 / (1.0 + 4 * cost)
    for k in range(rounds):
        fast = k / (k + 3)
        aw, ab = w + fast * (w - vw), b + fast * (b - vb)
        slack = np.maximum(0, 1 - y * (x @ aw + ab)) * weight
        g = -(2 * cost / len(y)) * (slack * y)
        vw, vb = w, b
        w = aw - rate * (aw / len(y) + x.T @ g)
        b = ab - rate * float(g.sum())
    return w.astype(np.float32), float(b)


@dataclass
class Model:
    languages: list[str] = field(default_factory=list)
    families: list[str] = field(default_factory=list)
    #: Machines (a, b, weights, bias): positive speaks for b's rival a.
    between: list[tuple] = field(default_factory=list)
    within: dict[str, list[tuple]] = field(default_factory=dict)

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index into ``languages`` and a score from 0 to 1 of each row."""
        if not self.languages:
            return np.full(len(x), -1), np.zeros(len(x))
        fam, sure = _vote(x, self.families, self.between)
        lang, score = np.zeros(len(x), dtype=np.int64), np.array(sure)
        for i, name in enumerate(self.families):
            rows = np.flatnonzero(fam == i)
            own = [x for x in self.languages if family(x) == name]
            pick, inner = _vote(x[rows], own, self.within.get(name, []))
            lang[rows] = np.array([self.languages.index(o) for o in own])[pick]
            score[rows] *= inner
        return lang, score


def _vote(x: np.ndarray, names: list[str], machines: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
    """Winner of the duels (most wins, then largest margin sum) and its mean logistic margin."""
    if not machines:
        return np.zeros(len(x), dtype=np.int64), np.ones(len(x))
    wins, margin = np.zeros((len(x), len(names))), np.zeros((len(x), len(names)))
    for a, b, w, bias in machines:
        z = x @ w + bias
        p = 1 / (1 + np.exp(-2 * np.clip(z, -30, 30)))
        for k, q in ((names.index(a), p), (names.index(b), 1 - p)):
            wins[:, k] += q > 0.5
            margin[:, k] += q
    best = np.argmax(wins * len(names) * 2 + margin, axis=1)
    return best, margin[np.arange(len(x)), best] / (len(names) - 1)


def fit(x: np.ndarray, labels: list[str]) -> Model:
    langs = sorted(set(labels))
    fams = sorted({family(x) for x in langs})
    names, kin = np.array(labels, dtype=object), np.array([family(x) for x in labels], dtype=object)

    def duels(of: np.ndarray, among: list[str]) -> list[tuple]:
        out = []
        for a, b in itertools.combinations(among, 2):
            rows = np.flatnonzero((of == a) | (of == b))
            out.append((a, b, *train_svm(x[rows], np.where(of[rows] == a, 1, -1).astype(np.float32))))
        return out

    return Model(langs, fams, duels(kin, fams), {f: duels(names, [x for x in langs if family(x) == f]) for f in fams})


def train(labelled: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", per_language: int = 500) -> Model:
    """Fit on about ``per_language`` rows of each language with a text (all if fewer)."""
    rows = labelled.filter(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(F.col(text).alias("t"), F.col(lang).alias("l"), F.col(doc_id).cast("string").alias("d"))
    counts = {r["l"]: r["count"] for r in rows.groupBy("l").count().collect()}
    if not counts:
        return Model()
    grain = 1 << 30
    share = F.create_map(*[F.lit(v) for name, n in sorted(counts.items()) for v in (name, -(-per_language * grain // n))])
    sample = rows.filter(F.pmod(F.xxhash64("d", "t"), F.lit(grain)) < share[F.col("l")]).select("t", "l")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = batch.column(1).to_pylist()
            for lo, texts in C.text_slices(batch.column(0), rows=ROWS):
                x = features(texts)
                yield pa.RecordBatch.from_arrays([pa.array(langs[lo : lo + len(texts)], pa.string()), pa.array([r.tobytes() for r in x.astype(np.float16)], pa.binary())], names=["l", "x"])

    got = sorted((r["l"], bytes(r["x"])) for r in sample.mapInArrow(encode, "l string, x binary").collect())
    return fit(np.stack([np.frombuffer(x, dtype=np.float16) for _, x in got]).astype(np.float32), [name for name, _ in got])


_LETTERS = np.zeros(256, dtype=bool)
_LETTERS[0x41:0x5B] = _LETTERS[0x61:0x7B] = True


def _has_letter(text: bytes) -> bool:
    if not text:
        return False
    if _LETTERS[np.frombuffer(text[:256], dtype=np.uint8)].any():
        return True
    return any(c.isalpha() for c in text.decode("utf-8", "replace"))


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` plus ``lang_pred`` and ``score`` (replaced if already there)."""
    docs = docs.drop("lang_pred", "score")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    place = docs.columns.index(text)

    def tag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            names: list[str] = []
            scores: list[float] = []
            for _, texts in C.text_slices(batch.column(place), rows=ROWS):
                pick, score = m.predict(features(texts))
                for t, k, s in zip(texts, pick.tolist(), score.tolist(), strict=True):
                    known = k >= 0 and _has_letter(t)
                    names.append(m.languages[k] if known else "und")
                    scores.append(min(1.0, max(0.0, s)) if known else 0.0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=schema.names)

    return docs.mapInArrow(tag, schema)


def fold(doc_id: str = "doc_id", folds: int = 5) -> Column:
    """crc32 of the id as text, modulo ``folds`` (null for a null id)."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(folds))
