"""Benchmark decontamination: find and remove benchmark passages in documents.

Method: the normalised n-grams (windows of ``window`` words) of the benchmark are
a hash set sent to every executor; each text's token windows are scanned against
it, hits are verified word by word, and spans or documents are removed.

The set is sorted arrays of hashes with the items' words beside them.  It is broadcast only
while the benchmark holds at most ``BROADCAST_BYTES`` of text; beyond that the windows of both sides meet in a shuffle join on
(size, hash, words), which gives the same result.

Defined cases: null or empty texts have no words; an item of fewer words than a
window is one window of its own; an item without words or with a null id never
matches; an empty benchmark leaves all clean; repeated rows are judged one by one;
texts are scanned whole, in slices of bounded size.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as C

#: Benchmark text broadcast at most; with its windows as arrays it takes about five times that.
BROADCAST_BYTES = 32 << 20
#: Bits of the table that turns most windows away before the binary search.
_SIEVE_BITS = 22
#: Verified windows a task remembers.
_KNOWN = 1 << 16


class Windows:
    """The benchmark's windows as arrays: about 20 bytes each beside the words themselves.

    ``words[size]`` holds, for windows of that size, the normalised words of their items, joined
    by blanks; a window is the bytes from ``start`` to ``end``.  Windows are sorted by hash.
    """

    def __init__(self, rows: list[tuple], window: int):
        parts: dict[int, list[tuple]] = {}
        self.ids: list = []
        for item, text in rows:
            if item is None or not text:
                continue
            w = C.Words([C.lower_ascii(text.encode())], C.NOT_ALNUM)
            if not len(w.start):
                continue
            size = min(window, len(w.start))
            joined = b" ".join([w.buffer[s:e] for s, e in zip(w.start.tolist(), w.end.tolist(), strict=True)])
            ends = np.cumsum(w.end - w.start + 1) - 1
            starts = np.concatenate(([0], ends[:-1] + 1))
            h = C.window_hashes(C.word_hashes(w), size)
            parts.setdefault(size, []).append((joined, h, starts[: len(h)], ends[size - 1 :], len(self.ids)))
            self.ids.append(item)
        self.sizes, self.words = {}, {}
        for size, found in parts.items():
            self.words[size] = b" ".join([x[0] for x in found])
            length = np.array([len(x[0]) + 1 for x in found])
            base = np.cumsum(length) - length
            h = np.concatenate([x[1] for x in found])
            order = np.argsort(h, kind="stable")
            start = np.concatenate([x[2] + k for x, k in zip(found, base, strict=True)])[order]
            span = np.concatenate([x[3] - x[2] for x in found])[order].astype(np.int32)
            item = np.concatenate([np.full(len(x[1]), x[4], dtype=np.int32) for x in found])[order]
            self.sizes[size] = (h[order], start, span, item)

    def items(self, size: int, h: np.uint64, words: bytes) -> set:
        """Ids of the items that have this window, compared byte by byte."""
        hashes, start, span, item = self.sizes[size]
        out, text, k = set(), self.words[size], int(np.searchsorted(hashes, h))
        while k < len(hashes) and hashes[k] == h:
            if span[k] == len(words) and text[start[k] : start[k] + span[k]] == words:
                out.add(self.ids[item[k]])
            k += 1
        return out


class _Sets:
    """The windows by size, with a sieve that turns most of a document's away before the search."""

    def __init__(self, windows: Windows):
        self.windows, self.sieves, self.known = windows, {}, {}
        for size, (hashes, *_) in windows.sizes.items():
            sieve = np.zeros(1 << _SIEVE_BITS, dtype=bool)
            sieve[(hashes >> np.uint64(64 - _SIEVE_BITS)).astype(np.int64)] = True
            self.sieves[size] = sieve

    def hits(self, w: C.Words):
        """(window size, first words of verified windows, items of each)."""
        h = C.word_hashes(w)
        owner = w.owner()
        for size, sieve in self.sieves.items():
            hashes = self.windows.sizes[size][0]
            g = C.window_hashes(h, size)
            at = np.flatnonzero(sieve[(g >> np.uint64(64 - _SIEVE_BITS)).astype(np.int64)])
            if not len(at):
                continue
            at = at[owner[at] == owner[at + size - 1]]
            k = np.minimum(np.searchsorted(hashes, g[at]), len(hashes) - 1)
            at = at[hashes[k] == g[at]]
            sure, items = [], []
            for i, starts, ends in zip(at.tolist(), (w.start[at[:, None] + np.arange(size)]).tolist(), (w.end[at[:, None] + np.arange(size)]).tolist(), strict=True):
                words = b" ".join([w.buffer[s:e] for s, e in zip(starts, ends, strict=True)])
                found = self.known.get((size, words))
                if found is None:
                    if len(self.known) >= _KNOWN:
                        self.known.clear()
                    found = self.known[size, words] = self.windows.items(size, g[i], words)
                if found:
                    sure.append(i)
                    items.append(found)
            if sure:
                yield size, np.array(sure), items


def _digest(items) -> str:
    return hashlib.sha256(",".join(sorted(map(str, items))).encode()).hexdigest()


def _spans(mask: np.ndarray, lo: int, hi: int, w: C.Words, base: int) -> list[tuple[int, int]]:
    """Byte spans (from the text's start) of the runs of hit words lo .. hi."""
    step = np.diff(mask[lo:hi].astype(np.int8), prepend=0, append=0)
    return [(int(w.start[lo + a]) - base, int(w.end[lo + b - 1]) - base) for a, b in zip(np.flatnonzero(step == 1), np.flatnonzero(step == -1), strict=True)]


def _judge(texts: list[bytes], sets: _Sets):
    """Per text: words, hit words, items, byte spans of hit words."""
    w = C.Words([C.lower_ascii(t) for t in texts], C.NOT_ALNUM)
    mask = np.zeros(len(w.start), dtype=bool)
    items: dict[int, set[int]] = {}
    owner = w.owner()
    for size, at, found in sets.hits(w):
        mask |= C.covered(at, size, len(mask))
        for i, ids in zip(owner[at].tolist(), found, strict=True):
            items.setdefault(i, set()).update(ids)
    n_hit = C.per_text(mask, w.first)
    for i in range(len(texts)):
        spans = _spans(mask, w.first[i], w.first[i + 1], w, int(w.text_start[i])) if n_hit[i] else []
        yield int(w.first[i + 1] - w.first[i]), int(n_hit[i]), items.get(i, set()), spans


VERDICT = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("n_hit", T.LongType()),
        T.StructField("n_items", T.LongType()),
        T.StructField("items_sha256", T.StringType()),
        T.StructField("kept_text", T.StringType()),
    ]
)


def _cut(text: bytes, spans: list[tuple[int, int]]) -> str:
    out, at = [], 0
    for s, e in spans:
        out.append(text[at:s])
        at = e
    return b"".join([*out, text[at:]]).decode("utf-8", "replace")


def annotate(docs: DataFrame, benchmark: DataFrame, window: int = 10, text: str = "text", item_id: str = "item_id", item_text: str = "text", keep_text: bool = False) -> DataFrame:
    """``docs`` plus n_words, n_hit, n_items, items_sha256; with ``keep_text`` also
    kept_text, the text without its hit spans.  Columns of the names made are replaced, all others,
    of whatever names, pass through.
    """
    docs = docs.drop(*(c for c in VERDICT.names[: 4 + keep_text] if c in docs.columns))
    items = benchmark.select(F.col(item_id).alias("i"), F.col(item_text).alias("t"))
    size = items.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    if size > BROADCAST_BYTES:
        return _annotate_by_join(docs, items, window, text, keep_text)
    sc = docs.sparkSession.sparkContext
    windows = sc.broadcast(Windows([(r.i, r.t) for r in items.collect()], window))
    out = T.StructType([*docs.schema.fields, *VERDICT.fields[: 4 + keep_text]])
    place = docs.columns.index(text)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = _Sets(windows.value)
        for batch in batches:
            rows = []
            for _, texts in C.text_slices(batch.column(place)):
                for t, (n, hit, ids, spans) in zip(texts, _judge(texts, sets), strict=True):
                    rows.append((n, hit, len(ids), _digest(ids), _cut(t, spans) if keep_text and spans else None))
            n, hit, k, sha, kept = zip(*rows, strict=True) if rows else ((), (), (), (), ())
            more = [pa.array(n, pa.int64()), pa.array(hit, pa.int64()), pa.array(k, pa.int64()), pa.array(sha, pa.string())]
            if keep_text:
                was = batch.column(place)
                more.append(pa.compute.coalesce(pa.array(kept, pa.string()), was) if len(rows) else was)
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=out.names)

    return docs.mapInArrow(scan, out)


def _annotate_by_join(docs: DataFrame, items: DataFrame, window: int, text: str, keep_text: bool) -> DataFrame:
    """The way for a benchmark too large to broadcast: windows meet by their words."""
    split = lambda c: F.filter(F.split(F.translate(c, C_UPPER, C_UPPER.lower()), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", -1), lambda x: x != "")
    grams = lambda words, size: F.transform(F.sequence(F.lit(1), F.size(words) - size + 1), lambda i: F.array_join(F.slice(words, i, size), " "))
    w = items.filter("i is not null and t is not null").select("i", split(F.col("t")).alias("w")).filter(F.size("w") > 0).withColumn("m", F.least(F.size("w"), F.lit(window)))
    wanted = w.select("i", "m", F.explode(F.array_distinct(grams(F.col("w"), F.col("m")))).alias("g"))
    wanted = C.settle(wanted)
    present = sorted(r["m"] for r in wanted.select("m").distinct().collect())  # at most ``window`` numbers
    sizes = F.array(*[F.lit(m) for m in present]) if present else F.array().cast("array<int>")
    slim = C.packed(docs, text)
    texts = slim.filter(F.col(text).isNotNull()).select(F.sha2(text, 256).alias("__key"), F.col(text).alias("t")).dropDuplicates(["__key"])
    seen = (
        texts.select("__key", split(F.col("t")).alias("w"))
        .select("__key", "w", F.explode(sizes).alias("m"))
        .filter(F.size("w") >= F.col("m"))
        .select("__key", "m", F.posexplode(grams(F.col("w"), F.col("m"))).alias("p", "g"))
    )
    hit = seen.join(wanted, ["m", "g"])
    found = hit.groupBy("__key").agg(F.collect_set(F.struct("p", "m")).alias("at"), F.collect_set("i").alias("ids"))
    ids = F.array_sort(F.transform("ids", lambda i: i.cast("string")))
    found = found.select("__key", F.col("at").alias("__at"), F.size("ids").cast("long").alias("n_items"), F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"))
    place = docs.columns.index(text)
    joined = slim.withColumn("__key", F.sha2(text, 256)).join(found, "__key", "left")
    # Made columns come last; one of the same name in ``docs`` was dropped before.
    joined = C.unpacked(joined, docs, (text,), ("n_items", "items_sha256", "__at"))
    out = T.StructType([*docs.schema.fields, *VERDICT.fields[: 4 + keep_text]])
    k = len(docs.columns)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, n, hit_n, kept = batch.column(k + 2).to_pylist(), [], [], []
            for lo, texts in C.text_slices(batch.column(place)):
                w = C.Words([C.lower_ascii(t) for t in texts], C.NOT_ALNUM)
                mask = np.zeros(len(w.start), dtype=bool)
                for i in range(len(texts)):
                    for x in at[lo + i] or ():
                        mask[w.first[i] + x["p"] : w.first[i] + x["p"] + x["m"]] = True
                    n.append(int(w.first[i + 1] - w.first[i]))
                    hit_n.append(int(mask[w.first[i] : w.first[i + 1]].sum()))
                    kept.append(_cut(texts[i], _spans(mask, w.first[i], w.first[i + 1], w, int(w.text_start[i]))) if keep_text and hit_n[-1] else None)
            more = [pa.array(n, pa.int64()), pa.array(hit_n, pa.int64()), pa.compute.fill_null(batch.column(k), 0), pa.compute.fill_null(batch.column(k + 1), _digest(()))]
            if keep_text:
                more.append(pa.compute.coalesce(pa.array(kept, pa.string()), batch.column(place)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:k], *more], names=out.names)

    return joined.mapInArrow(mark, out)


C_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def remove_spans(docs: DataFrame, benchmark: DataFrame, window: int = 10, text: str = "text") -> DataFrame:
    """``docs`` with benchmark passages cut out of ``text``."""
    found = annotate(C.packed(docs, text), benchmark, window, text, keep_text=True)
    return C.unpacked(found.withColumn(text, F.col("kept_text")), docs, (text,))


def remove_documents(docs: DataFrame, benchmark: DataFrame, window: int = 10, text: str = "text") -> DataFrame:
    """``docs`` without the rows that hold any benchmark window."""
    return C.unpacked(annotate(C.packed(docs, text), benchmark, window, text).filter("n_hit = 0"), docs, (text,))
