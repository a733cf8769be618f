"""Suffix-array dedup: bytes covered by a long string that also starts somewhere else go.

The judgement is exact and on the input: a window of ``size`` bytes is repeated if an equal
window starts anywhere else, the same document included.

Method: suffix arrays by linear grouping (``suffix_array``) decide which windows repeat.  A
suffix array of all texts at once would not distribute, so windows are first dealt into
groups outside which none can have an equal:

1. The anchor of a window is its least hashed gram of ``gram`` bytes (the leftmost of equal
   ones), so equal windows have equal anchors at equal places.  The windows of one anchor are a
   run; the bytes they cover are its context.  An anchor whose gram occurs once has no repeats;
   one whose contexts are all equal, twice or more, repeats whole.
2. Contexts of the other anchors meet by gram.  Within a gram, windows at the same ``cell`` of
   places before the anchor share a core; sub-contexts alone with their core cannot repeat and
   sub-contexts found twice repeat whole.
3. What is left is packed with the shared core as a single symbol into a block, whose suffix
   array puts equal windows side by side.

Grams with more than ``hot`` contexts skip steps 2 and 3: their windows are counted by hash
across the cluster, so that no task holds a hot gram's contexts.

A fixed-size bit table (``FILTER_BITS``) tells tasks which anchors may repeat; false alarms
are removed by exact joins.  Texts never travel but for the contexts of step 2, and once at
the end to be cut.  Contexts and cells are told apart by 128-bit keys of hashes.

Defined cases: null and empty texts have no bytes; texts below ``size`` bytes lose nothing;
repeated rows are separate documents, so they remove each other; null ids are kept.
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
from .suffix_array import suffix_array

FILTER_BITS = 26
#: Context bytes a task takes into one block.
BLOCK_BYTES = 8 << 20
_PLACE = np.uint64(28)


# ------------------------------------------------------------------------------ anchors


class _Rolling:
    """Hashes of any substring of a buffer, by prefix sums."""

    def __init__(self, data: np.ndarray):
        self.total = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(C._BYTE[data] * C._power(C._P, len(data)), out=self.total[1:])
        self.back = C._power(C._P, len(data) + 1, inverse=True)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return C.mix64((self.total[end] - self.total[start]) * self.back[start] ^ (end - start).astype(np.uint64))


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    reach = 1
    while 2 * reach <= width:
        x = np.minimum(x[:-reach], x[reach:])
        reach *= 2
    rest = width - reach
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


def anchors(texts: list[bytes], size: int, gram: int):
    """(text, first window, windows, anchor, gram hash, context hash) of every run; places are
    from the text's start."""
    length = np.fromiter((len(t) for t in texts), dtype=np.int64, count=len(texts))
    begin = np.cumsum(length) - length
    buffer = b"".join(texts)
    none = np.zeros(0, dtype=np.int64)
    if len(buffer) < size:
        return none, none, none, none, none.view(np.uint64), none.view(np.uint64), buffer
    data = np.frombuffer(buffer, dtype=np.uint8)
    rolling = _Rolling(data)
    m = len(data) - gram + 1
    raw = (rolling.total[gram:] - rolling.total[:-gram]) * rolling.back[:m]
    key = (C.mix64(raw) >> _PLACE << _PLACE) | np.arange(m, dtype=np.uint64)
    at = (_sliding_min(key, size - gram + 1) & np.uint64((1 << 28) - 1)).astype(np.int64)
    owner = np.repeat(np.arange(len(texts)), length)
    windows = np.flatnonzero(owner[: len(at)] == owner[size - 1 :][: len(at)])
    if not len(windows):
        return none, none, none, none, none.view(np.uint64), none.view(np.uint64), buffer
    spot, text = at[windows], owner[windows]
    new = np.flatnonzero(np.concatenate(([True], (np.diff(spot) != 0) | (np.diff(text) != 0) | (np.diff(windows) != 1))))
    lo, n = windows[new], np.diff(np.append(new, len(windows)))
    spot, text = spot[new], text[new]
    context = rolling.of(lo, lo + n - 1 + size) + C.mix64((spot - lo).astype(np.uint64))
    base = begin[text]
    return text, lo - base, n, spot - base, rolling.of(spot, spot + gram), context, buffer


def _runs(batches: Iterator[pa.RecordBatch], size: int, gram: int, column: int = 0):
    for batch in batches:
        for lo, texts in C.text_slices(batch.column(column)):
            yield batch, lo, texts, anchors(texts, size, gram)


def _in_filter(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    slot = (h & np.uint64((1 << FILTER_BITS) - 1)).astype(np.int64)
    return (bits[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 == 1


def _filter_of(grams: DataFrame) -> np.ndarray:
    """Bit table of the grams' low bits, built by Spark in pieces of 4 KiB."""
    slot = F.col("g").bitwiseAND(F.lit((1 << FILTER_BITS) - 1)) + 1  # the bitmap functions count from 1
    pieces = grams.groupBy(F.bitmap_bucket_number(slot).alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("bits"))
    out = np.zeros((1 << FILTER_BITS) // 8, dtype=np.uint8)
    for r in pieces.collect():
        at = (r["b"] - 1) * 4096
        out[at : at + len(r["bits"])] |= np.frombuffer(bytes(r["bits"]), dtype=np.uint8)
    return out


def gram_table(texts: DataFrame, size: int, gram: int) -> DataFrame:
    """(g, n, rows, c, mixed): grams of two anchors or more; mixed if their contexts differ.

    ``rows`` counts contexts after equal ones of a slice of texts have become one.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, _, (_, _, _, _, g, c, _) in _runs(batches, size, gram):
            order = np.lexsort((c, g))
            g, c = g[order], c[order]
            new = np.flatnonzero(np.concatenate(([True], (np.diff(g) != 0) | (np.diff(c) != 0)))) if len(g) else order
            n = np.diff(np.append(new, len(g)))
            yield pa.RecordBatch.from_arrays([pa.array(g[new].view(np.int64)), pa.array(c[new].view(np.int64)), pa.array(n)], names=["g", "c", "n"])

    rows = texts.mapInArrow(count, "g long, c long, n long")
    counts = rows.groupBy("g").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("rows"), F.min("c").alias("c"), F.max("c").alias("c_max"))
    return counts.filter("n > 1").select("g", "n", "rows", "c", (F.col("c") != F.col("c_max")).alias("mixed"))


# ------------------------------------------------------------------------------- blocks


def _distinct(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(group of each row, number of groups) by several keys."""
    order = np.lexsort(keys)
    new = np.zeros(len(order), dtype=bool)
    for k in keys:
        s = k[order]
        new[1:] |= s[1:] != s[:-1]
    group = np.empty(len(order), dtype=np.int64)
    group[order] = np.cumsum(new)
    return group, int(group.max(initial=-1)) + 1


def repeated_windows(g: np.ndarray, count: np.ndarray, before: np.ndarray, windows: np.ndarray, contexts: list[bytes], size: int, gram: int, cell: int):
    """Mask over all windows (context after context) of those with an equal window elsewhere.

    ``g`` is each context's gram, ``count`` its occurrences, ``before`` its first window's
    distance to the anchor.  Equal contexts must come as one.
    """
    first = np.cumsum(windows) - windows
    mask = np.zeros(int(windows.sum()), dtype=bool)
    whole = count > 1
    mask[:] = np.repeat(whole, windows)
    buffer = np.frombuffer(b"".join(contexts), dtype=np.uint8)
    length = np.fromiter((len(x) for x in contexts), dtype=np.int64, count=len(contexts))
    base = np.cumsum(length) - length
    rolling = _Rolling(buffer)
    low = (before - windows + 1) // cell
    cells = before // cell - low + 1
    row = np.repeat(np.arange(len(g)), cells)
    c = np.repeat(low, cells) + np.arange(len(row)) - np.repeat(np.cumsum(cells) - cells, cells)
    core = before[row] - c * cell  # where the core starts, from the context's start
    lo, hi = np.maximum(0, core - cell + 1), np.minimum(windows[row] - 1, core)
    width = size - cell + 1
    core_hash = rolling.of(base[row] + core, base[row] + core + width)
    part_hash = rolling.of(base[row] + lo, base[row] + hi + size) + (core - lo).astype(np.uint64)
    group, n_groups = _distinct(core_hash, c, g[row])
    part, n_parts = _distinct(part_hash, group)
    times = np.bincount(part, weights=count[row], minlength=n_parts)
    representative = np.zeros(n_parts, dtype=np.int64)
    representative[part] = np.arange(len(part))
    in_group = np.bincount(group[representative], minlength=n_groups)
    twice = times[part] > 1
    _mark(mask, first[row[twice]] + lo[twice], hi[twice] - lo[twice] + 1)
    lonely = np.zeros(n_groups, dtype=bool)
    lonely[group[representative[times == 1]]] = True
    doubtful = representative[(in_group[group[representative]] > 1) & lonely[group[representative]]]
    if len(doubtful):
        symbols, starts, to = _pack(buffer, base[row[doubtful]], lo[doubtful], hi[doubtful], core[doubtful], width, size, group[doubtful], first[row[doubtful]])
        order = suffix_array(symbols)
        is_start = np.zeros(len(symbols) + cell, dtype=bool)
        is_start[starts] = True
        order = order[is_start[order]]
        padded = np.concatenate((symbols, np.full(cell, -1)))
        same = np.ones(max(0, len(order) - 1), dtype=bool)
        for k in range(cell):
            at = padded[order + k]
            same &= at[1:] == at[:-1]
        hit = np.zeros(len(symbols), dtype=bool)
        hit[order[1:][same]] = hit[order[:-1][same]] = True
        mask[to[hit[starts]]] = True
    return mask


def _mark(mask: np.ndarray, start: np.ndarray, n: np.ndarray) -> None:
    step = np.bincount(start, minlength=len(mask) + 1) - np.bincount(start + n, minlength=len(mask) + 1)
    mask |= np.cumsum(step)[: len(mask)] > 0


def _pack(buffer, base, lo, hi, core, width, size, group, first):
    """Sub-contexts as symbols with the core as one: bytes before it, core, bytes after, an end.

    Returns the symbols, the places where windows start and the windows they stand for.
    """
    left, right = core - lo, hi + size - core - width
    total = left + right + 2
    at = np.cumsum(total) - total
    symbols = np.zeros(int(total.sum()), dtype=np.int64)
    for n, source, target in ((left, base + lo, at), (right, base + core + width, at + left + 1)):
        inner = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        symbols[np.repeat(target, n) + inner] = buffer[np.repeat(source, n) + inner] + 1
    symbols[at + left] = 257 + group
    n = hi - lo + 1
    inner = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    return symbols, np.repeat(at, n) + inner, np.repeat(first + lo, n) + inner


def _mask_runs(mask: np.ndarray, windows: np.ndarray):
    """Runs of True within each stretch of ``windows`` places: (stretch, first, last)."""
    edge = np.zeros(len(mask) + 1, dtype=bool)
    edge[np.cumsum(windows) - windows] = True
    edge[-1] = True
    opens = np.flatnonzero(mask & (np.concatenate(([True], ~mask[:-1])) | edge[:-1]))
    closes = np.flatnonzero(mask & (np.concatenate((~mask[1:], [True])) | edge[1:]))
    stretch = np.searchsorted(np.cumsum(windows), opens, side="right")
    start = (np.cumsum(windows) - windows)[stretch]
    return stretch, opens - start, closes - start


def context_verdicts(texts: DataFrame, grams: DataFrame, bits, size: int, gram: int, cell: int) -> DataFrame:
    """(g, c, s, e): runs s .. e of repeated windows in the contexts of mixed grams."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, texts in C.text_slices(batch.column(0)):
                text, lo, n, spot, g, c, buffer = anchors(texts, size, gram)
                keep = np.flatnonzero(_in_filter(bits.value, g)) if len(g) else np.zeros(0, dtype=np.int64)
                if not len(keep):
                    continue
                order = keep[np.lexsort((c[keep], g[keep]))]
                new = np.flatnonzero(np.concatenate(([True], (np.diff(g[order]) != 0) | (np.diff(c[order]) != 0))))
                times, pick = np.diff(np.append(new, len(order))), order[new]
                length = np.fromiter((len(t) for t in texts), dtype=np.int64, count=len(texts))
                start = (np.cumsum(length) - length)[text[pick]] + lo[pick]
                bodies = [buffer[s:e] for s, e in zip(start.tolist(), (start + n[pick] - 1 + size).tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(g[pick].view(np.int64)), pa.array(c[pick].view(np.int64)), pa.array(times), pa.array((spot - lo)[pick]), pa.array(n[pick]), pa.array(bodies, pa.binary())],
                    names=["g", "c", "times", "before", "windows", "body"],
                )

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _gram_blocks(batches):
            g, c, times, before, windows = (block[k] for k in range(5))
            new = np.flatnonzero(np.concatenate(([True], (np.diff(g) != 0) | (np.diff(c) != 0))))
            count = np.add.reduceat(times, new)
            bodies = [block[5][i] for i in new.tolist()]
            mask = repeated_windows(g[new], count, before[new], windows[new], bodies, size, gram, cell)
            stretch, s, e = _mask_runs(mask, windows[new])
            yield pa.RecordBatch.from_arrays([pa.array(g[new][stretch]), pa.array(c[new][stretch]), pa.array(s), pa.array(e)], names=["g", "c", "s", "e"])

    dealt = texts.mapInArrow(rows, "g long, c long, times long, before long, windows long, body binary")
    dealt = dealt.join(grams.filter("mixed").select("g"), "g", "left_semi")
    # A repartition by "g" itself would be taken as done by the join, which may at run time become a
    # broadcast that leaves rows where they were read or cut a large partition: grams would be torn.
    dealt = dealt.repartition(F.xxhash64("g")).sortWithinPartitions("g", "c")
    return dealt.mapInArrow(judge, "g long, c long, s long, e long")


def _gram_blocks(batches: Iterator[pa.RecordBatch]):
    """Rows sorted by gram in blocks of whole grams, about BLOCK_BYTES of contexts each."""
    held: list[list] = [[] for _ in range(6)]
    size = 0

    def out(until: int | None = None):
        cols = [np.concatenate(x) if x else np.zeros(0, dtype=np.int64) for x in held[:5]]
        return [x[:until] for x in cols] + [held[5][:until]], [x[until:] for x in cols] + [held[5][until:]]

    for batch in batches:
        for lo in range(0, batch.num_rows, 4096):
            part = batch.slice(lo, 4096)
            for k in range(5):
                held[k].append(part.column(k).to_numpy(zero_copy_only=False))
            bodies = part.column(5).to_pylist()
            held[5] += bodies
            size += sum(map(len, bodies))
            if size < BLOCK_BYTES:
                continue
            g = np.concatenate(held[0])
            cut = int(np.searchsorted(g, g[-1]))  # grams are ascending: where the last one begins
            if not cut:
                continue
            done, rest = out(cut)
            held = [[x] for x in rest[:5]] + [rest[5]]
            size = sum(map(len, rest[5]))
            yield done
    if held[5]:
        yield out()[0]


# ----------------------------------------------------------------------------- documents


def _keyed_runs(texts: DataFrame, bits, size: int, gram: int) -> DataFrame:
    """(a, b, lo, k, windows, g, c) of anchors that may repeat.

    Equal contexts one right after the other (periodic text) are one row of k of them.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (batch.column(k).to_numpy(zero_copy_only=False) for k in (1, 2))
            for first, part in C.text_slices(batch.column(0)):
                text, lo, n, _, g, c, _ = anchors(part, size, gram)
                keep = np.flatnonzero(_in_filter(bits.value, g)) if len(g) else np.zeros(0, dtype=np.int64)
                text, lo, n, g, c = (x[keep] for x in (text, lo, n, g, c))
                new = np.ones(len(lo), dtype=bool)
                new[1:] = (text[1:] != text[:-1]) | (g[1:] != g[:-1]) | (c[1:] != c[:-1]) | (lo[1:] != lo[:-1] + n[:-1])
                at = np.flatnonzero(new)
                k = np.diff(np.append(at, len(lo)))
                row = first + text[at]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (a[row], b[row], lo[at], k, n[at], g[at].view(np.int64), c[at].view(np.int64))], names=["a", "b", "lo", "k", "windows", "g", "c"])

    return texts.mapInArrow(rows, "a long, b long, lo long, k long, windows long, g long, c long")


def _hot_spans(texts: DataFrame, hot: DataFrame, bits, size: int, gram: int) -> DataFrame:
    """(a, b, s, e) of repeated windows of hot grams, counted one by one across the cluster."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (batch.column(k).to_numpy(zero_copy_only=False) for k in (1, 2))
            for first, part in C.text_slices(batch.column(0)):
                text, lo, n, _, g, _, buffer = anchors(part, size, gram)
                keep = np.flatnonzero(_in_filter(bits.value, g)) if len(g) else np.zeros(0, dtype=np.int64)
                if not len(keep):
                    continue
                length = np.fromiter((len(t) for t in part), dtype=np.int64, count=len(part))
                base = (np.cumsum(length) - length)[text]
                rolling = _Rolling(np.frombuffer(buffer, dtype=np.uint8))
                run = np.repeat(keep, n[keep])
                s = lo[run] + np.arange(len(run)) - np.repeat(np.cumsum(n[keep]) - n[keep], n[keep])
                h = rolling.of(base[run] + s, base[run] + s + size)
                row = first + text[run]
                yield pa.RecordBatch.from_arrays([pa.array(a[row]), pa.array(b[row]), pa.array(s), pa.array(g[run].view(np.int64)), pa.array(h.view(np.int64))], names=["a", "b", "s", "g", "h"])

    found = texts.mapInArrow(rows, "a long, b long, s long, g long, h long").join(hot, "g", "left_semi")
    twice = found.groupBy("g", "h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("g", "h")
    return found.join(twice, ["g", "h"], "left_semi").select("a", "b", "s", (F.col("s") + size).alias("e"))


REMOVED = T.StructType(
    [
        T.StructField("n_bytes", T.LongType()),
        T.StructField("n_removed", T.LongType()),
        T.StructField("n_spans", T.LongType()),
        T.StructField("kept_sha256", T.StringType()),
        T.StructField("kept", T.BinaryType()),
    ]
)


def _union(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def remove_repeats(docs: DataFrame, size: int = 400, text: str = "text", gram: int | None = None, cell: int = 8, hot: int = 1 << 16, with_kept: bool = False) -> DataFrame:
    """``docs`` plus n_bytes, n_removed, n_spans and kept_sha256; with ``with_kept`` also the
    remaining bytes (a cut may fall inside a character).  Such columns are replaced.
    """
    gram = gram or max(1, size // 2)
    cell = min(cell, size - gram + 1)
    docs = docs.drop(*(c for c in REMOVED.names if c in docs.columns))
    sc = docs.sparkSession.sparkContext
    a, b = F.xxhash64(text), F.xxhash64(F.lit(3), F.col(text))
    texts = docs.filter(F.octet_length(text) >= size).select(F.col(text).alias("text"), a.alias("a"), b.alias("b"))
    grams = C.settle(gram_table(texts.select("text"), size, gram))
    is_hot = F.col("mixed") & (F.col("rows") > hot)
    cold = grams.filter(~is_hot)
    bits = sc.broadcast(_filter_of(cold.select("g")))
    mixed_bits = sc.broadcast(_filter_of(cold.filter("mixed").select("g")))
    verdicts = context_verdicts(texts.select("text"), cold, mixed_bits, size, gram, cell)
    whole = cold.filter("not mixed").select("g", "c", F.lit(0).cast("long").alias("s"), F.lit(None).cast("long").alias("e"))
    found = _keyed_runs(texts, bits, size, gram).join(verdicts.unionByName(whole), ["g", "c"])
    # A context has at most ``size`` windows, so the spans of k contexts in a row touch.
    last = F.col("lo") + (F.col("k") - 1) * F.col("windows") + F.coalesce("e", F.col("windows") - 1)
    spans = found.select("a", "b", (F.col("lo") + F.col("s")).alias("s"), (last + size).alias("e"))
    hot_grams = grams.filter(is_hot).select("g")
    if not hot_grams.isEmpty():
        spans = spans.unionByName(_hot_spans(texts, hot_grams, sc.broadcast(_filter_of(hot_grams)), size, gram))
    per_text = spans.groupBy("a", "b").agg(F.collect_set(F.struct("s", "e")).alias("__spans")).withColumnsRenamed({"a": "__a", "b": "__b"})
    joined = docs.withColumns({"__a": a, "__b": b}).join(per_text, ["__a", "__b"], "left").select(*docs.columns, "__spans")
    out = T.StructType([*docs.schema.fields, *REMOVED.fields[: 4 + with_kept]])
    place, k = docs.columns.index(text), len(docs.columns)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for lo, part in C.text_slices(batch.column(place)):
                all_spans = batch.column(k).slice(lo, len(part)).to_pylist()
                for t, found_spans in zip(part, all_spans, strict=True):
                    gone = _union([(x["s"], x["e"]) for x in found_spans or ()])
                    kept, at = [], 0
                    for s, e in gone:
                        kept.append(t[at:s])
                        at = e
                    rest = b"".join([*kept, t[at:]])
                    row = (len(t), len(t) - len(rest), len(gone), hashlib.sha256(rest).hexdigest())
                    rows.append((*row, rest) if with_kept else row)
            cols = list(zip(*rows, strict=True)) if rows else [()] * (4 + with_kept)
            types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:k], *(pa.array(x, t) for x, t in zip(cols, types, strict=False))], names=out.names)

    return joined.mapInArrow(cut, out)
