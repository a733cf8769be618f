"""Line dedup: lines whose key many documents share go from every document.

Method: explode normalised lines, hash, count distinct documents per hash, drop
the lines over the threshold, reassemble by position.  Keys travel as 128-bit XXH3
values, counted within each task before they are shuffled; texts never cross the
network while the common keys fit a broadcast (``BROADCAST_KEYS``, counted first).
Beyond that texts meet their dropped keys in a shuffle join on a hash of the text, with
the same result.  A row of the input is a document, so repeated rows count one by one.

Defined cases: null or empty text is one empty line (its key has no code point,
so it is never dropped); a text that loses nothing keeps its value (a null stays null);
very long texts are split whole; an empty table gives an empty result; null ids are kept;
extra columns of any name pass through, but for those named ``line_n`` and ``line_dropped``,
which are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as C

#: Keys broadcast at most (about 100 bytes each as a Python set).
BROADCAST_KEYS = 200_000
#: Distinct keys a task gathers before it hands on their counts.
GATHER = 1 << 18

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BLANK = " \t\n\x0b\x0c\r"
_BLANK_BYTES = _BLANK.encode()


def line_keys(text: bytes, min_chars: int) -> list[bytes]:
    """The key digest of each line; b"" for a key of fewer than ``min_chars`` code points."""
    keys = [x.strip(_BLANK_BYTES) for x in C.lower_ascii(text).split(b"\n")]
    short = lambda k: len(k) < min_chars or (len(k) < 4 * min_chars and len(k.decode("utf-8", "replace")) < min_chars)
    return [b"" if short(k) else xxhash.xxh3_128_digest(k) for k in keys]


def common_keys(texts: DataFrame, min_docs: int, min_chars: int) -> DataFrame:
    """(h1, h2) of the keys found in at least ``min_docs`` rows of the only column."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, int] = {}

        def out() -> pa.RecordBatch:
            h = np.frombuffer(b"".join(held), dtype=np.int64).reshape(-1, 2)
            return pa.RecordBatch.from_arrays([pa.array(h[:, 0]), pa.array(h[:, 1]), pa.array(list(held.values()), pa.int64())], names=["h1", "h2", "n"])

        for batch in batches:
            for _, part in C.text_slices(batch.column(0)):
                for t in part:
                    for k in set(line_keys(t, min_chars)):
                        held[k] = held.get(k, 0) + 1
                held.pop(b"", None)
                if len(held) > GATHER:
                    yield out()
                    held.clear()
        if held:
            yield out()

    counts = texts.mapInArrow(count, "h1 long, h2 long, n long").groupBy("h1", "h2").agg(F.sum("n").alias("n"))
    return counts.filter(F.col("n") >= min_docs).select("h1", "h2")


MADE = T.StructType([T.StructField("line_n", T.LongType()), T.StructField("line_dropped", T.LongType())])


def drop_common_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, text: str = "text") -> DataFrame:
    """``docs`` with ``text`` rid of common lines, plus ``line_n`` and ``line_dropped`` counts."""
    docs = docs.drop(*MADE.names)
    hot = C.settle(common_keys(docs.select(text), min_docs, min_chars))
    n_hot = hot.count()
    if n_hot > BROADCAST_KEYS:
        C.release(hot)
        return _drop_by_join(docs, min_docs, min_chars, text)
    keys = hot.toArrow()
    C.release(hot)
    pairs = np.column_stack([keys.column(k).to_numpy() for k in (0, 1)]) if n_hot else np.zeros((0, 2), np.int64)
    shared = docs.sparkSession.sparkContext.broadcast(np.ascontiguousarray(pairs))
    place = docs.columns.index(text)
    schema = T.StructType([*docs.schema.fields, *MADE.fields])

    def drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gone = {row.tobytes() for row in shared.value}
        for batch in batches:
            n, dropped, kept = [], [], []
            for _, part in C.text_slices(batch.column(place)):
                for t in part:
                    found = line_keys(t, min_chars)
                    stays = [k not in gone for k in found]
                    n.append(len(found))
                    dropped.append(len(found) - sum(stays))
                    kept.append(b"\n".join([x for x, s in zip(t.split(b"\n"), stays, strict=True) if s]) if dropped[-1] else None)
            column = batch.column(place)
            if any(dropped):
                column = pa.compute.if_else(pa.compute.greater(pa.array(dropped), 0), pa.array(kept, pa.binary()).cast(pa.string()).cast(column.type), column)
            columns = [*batch.columns[:place], column, *batch.columns[place + 1 :]]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(n, pa.int64()), pa.array(dropped, pa.int64())], names=schema.names)

    return docs.mapInArrow(drop, schema)


# ------------------------------------------------------------------- beyond the broadcast


def line_key(line: Column) -> Column:
    """Both ends stripped of [\\x20\\x09-\\x0D], A-Z lower-cased."""
    return F.translate(F.trim(line, F.lit(_BLANK)), _UPPER, _LOWER)


def _pair(key: Column) -> Column:
    return F.struct(F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(1), key).alias("h2"))


def _drop_by_join(docs: DataFrame, min_docs: int, min_chars: int, text: str) -> DataFrame:
    """Too many common keys for a broadcast: what a row loses depends on its text alone, so rows
    meet their dropped keys by two hashes of the text."""
    slim = C.packed(docs, text)
    lines = F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1)
    keys = F.filter(F.transform(lines, line_key), lambda k: F.length(k) >= min_chars)
    digest = F.struct(F.xxhash64(text).alias("a"), F.xxhash64(F.lit(2), F.col(text)).alias("b"))
    each = slim.filter(F.col(text).isNotNull()).select(digest.alias("t"), F.explode(F.array_distinct(F.transform(keys, _pair))).alias("k")).select("t", "k.h1", "k.h2")
    hot = each.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_docs).select("h1", "h2")
    gone = each.join(hot, ["h1", "h2"]).groupBy("t").agg(F.collect_set(F.struct("h1", "h2")).alias("__gone")).select(F.col("t.a").alias("__a"), F.col("t.b").alias("__b"), "__gone")
    found = slim.withColumns({"__a": F.xxhash64(text), "__b": F.xxhash64(F.lit(2), F.col(text))}).join(gone, ["__a", "__b"], "left")
    keep = F.filter(lines, lambda x: (F.length(line_key(x)) < min_chars) | ~F.array_contains(F.col("__gone"), _pair(line_key(x))))
    found = found.withColumns({"line_n": F.size(lines).cast("long"), "__keep": F.when(F.col("__gone").isNotNull(), keep)})
    found = found.withColumn("line_dropped", F.when(F.col("__gone").isNull(), 0).otherwise(F.col("line_n") - F.size("__keep")).cast("long"))
    found = found.withColumn(text, F.when(F.col("__gone").isNull(), F.col(text)).otherwise(F.array_join("__keep", "\n")))
    return C.unpacked(found, docs, (text,), MADE.names)
