"""Shared helpers: scratch space, bounded Arrow slices and byte-level word kernels."""

from __future__ import annotations

import math
import tempfile

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes handled at once by a NumPy kernel (a longer document is a slice of its own).
SLICE_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of the session; a temporary one only where none is set and all runs in
    one process (tests).  On a cluster a folder of one machine would be lost with it: an error."""
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if shared:
        if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
            spark.sparkContext.setCheckpointDir(shared)
        return shared
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isEmpty():
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="skylume-"))
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
    return current.get()


def delete_folder(spark: SparkSession, uri: str) -> None:
    """Remove a folder of ours through Spark's own file system layer."""
    path = spark._jvm.org.apache.hadoop.fs.Path(uri)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def settle(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder: survives lost executors, cuts lineage."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def release(*settled: DataFrame) -> None:
    """Delete the files of ``settle`` once nothing reads them any more."""
    for df in settled:
        spark = df.sparkSession
        files = df._jdf.queryExecution().logical().rdd().getCheckpointFile()
        if files.isDefined():
            delete_folder(spark, files.get())


#: Columns that an operator does not read travel under this name.
_EXTRA = "__extra"


def packed(docs: DataFrame, *read: str) -> DataFrame:
    """The columns ``read``, and all others as one, so that their names cannot clash with ours."""
    extra = [c for c in docs.columns if c not in read]
    return docs.select(*(c for c in docs.columns if c in read), F.struct(*extra).alias(_EXTRA)) if extra else docs


def unpacked(found: DataFrame, docs: DataFrame, read: tuple[str, ...], made: tuple[str, ...] | list[str] = ()) -> DataFrame:
    """``found``, which came of ``packed(docs, *read)``, with the columns of ``docs`` in their order,
    then those ``made``, which replace columns of their names that were there."""
    own = [c for c in docs.columns if c not in made]
    return found.select(*(F.col(c) if c in read else F.col(_EXTRA)[c].alias(c) for c in own), *made)


def maybe_broadcast(df: DataFrame, rows: int, limit: int) -> DataFrame:
    """Broadcast hint only when the counted rows stay within the limit; else a shuffle join."""
    return F.broadcast(df) if rows <= limit else df


def spread_join(rows: DataFrame, key: str, by: str, facts: DataFrame, n: int) -> DataFrame:
    """``rows`` with the columns of ``facts``, which has one row a ``key``; rows without a fact go.

    Any number of the ``n`` rows may share a key: each key is dealt by the hash of ``by`` over as
    many slots as the root of ``n``, and the fact first goes to the slots in use.  So neither join
    sees more rows of a key than about that root.
    """
    slots = max(1, math.isqrt(n))
    dealt = rows.withColumn("__slot", F.pmod(F.xxhash64(by), F.lit(slots)))
    known = dealt.select(key, "__slot").distinct().join(facts, key)
    return dealt.join(known, [key, "__slot"]).drop("__slot")


# ----------------------------------------------------------------------------- Arrow slices


def text_slices(column, limit: int = SLICE_BYTES, rows: int = 1 << 16):
    """Yield (first row, texts as UTF-8 bytes) over slices of at most ``limit`` bytes and ``rows`` rows.

    Null texts come out as b"".  A text longer than the limit is a slice of its own.
    """
    n = len(column)
    if n == 0:
        return
    offsets_type = np.int64 if str(column.type).startswith("large_") else np.int32
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], dtype=offsets_type)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = memoryview(buffers[2]) if buffers[2] is not None else memoryview(b"")
    valid = np.ones(n, dtype=bool) if column.null_count == 0 else column.is_valid().to_numpy(zero_copy_only=False)
    lo = 0
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1
        hi = min(n, lo + rows, max(hi, lo + 1))
        yield lo, [bytes(raw[offsets[i] : offsets[i + 1]]) if valid[i] else b"" for i in range(lo, hi)]
        lo = hi


# ----------------------------------------------------------------------------- byte kernels

#: The separators of words in the contracts: [\x20\x09-\x0D].
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: Bytes outside the words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+.
NOT_ALNUM = np.zeros(256, dtype=bool)
NOT_ALNUM[0x00:0x30] = NOT_ALNUM[0x3A:0x61] = NOT_ALNUM[0x7B:0x80] = True

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def lower_ascii(text: bytes) -> bytes:
    return text.translate(_LOWER)


class Words:
    """Word boundaries of several texts laid out in one buffer, a separator after each."""

    def __init__(self, texts: list[bytes], separators: np.ndarray):
        self.buffer = b"\n".join(texts) + b"\n"
        data = np.frombuffer(self.buffer, dtype=np.uint8)
        lengths = np.fromiter((len(t) for t in texts), dtype=np.int64, count=len(texts))
        self.text_end = np.cumsum(lengths + 1) - 1
        self.text_start = self.text_end - lengths
        inside = (~separators[data]).view(np.int8)
        step = np.diff(inside, prepend=np.int8(0))
        self.start = np.flatnonzero(step == 1)
        self.end = np.flatnonzero(step == -1)
        #: Words of text i are first[i] .. first[i + 1].
        self.first = np.append(np.searchsorted(self.start, self.text_start), len(self.start))
        self.data = data

    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.text_start)), np.diff(self.first))


_P, _Q = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_BYTE = np.random.default_rng(20240229).integers(1, 1 << 63, size=256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: dict[tuple[int, bool], np.ndarray] = {}


def _power(base: np.uint64, n: int, inverse: bool = False) -> np.ndarray:
    key = (int(base), inverse)
    have = _powers.get(key)
    if have is None or len(have) < n:
        b = pow(int(base), -1, 1 << 64) if inverse else int(base)
        size = max(n, SLICE_BYTES + 65536)
        steps = np.full(size, b, dtype=np.uint64)
        steps[0] = 1
        have = np.cumprod(steps, dtype=np.uint64)
        if size <= 4 * SLICE_BYTES:
            _powers[key] = have
    return have[:n]


def mix64(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def word_hashes(words: Words) -> np.ndarray:
    """A 64-bit hash of each word, equal for equal bytes in any text or slice."""
    n = len(words.data)
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(_BYTE[words.data] * _power(_P, n), out=total[1:])
    h = (total[words.end] - total[words.start]) * _power(_P, n, inverse=True)[words.start]
    return mix64(h ^ (words.end - words.start).astype(np.uint64))


def window_hashes(h: np.ndarray, size: int) -> np.ndarray:
    """Hash of every run of ``size`` consecutive words (runs over text borders included)."""
    if len(h) < size:
        return np.zeros(0, dtype=np.uint64)
    total = np.zeros(len(h) + 1, dtype=np.uint64)
    np.cumsum(h * _power(_Q, len(h)), out=total[1:])
    m = len(h) - size + 1
    return mix64((total[size:] - total[:-size]) * _power(_Q, m, inverse=True))


def covered(starts: np.ndarray, size: int, n: int) -> np.ndarray:
    """Boolean mask over n places: inside any run of ``size`` that begins at ``starts``."""
    step = np.zeros(n + 1, dtype=np.int32)
    np.add.at(step, starts, 1) if len(starts) < 64 else np.add(step, np.bincount(starts, minlength=n + 1), out=step, casting="unsafe")
    ends = np.minimum(starts + size, n)
    step -= np.bincount(ends, minlength=n + 1).astype(np.int32)
    return np.cumsum(step)[:n] > 0


def per_text(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum of values over each text's words."""
    total = np.zeros(len(values) + 1, dtype=np.int64)
    np.cumsum(values, out=total[1:])
    return total[first[1:]] - total[first[:-1]]
