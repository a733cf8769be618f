"""SimHash near-dedup over a Gray-order hierarchical index.

Fingerprint: a bit is 1 if it is set in over half of the XXH64 values (seed 42) of
the text's word shingles.  Two fingerprints link at ``distance`` or fewer differing
bits; a document's component is everything reachable.

Search: equal fingerprints collapse first.  Of ``blocks`` blocks of bits, any two
linked fingerprints share all but ``distance`` of them, so each fingerprint is dealt
once for every choice of shared blocks (the masked bit pattern).  Where a pattern
holds two or more fingerprints they are sorted by Gray rank of the other bits and
form a tree: a node keeps the bits that all below it share, bits already kept higher
up are left out, and a search adds up the differences on its way down and drops a
whole group once they pass ``distance``.  Only a spanning forest of the links found
leaves a task.  A pattern with more than ``CHUNK`` fingerprints is cut into hashed
chunks whose pairs are separate groups, so a task never holds more than two chunks.

Defined cases: null or empty texts have fingerprint zero, linked like any other;
fewer words than a shingle make one shingle; a null id keeps its fingerprint and the
component of its fingerprint (null if no id is known in it); empty tables stay empty.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as C
from .common import release, settle
from .components import components

#: Fingerprints of one masked pattern that a group holds at most (two chunks a group).
CHUNK = 4096
#: Hot patterns broadcast at most.
BROADCAST_PATTERNS = 200_000
#: Texts and bytes of shingles in a chunk of a group whose pairs are verified (two chunks a task).
GROUP, GROUP_BYTES = 1024, 16 << 20
#: Links thinned to a forest at once.
LINKS = 1 << 20
#: Children of a tree node.
FANOUT = 16
#: Candidate places held at once.
FRONTIER = 1 << 20
#: Bits set in a byte, as eight counters.
_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)


# ------------------------------------------------------------------------- fingerprints


def fingerprints_of(texts: list[bytes], shingle: int, words: int = 1, digest_sets: bool = False) -> np.ndarray:
    """``words`` unsigned 64-bit words for each text: the fingerprint, then further ones over
    remixed hashes of the same shingles; on demand a digest of the set of shingles comes last."""
    w = C.Words([C.lower_ascii(t) for t in texts], C.SPACE)
    out = np.zeros((len(texts), words + digest_sets), dtype=np.uint64)
    digest, weights = xxhash.xxh64_intdigest, (np.uint64(1) << np.arange(64, dtype=np.uint64))
    for i in range(len(texts)):
        lo, hi = int(w.first[i]), int(w.first[i + 1])
        if lo == hi:
            continue
        text = b" ".join(w.buffer[s:e] for s, e in zip(w.start[lo:hi].tolist(), w.end[lo:hi].tolist(), strict=True))
        ends = np.cumsum(w.end[lo:hi] - w.start[lo:hi] + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        n = max(1, hi - lo - shingle + 1)
        last = ends[shingle - 1 :] if hi - lo >= shingle else ends[-1:]
        h = np.fromiter((digest(text[s:e], 42) for s, e in zip(starts[:n].tolist(), last.tolist(), strict=True)), dtype=np.uint64, count=n)
        if digest_sets:
            out[i, words] = xxhash.xxh3_64_intdigest(np.unique(h).tobytes())
        for k in range(words):
            parts = h.view(np.uint8).reshape(n, 8)
            counts = np.concatenate([np.bincount(parts[:, b], minlength=256) @ _BITS for b in range(8)])
            out[i, k] = weights[2 * counts > n].sum()
            h = C.mix64(h)
    return out


def fingerprints(docs: DataFrame, shingle: int = 5, text: str = "text", words: int = 1, digest_sets: bool = False) -> DataFrame:
    """``docs`` plus signed 64-bit columns fp0, fp1, ... and, on demand, digest (replaced if already there)."""
    names = [f"fp{k}" for k in range(words)] + ["digest"] * digest_sets
    docs = docs.drop(*names)
    place = docs.columns.index(text)
    schema = T.StructType([*docs.schema.fields, *(T.StructField(n, T.LongType()) for n in names)])

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [fingerprints_of(texts, shingle, words, digest_sets) for _, texts in C.text_slices(batch.column(place))]
            values = np.concatenate(parts).view(np.int64) if parts else np.zeros((0, len(names)), dtype=np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(np.ascontiguousarray(values[:, k])) for k in range(len(names)))], names=schema.names)

    return docs.mapInArrow(make, schema)


# --------------------------------------------------------------------------- the index


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Place of a 64-bit word in the Gray order."""
    for s in (1, 2, 4, 8, 16, 32):
        x = x ^ (x >> np.uint64(s))
    return x


class GrayTree:
    """Trees over runs of Gray-sorted fingerprints, one for each group.

    ``levels[0]`` are the fingerprints, ``levels[-1]`` one root a group.  A node holds
    (mask, value): the bits shared below it that no node above keeps already.
    """

    def __init__(self, prints: np.ndarray, starts: np.ndarray):
        size = np.diff(np.append(starts, len(prints)))
        shared, value, begin, count = [np.full(len(prints), ~np.uint64(0))], [prints], [starts], [size]
        first_child = []
        while (count[-1] > 1).any():
            n = (count[-1] + FANOUT - 1) // FANOUT
            at = np.concatenate(([0], np.cumsum(n)[:-1]))
            inner = np.arange(n.sum()) - np.repeat(at, n)
            child = np.repeat(begin[-1], n) + inner * FANOUT
            ones, zeros = np.bitwise_and.reduceat(value[-1], child), np.bitwise_or.reduceat(value[-1], child)
            all_known = np.bitwise_and.reduceat(shared[-1], child)
            shared.append(all_known & ~(ones ^ zeros))
            value.append(ones)
            first_child.append(np.append(child, len(value[-2])))
            begin.append(at)
            count.append(n)
        self.first_child, self.root_of, self.mask, self.value = first_child, begin[-1], [], value
        above = np.zeros(len(shared[-1]), dtype=np.uint64)
        for k in range(len(shared) - 1, -1, -1):
            self.mask.insert(0, shared[k] & ~above)
            if k:
                above = np.repeat(above | shared[k], np.diff(first_child[k - 1]))

    def search(self, queries: np.ndarray, groups: np.ndarray, distance: int):
        """(query place, fingerprint place) of all pairs within the distance, in blocks."""
        stack = [(len(self.mask) - 1, np.arange(len(queries)), self.root_of[groups], np.zeros(len(queries), dtype=np.uint8))]
        while stack:
            level, q, node, far = stack.pop()
            if len(q) > FRONTIER:
                half = len(q) // 2
                stack += [(level, q[:half], node[:half], far[:half]), (level, q[half:], node[half:], far[half:])]
                continue
            far = far + np.bitwise_count((queries[q] ^ self.value[level][node]) & self.mask[level][node])
            ok = far <= distance
            q, node, far = q[ok], node[ok], far[ok]
            if not len(q):
                continue
            if level == 0:
                yield q, node
                continue
            first = self.first_child[level - 1]
            n = first[node + 1] - first[node]
            inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            stack.append((level - 1, np.repeat(q, n), np.repeat(first[node], n) + inner, np.repeat(far, n)))


class _Forest:
    """Labels of a bounded set of places, joined by vectors of links."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:
            x, y = self.label[a], self.label[b]
            differ = x != y
            if not differ.any():
                return
            a, b = a[differ], b[differ]
            np.minimum.at(self.label, np.maximum(x, y)[differ], np.minimum(x, y)[differ])
            while True:
                up = self.label[self.label]
                if (up == self.label).all():
                    break
                self.label = up


def link_groups(prints: np.ndarray, starts: np.ndarray, distance: int, total: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest (pairs of places) of the links inside each group.

    ``prints`` is (n, words); groups are sorted by the Gray rank of the first word, which the
    tree searches.  With ``total``, a pair also may differ in that many bits of all words.
    """
    tree = GrayTree(np.ascontiguousarray(prints[:, 0]), starts)
    groups = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(prints))))
    forest = _Forest(len(prints))
    for q, p in tree.search(tree.value[0], groups, distance):
        more = p > q
        q, p = q[more], p[more]
        if total is not None:
            close = np.bitwise_count(prints[q] ^ prints[p]).sum(axis=1) <= total
            q, p = q[close], p[close]
        forest.join(q, p)
    child = np.flatnonzero(forest.label != np.arange(len(prints)))
    return child, forest.label[child]


def direct_links(prints: np.ndarray, starts: np.ndarray, distance: int, total: int, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs that link themselves: a forest that joins all pairs of ``link_groups``.

    The forest takes pairs of up to two thirds of ``total`` first, then by a hash of the two ids,
    so that groups of much the same members choose much the same links and none is a hub.
    """
    tree = GrayTree(np.ascontiguousarray(prints[:, 0]), starts)
    groups = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(prints))))
    forest, kept = _Forest(len(prints)), []
    for q, p in tree.search(tree.value[0], groups, distance):
        more = (p > q) & (forest.label[q] != forest.label[p])
        q, p = q[more], p[more]
        far = np.bitwise_count(prints[q] ^ prints[p]).sum(axis=1)
        close = np.flatnonzero(far <= total)
        a, b = node[q[close]].astype(np.uint64), node[p[close]].astype(np.uint64)
        dealt = C.mix64(C.mix64(np.minimum(a, b)) ^ np.maximum(a, b))
        close = close[np.lexsort((dealt, 3 * far[close].astype(np.int64) > 2 * total))]
        q, p = q[close], p[close]
        while len(q):
            best = np.full(len(prints), len(q))
            for label in (forest.label[q], forest.label[p]):
                np.minimum.at(best, label, np.arange(len(q)))
            taken = np.unique(best[best < len(q)])
            kept.append((q[taken], p[taken]))
            forest.join(q[taken], p[taken])
            apart = forest.label[q] != forest.label[p]
            q, p = q[apart], p[apart]
    none = np.zeros(0, dtype=np.int64)
    return (np.concatenate([q for q, _ in kept]), np.concatenate([p for _, p in kept])) if kept else (none, none)


def block_masks(blocks: int, distance: int) -> list[int]:
    """Masks of every choice of blocks - distance blocks of the 64 bits."""
    edges = [round(i * 64 / blocks) for i in range(blocks + 1)]
    block = [((1 << (hi - lo)) - 1) << lo for lo, hi in itertools.pairwise(edges)]
    return [sum(c) for c in itertools.combinations(block, blocks - distance)]


def links(prints: DataFrame, distance: int = 4, blocks: int = 6, reach: int | None = None, total: int | None = None, direct: bool = False) -> DataFrame:
    """Links (a, b) of the nodes of ``prints`` (node, fp0, ...): a forest that joins all pairs
    within ``distance`` bits of fp0.

    With ``reach`` and ``total``, pairs of up to ``reach`` bits that share a pattern link too,
    and a pair must lie within ``total`` bits over all words.  Rows of different ``w``, if there is
    such a column, never meet.  With ``direct``, links are those of ``direct_links``.
    """
    words = [c for c in prints.columns if c.startswith("fp")]
    n_words = len(words)
    masks = block_masks(blocks, distance)
    signed = [m - (1 << 64) if m >= 1 << 63 else m for m in masks]
    dealt = prints.select("*", F.posexplode(F.array(*[F.col("fp0").bitwiseAND(F.lit(m)) for m in signed])).alias("t", "key"))
    if "w" in prints.columns:
        dealt = dealt.withColumn("t", F.col("w") * len(masks) + F.col("t"))
    dealt = dealt.select("node", *words, "t", "key")
    hot = settle(dealt.groupBy("t", "key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > CHUNK))
    dealt = dealt.join(C.maybe_broadcast(hot, hot.count(), BROADCAST_PATTERNS), ["t", "key"], "left")
    # A tight cluster crowds any slice of bits, so a hot pattern's chunks are dealt by hash.
    chunks = F.coalesce(F.ceil(F.col("n") / CHUNK), F.lit(1)).cast("int")
    dealt = dealt.withColumn("k", chunks).withColumn("c", F.pmod(F.xxhash64("node"), F.col("k")).cast("int"))
    pairs = dealt.filter("k > 1").select("t", "key", "node", *words, "c", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("d"))
    pairs = pairs.withColumns({"c": F.least("c", "d"), "d": F.greatest("c", "d")})
    dealt = dealt.filter("k = 1").select("t", "key", "node", *words, "c", F.lit(0).alias("d")).unionByName(pairs)
    unsigned = np.array(masks, dtype=np.uint64)
    limit = distance if reach is None else reach

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, starts in _whole_groups(batches):
            size = np.diff(np.append(starts, len(rows)))
            shared = np.repeat(size > 1, size)
            rows, size = rows[shared], size[size > 1]
            if not len(rows):
                continue
            fp = np.ascontiguousarray(rows[:, 5 : 5 + n_words]).view(np.uint64)
            group = np.repeat(np.arange(len(size)), size)
            order = np.lexsort((gray_rank(fp[:, 0] & ~unsigned[rows[:, 0] % len(unsigned)]), group))
            at = np.cumsum(size) - size
            if direct:
                a, b = direct_links(fp[order], at, limit, total, rows[order, 4])
            else:
                a, b = link_groups(fp[order], at, limit, total)
            node = rows[order, 4]
            yield pa.RecordBatch.from_arrays([pa.array(node[a]), pa.array(node[b])], names=["a", "b"])

    keyed = dealt.repartition("t", "key", "c", "d").sortWithinPartitions("t", "key", "c", "d")
    return keyed.select("t", "key", "c", "d", "node", *words).mapInArrow(search, "a long, b long")


def _whole_groups(batches: Iterator[pa.RecordBatch]):
    """Sorted rows as (values, starts of groups of the first four), never cutting a group in two."""
    held: list[np.ndarray] = []
    rows = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(np.column_stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns]))
        rows += batch.num_rows
        if rows < 1 << 16:
            continue
        all_rows = np.concatenate(held)
        new = np.flatnonzero((all_rows[1:, :4] != all_rows[:-1, :4]).any(axis=1)) + 1
        if not len(new):
            held = [all_rows]
            continue
        yield all_rows[: new[-1]], np.concatenate(([0], new[:-1]))
        held, rows = [all_rows[new[-1] :]], len(all_rows) - new[-1]
    if held:
        all_rows = np.concatenate(held)
        yield all_rows, np.concatenate(([0], np.flatnonzero((all_rows[1:, :4] != all_rows[:-1, :4]).any(axis=1)) + 1))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 5, distance: int = 4, blocks: int = 6) -> DataFrame:
    """One row per document: ``doc_id``, ``fingerprint`` (signed), ``component_id``.

    Exact for fingerprints: every pair within ``distance`` bits links.
    """
    made = fingerprints(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), shingle)
    prints = settle(made.select("doc_id", F.col("fp0").alias("fingerprint")))
    distinct = settle(prints.groupBy("fingerprint").agg(F.min("doc_id").alias("first")))
    tree = components(links(distinct.select(F.col("fingerprint").alias("node"), F.col("fingerprint").alias("fp0")), distance, blocks))
    member = distinct.join(tree, distinct["fingerprint"] == tree["node"], "left").select(F.col("fingerprint").alias("fp"), "first", F.coalesce("root", "fingerprint").alias("root"))
    member = settle(member)
    least = member.groupBy("root").agg(F.min("first").alias("component_id"))
    of = C.spread_join(member, "root", "fp", least, member.count()).select(F.col("fp").alias("fingerprint"), "component_id")
    return C.spread_join(prints, "fingerprint", "doc_id", of, prints.count()).select("doc_id", "fingerprint", "component_id")


def shingle_sets(texts: list[bytes], shingle: int) -> list[np.ndarray]:
    """Sorted distinct hashes of the word shingles of each text."""
    w = C.Words([C.lower_ascii(t) for t in texts], C.SPACE)
    h = C.word_hashes(w)
    runs = C.window_hashes(h, shingle)
    out = []
    for lo, hi in itertools.pairwise(w.first.tolist()):
        out.append(np.unique(runs[lo : hi - shingle + 1]) if hi - lo >= shingle else C.window_hashes(h[lo:hi], hi - lo) if hi > lo else h[:0])
    return out


def similar(pairs: DataFrame, texts: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """The ``pairs`` (a, b) whose ``texts`` (node, text) share ``similarity`` of their shingles or more.

    Pairs are broadcast behind a check of their number; only texts that stand in a pair are shuffled.
    """
    n = pairs.count()
    left = texts.join(C.maybe_broadcast(pairs, n, BROADCAST_PATTERNS), F.col("node") == F.col("a")).select("a", "b", F.col("text").alias("x"))
    ends = C.maybe_broadcast(pairs.select(F.col("b").alias("node")).distinct(), n, BROADCAST_PATTERNS)
    right = texts.join(ends, "node", "left_semi").select(F.col("node").alias("b"), F.col("text").alias("y"))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(batch.num_rows, dtype=bool)
            for lo in range(0, batch.num_rows, 64):
                x, y = ([(t or "").encode() for t in batch.column(k).slice(lo, 64).to_pylist()] for k in (2, 3))
                for i, (s, t) in enumerate(zip(shingle_sets(x, shingle), shingle_sets(y, shingle), strict=True)):
                    both = len(np.intersect1d(s, t, assume_unique=True))
                    keep[lo + i] = both >= similarity * (len(s) + len(t) - both) - 1e-9
            yield batch.select([0, 1]).filter(pa.array(keep))

    return left.join(right, "b").select("a", "b", "x", "y").mapInArrow(verify, "a long, b long").distinct()


def thinned(pairs: DataFrame) -> DataFrame:
    """Links that join what ``pairs`` (a, b) join: a forest of each ``LINKS`` of them, made where they lie."""

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in itertools.chain(batches, [None]):
            if batch is not None:
                held.append(np.column_stack([c.to_numpy() for c in batch.columns]))
                rows += batch.num_rows
            if rows and (batch is None or rows >= LINKS):
                node, place = np.unique(np.concatenate(held), return_inverse=True)
                place = place.reshape(-1, 2)
                forest = _Forest(len(node))
                forest.join(place[:, 0], place[:, 1])
                child = np.flatnonzero(forest.label != np.arange(len(node)))
                yield pa.RecordBatch.from_arrays([pa.array(node[child]), pa.array(node[forest.label[child]])], names=["a", "b"])
                held, rows = [], 0

    return pairs.select("a", "b").coalesce(-(-max(pairs.count(), 1) // LINKS)).mapInArrow(reduce, "a long, b long")


def verified_links(prints: np.ndarray, sets: list[np.ndarray], root: np.ndarray, side: np.ndarray, most: int, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """A forest (pairs of places) of the links between different roots and, where ``side`` has two
    values, between its sides: fingerprints within ``most`` bits, sets that share ``similarity``.

    Every pair not joined yet is compared.  One text at a time marks its shingles, and the marks
    are counted over all texts it may link, so no pair is ever stored.
    """
    n = len(sets)
    size = np.fromiter((len(s) for s in sets), dtype=np.int64, count=n)
    _, shingles = np.unique(np.concatenate(sets), return_inverse=True) if n else (None, np.zeros(0, dtype=np.int64))
    at = np.concatenate(([0], np.cumsum(size)))
    marked = np.zeros(int(shingles.max()) + 1 if len(shingles) else 0, dtype=bool)
    _, label = np.unique(root, return_inverse=True)
    two = len(np.unique(side)) > 1
    a, b = [], []
    for i in range(n - 1):
        later = slice(i + 1, n)
        may = label[later] != label[i]
        if two:
            may &= side[later] != side[i]
        other = np.flatnonzero(may) + i + 1
        other = other[np.bitwise_count(prints[other] ^ prints[i]).sum(axis=1) <= most]
        # Sets of too different sizes cannot share so much.
        other = other[np.minimum(size[other], size[i]) >= similarity * np.maximum(size[other], size[i]) - 1e-9]
        if not len(other):
            continue
        own = shingles[at[i] : at[i + 1]]
        marked[own] = True
        ends = np.cumsum(size[other])
        place = np.arange(ends[-1]) + np.repeat(at[other] - (ends - size[other]), size[other])
        hits = np.concatenate(([0], np.cumsum(marked[shingles[place]])))
        marked[own] = False
        both = hits[ends] - hits[ends - size[other]]
        other = other[both >= similarity * (size[other] + size[i] - both) - 1e-9]
        other = other[np.unique(label[other], return_index=True)[1]]
        if len(other):
            a.append(np.full(len(other), i))
            b.append(other)
            label[np.isin(label, label[other])] = label[i]
    none = np.zeros(0, dtype=np.int64)
    return (np.concatenate(a), np.concatenate(b)) if a else (none, none)


def links_within(members: DataFrame, texts: DataFrame, shingle: int, similarity: float, most: int) -> DataFrame:
    """Links (a, b) that join all pairs of a group whose fingerprints lie within ``most`` bits and
    whose ``texts`` (node, text) share ``similarity`` of their shingles, but for what ``root`` joins.

    ``members`` has (node, group, root, fps), fps an array.  A group meets in one task, which keeps
    its pairs to itself.  One of over ``GROUP`` texts or ``GROUP_BYTES`` of shingles is cut into
    hashed chunks whose pairs meet, so a task holds two chunks.
    """
    schema = T.StructType([f for f in members.schema.fields if f.name != "text"] + [T.StructField("shingles", T.BinaryType())])

    def as_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            last = batch.num_columns - 1
            for lo, part in C.text_slices(batch.column(last)):
                sets = pa.array([s.tobytes() for s in shingle_sets(part, shingle)], pa.binary())
                rows = batch.slice(lo, len(part))
                yield pa.RecordBatch.from_arrays([*rows.columns[:last], sets], names=schema.names)

    of = texts.join(C.maybe_broadcast(members, members.count(), BROADCAST_PATTERNS), "node").select(*members.columns, "text")
    sets = of.mapInArrow(as_sets, schema).groupBy("node", "fps", F.xxhash64("shingles").alias("h"))
    sets = settle(sets.agg(*[F.first(c).alias(c) for c in ("group", "root", "shingles")]).drop("h"))
    chunks = F.ceil(F.greatest(F.count(F.lit(1)) / GROUP, F.sum(F.octet_length("shingles")) / GROUP_BYTES))
    hot = settle(sets.groupBy("group").agg(chunks.cast("int").alias("k")).filter("k > 1"))
    dealt = sets.join(C.maybe_broadcast(hot, hot.count(), BROADCAST_PATTERNS), "group", "left").withColumn("k", F.coalesce("k", F.lit(1)))
    dealt = dealt.withColumn("side", F.pmod(F.xxhash64("node"), F.col("k")).cast("int"))
    dealt = dealt.withColumn("d", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    dealt = dealt.withColumns({"c": F.least("side", "d"), "d": F.greatest("side", "d")}).drop("k")

    def verify(rows: pa.Table) -> pa.Table:
        column = lambda c: rows.column(c).to_numpy()
        node, side = column("node"), column("side")
        fps = np.array(rows.column("fps").to_pylist(), dtype=np.int64).view(np.uint64)
        shingles = [np.frombuffer(s, dtype=np.uint64) for s in rows.column("shingles").to_pylist()]
        if column("c")[0] != column("d")[0] and len(np.unique(side)) == 1:
            shingles, node, side, fps = [], node[:0], side[:0], fps[:0]
        a, b = verified_links(fps, shingles, column("root")[: len(node)], side, most, similarity)
        return pa.table({"a": pa.array(node[a], pa.int64()), "b": pa.array(node[b], pa.int64())})

    found = settle(dealt.groupBy("group", "c", "d").applyInArrow(verify, "a long, b long").distinct())
    release(sets, hot)
    return found


def _limit(similarity: float, bits: int, deviations: float) -> int:
    """Differing bits of texts exactly at ``similarity``: mean and so many standard deviations."""
    angle = float(np.arccos(2 * similarity / (1 + similarity)) / np.pi)
    return int(np.ceil(bits * angle + deviations * np.sqrt(bits * angle * (1 - angle))))


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 5, similarity: float = 0.8, distance: int = 5, blocks: int = 7, words: int = 8) -> DataFrame:
    """``docs`` with one document of each group of near copies: the one with the least id.

    Two texts link when the overlap of their shingle sets is ``similarity`` or more, which is
    verified on the texts.  Candidates share a masked pattern of one of ``words`` independent
    fingerprints (each dealt by itself) and lie within the bits that such texts differ in: one and
    a half standard deviations over the mean for the two words at hand, three for all of them.
    First a forest of candidates is verified.  Where a link of it fails and leaves its ends apart,
    others may still join them: among the texts of that whole tree of candidates all pairs within
    three standard deviations in all words are verified too, inside the task that holds them.
    Rows that repeat an id are all kept or all dropped (an id dropped as a copy of two texts does
    not link these); null ids are never dropped; null and empty
    texts are copies of each other; texts of any length are read whole; columns of any name stay.
    """
    reach, total, most = _limit(similarity, 64, 1.5), _limit(similarity, 128, 1.5), _limit(similarity, 64 * words, 3)
    texts = docs.filter(F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("node"), F.col(text).alias("text"))
    names = [f"fp{k}" for k in range(words)]
    prints = settle(fingerprints(texts, shingle, words=words, digest_sets=True).select(F.col("node").alias("doc_id"), *names, "digest"))
    distinct = settle(prints.groupBy("digest", *names).agg(F.min("doc_id").alias("node")))
    least = distinct.groupBy("digest").agg(F.min("node").alias("least"))
    of = C.spread_join(prints.select("doc_id", "digest"), "digest", "doc_id", least, prints.count())
    copies = settle(of.filter("doc_id <> least").select(F.col("doc_id").alias("a"), F.col("least").alias("b")))
    release(prints)

    turned = [F.struct(F.col(names[k]).alias("fp0"), F.col(names[(k + 1) % words]).alias("fp1")) for k in range(words)]
    dealt = distinct.select("node", F.posexplode(F.array(*turned)).alias("w", "s")).select("node", "w", "s.fp0", "s.fp1")
    found = links(dealt, distance, blocks, reach, total, direct=True).filter("a <> b")
    loose = settle(found.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    side = lambda c, fp: distinct.select(F.col("node").alias(c), F.array(*names).alias(fp))
    far = sum((F.bit_count(F.col("x")[k].bitwiseXOR(F.col("y")[k])) for k in range(words)), F.lit(0))
    near = settle(loose.join(side("a", "x"), "a").join(side("b", "y"), "b").filter(far <= most).select("a", "b"))
    tight = settle(similar(near, texts, shingle, similarity))
    release(near)
    joined = settle(components(tight))
    root = lambda c: joined.select(F.col("node").alias(c), F.col("root").alias(f"r{c}"))
    failed = loose.join(tight, ["a", "b"], "left_anti").join(root("a"), "a", "left").join(root("b"), "b", "left")
    failed = failed.filter(F.coalesce("ra", "a") != F.coalesce("rb", "b"))
    group = settle(components(thinned(loose)).select("node", F.col("root").alias("group")))
    open_ = settle(failed.select(F.col("a").alias("node")).join(group, "node").select("group").distinct())
    members = group.join(open_, "group", "left_semi").join(distinct.select("node", F.array(*names).alias("fps")), "node").join(joined, "node", "left")
    members = settle(members.select("node", "group", F.coalesce("root", "node").alias("root"), "fps"))
    late = links_within(members, texts, shingle, similarity, most)
    nodes = settle(distinct.select("node"))
    release(loose, group, open_, members, distinct)
    # A copy goes in any case, so only those that stand for texts of other fingerprints need links.
    twins = copies.join(nodes.withColumnRenamed("node", "a"), "a", "left_semi")
    tree = components(joined.filter("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")).union(late).union(twins))
    release(joined, tight, late, nodes)
    gone = tree.filter("node <> root").select(F.col("node").alias("__gone")).union(copies.select("a")).distinct()
    slim = C.packed(docs, doc_id, text)
    return C.unpacked(slim.join(gone, slim[doc_id] == gone["__gone"], "left_anti"), docs, (doc_id, text))
