"""Neighbourhood overlap, MinHash, clustering and size balancing of test nodes.

Pairs meet through shared neighbours (an inverted index), never by enumeration.  What
needs all test nodes at once works on the nodes and overlapping pairs of one partitioning call:
average-link clustering with its balancing in one task, buckets on the driver.
"""

from __future__ import annotations

import heapq
from collections import Counter
from heapq import nlargest

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skylume.operators.traversal import lex_first_independent
from skylume.session import settle

#: Up to so many test nodes average-link clustering has a dense matrix, beyond that only the pairs that overlap.
MAX_NODES = 1000
#: Distances are compared in 12 decimal places.
_ONE = 10**12


# -------------------------------------------------------------------------- similarity


def pair_jaccard(sets: DataFrame) -> DataFrame:
    """(i, j, inter, uni, jaccard), i < j, of (vt, node) sets that share a member."""
    sets = sets.select("vt", "node").distinct()
    sizes = sets.groupBy("vt").agg(F.count(F.lit(1)).alias("n"))
    a, b = sets.withColumnRenamed("vt", "i"), sets.withColumnRenamed("vt", "j")
    inter = a.join(b, "node").filter("i < j").groupBy("i", "j").agg(F.count(F.lit(1)).alias("inter"))
    sized = inter.join(sizes.select(F.col("vt").alias("i"), F.col("n").alias("ni")), "i").join(sizes.select(F.col("vt").alias("j"), F.col("n").alias("nj")), "j")
    uni = F.col("ni") + F.col("nj") - F.col("inter")
    return sized.select("i", "j", "inter", uni.alias("uni"), (F.col("inter") / uni).alias("jaccard"))


def pair_distance(pairs: DataFrame) -> DataFrame:
    """1 - similarity; an undefined similarity counts as distance 1."""
    gap = 1 - F.col("jaccard")
    return pairs.select("i", "j", F.when(gap.isNull() | F.isnan(gap), F.lit(1.0)).otherwise(gap).alias("distance"))


def similarity_graph(pairs: DataFrame, least: float) -> DataFrame:
    return pairs.filter(F.col("jaccard") >= least).select("i", "j", "jaccard")


# ------------------------------------------------------------------------------ MinHash


def minhash(sets: DataFrame, num_perm: int) -> DataFrame:
    """(vt, perm, h): the least hash of a set's members under each of num_perm hashes.

    A hash is 60 bits of the MD5 of "perm|member".
    """
    perm = F.explode(F.sequence(F.lit(0), F.lit(num_perm - 1))).alias("perm")
    rows = sets.select("vt", "node", perm)
    text = F.concat_ws("|", F.col("perm").cast("string"), F.col("node").cast("string"))
    h = F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")
    return rows.select("vt", "perm", h.alias("h")).groupBy("vt", "perm").agg(F.min("h").alias("h"))


def banding(threshold: float, num_perm: int) -> tuple[int, int]:
    """(bands, rows) with the least mean of false-positive and false-negative areas."""
    x = (np.arange(1000) + 0.5) / 1000
    best = (np.inf, 1, 1)
    for bands in range(1, num_perm + 1):
        for rows in range(1, num_perm // bands + 1):
            hit = 1 - (1 - x**rows) ** bands
            cost = (hit[x < threshold].sum() + (1 - hit)[x >= threshold].sum()) / 2000
            if cost < best[0] - 1e-15:
                best = (cost, bands, rows)
    return best[1], best[2]


def lsh_candidates(signatures: DataFrame, bands: int, rows: int) -> DataFrame:
    """(i, j), i < j, of sets that agree on all rows of some band."""
    used = signatures.filter(F.col("perm") < bands * rows).withColumn("band", F.floor(F.col("perm") / rows))
    keys = used.groupBy("vt", "band").agg(F.array_sort(F.collect_list(F.struct("perm", "h"))).alias("s"))
    keys = keys.select("vt", "band", F.array_join(F.transform("s", lambda x: x["h"].cast("string")), ",").alias("key"))
    a, b = keys.withColumnRenamed("vt", "i"), keys.withColumnRenamed("vt", "j")
    return a.join(b, ["band", "key"]).filter("i < j").select("i", "j").distinct()


def lsh_clusters(vts: DataFrame, candidates: DataFrame) -> DataFrame:
    """(vt, leader): in id order, a free node leads and takes its free candidates."""
    both = candidates.select(F.col("i").alias("u"), F.col("j").alias("v")).union(candidates.select(F.col("j").alias("u"), F.col("i").alias("v")))
    order = vts.select(F.col("vt").alias("v"), F.col("vt").alias("rank"))
    leaders = settle(lex_first_independent(order, both).select("v"))
    follow = both.join(leaders.select(F.col("v").alias("u")), "u", "left_semi").groupBy("v").agg(F.min("u").alias("u"))
    leads = leaders.withColumn("lead", F.lit(True))
    joined = vts.select(F.col("vt").alias("v")).join(leads, "v", "left").join(follow, "v", "left")
    return joined.select(F.col("v").alias("vt"), F.when(F.col("lead"), F.col("v")).otherwise(F.col("u")).alias("leader"))


# --------------------------------------------------------------------------- clustering


def average_link(distance: np.ndarray, clusters: int) -> list[list[int]]:
    """Merge the closest pair (mean distance; ties to the smallest members) down to ``clusters``."""
    groups = [[i] for i in range(len(distance))]
    d = distance.astype(float).copy()
    np.fill_diagonal(d, np.inf)
    size = np.ones(len(d))
    alive = np.ones(len(d), dtype=bool)
    # The least of each row and its first place, kept up to date, so that a merge costs a few rows.
    r = np.round(d, 12)
    near = r.argmin(axis=1) if len(d) else np.zeros(0, dtype=int)
    least = r[np.arange(len(d)), near]
    while alive.sum() > max(1, clusters):
        i = int(np.argmin(least))
        i, j = sorted((i, int(near[i])))
        d[i] = d[:, i] = (size[i] * d[i] + size[j] * d[j]) / (size[i] + size[j])
        d[i, i] = np.inf
        d[j] = d[:, j] = np.inf
        r[i] = r[:, i] = np.round(d[i], 12)
        r[j] = r[:, j] = np.inf
        size[i] += size[j]
        alive[j] = False
        groups[i] += groups[j]
        better = (r[:, i] < least) | ((r[:, i] == least) & (i < near))
        stale = (near == i) | (near == j)
        least[better], near[better] = r[better, i], i
        stale[[i, j]] = True
        again = np.flatnonzero(stale)
        near[again] = r[again].argmin(axis=1)
        least[again] = r[again, near[again]]
    return [sorted(groups[i]) for i in np.flatnonzero(alive)]


def average_link_sparse(n: int, i: np.ndarray, j: np.ndarray, distance: np.ndarray, clusters: int) -> list[list[int]]:
    """As ``average_link`` where all pairs but those listed (i < j, each once) are at distance 1.

    Means of ones are one, so only sums of similarity of listed pairs are kept, and a merge touches
    those of the cluster that has fewer.  No distance falls below those it is the mean of, so sorted
    pairs are lower bounds: a pair whose clusters have grown goes back to a heap when its turn comes.
    Once nothing is nearer than 1 the two clusters with the smallest members are next.
    """
    share = 1 - np.asarray(distance, dtype=float)
    rank = np.rint((1 - share) * _ONE).astype(np.int64)
    order = np.lexsort((j, i, rank))
    order = order[rank[order] < _ONE]
    queue = ((r, a, b) for at in range(0, len(order), 1 << 15) for r, a, b in zip(*(x[order[at : at + (1 << 15)]].tolist() for x in (rank, i, j)), strict=True))
    near: list[dict[int, float]] = [{} for _ in range(n)]
    # One object for each id and value: most of the memory would go to copies of them.
    ids, values = list(range(n)), {}
    for at in range(0, len(share), 1 << 15):
        for a, b, s in zip(*(x[at : at + (1 << 15)].tolist() for x in (i, j, share)), strict=True):
            near[a][ids[b]] = near[b][ids[a]] = values.setdefault(s, s)
    del values
    root, least, size = list(ids), list(ids), [1] * n
    groups: list[list[int]] = [[k] for k in ids]
    alive, left, low, high = [True] * n, n, 0, 1  # by the smallest member

    def find(k: int) -> int:
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    heap: list[tuple[int, int, int]] = []
    queued: dict[int, int] = {}
    first = next(queue, None)
    while left > max(1, clusters):
        if first is not None and (not heap or first < heap[0]):
            entry, first = first, next(queue, None)
        elif heap:
            entry = heapq.heappop(heap)
            if queued.get(key := entry[1] * n + entry[2]) == entry[0]:
                del queued[key]
        else:
            while not alive[low]:
                low += 1
            high = max(high, low + 1)
            while not alive[high]:
                high += 1
            entry = None
        a, b = (find(low), find(high)) if entry is None else (find(entry[1]), find(entry[2]))
        if a == b:
            continue
        c, e = (least[a], least[b]) if least[a] < least[b] else (least[b], least[a])
        if entry is not None:
            now = (round((1 - near[a][b] / (size[a] * size[b])) * _ONE), c, e)
            if now != entry:
                # An entry of this pair that comes no later will do.
                if now[0] < min(_ONE, queued.get(key := c * n + e, _ONE)):
                    queued[key] = now[0]
                    heapq.heappush(heap, now)
                continue
        if len(near[a]) < len(near[b]):
            a, b = b, a
        x, y = near[a], near[b]
        x.pop(b, None), y.pop(a, None)
        near[b] = {}
        for k, s in y.items():
            of = near[k]
            del of[b]
            x[k] = of[a] = x.get(k, 0.0) + s
        root[b], least[a], alive[e] = a, c, False
        size[a] += size[b]
        more, fewer = (groups[a], groups[b]) if len(groups[a]) >= len(groups[b]) else (groups[b], groups[a])
        more += fewer
        groups[a], groups[b] = more, []
        left -= 1
    return [sorted(groups[find(k)]) for k in ids if alive[k]]


def exact_clusters(vts: list[int], pairs: tuple[np.ndarray, np.ndarray, np.ndarray], clusters: int, dense: int | None = None) -> list[list[int]]:
    """Average-link clusters of ids; pairs (i, j, jaccard) not listed share nothing."""
    ids = np.array(sorted(vts), dtype=np.int64)
    i, j = np.searchsorted(ids, pairs[0]), np.searchsorted(ids, pairs[1])
    if len(ids) > (MAX_NODES if dense is None else dense):
        return [ids[g].tolist() for g in average_link_sparse(len(ids), i, j, 1 - pairs[2], clusters)]
    d = np.ones((len(ids), len(ids)))
    d[i, j] = d[j, i] = 1 - pairs[2]
    return [ids[g].tolist() for g in average_link(d, clusters)]


# ---------------------------------------------------------------------------- balancing


def _sizes(total: int, parts: int) -> tuple[int, int, int]:
    """(target, least, most) members of a part: a tenth of slack either way."""
    target = total // parts
    return target, int(0.9 * target), int(1.1 * target)


def chunks(items: list[int], size: int) -> list[list[int]]:
    return [items[k : k + size] for k in range(0, len(items), size)]


def balance(clusters: list[list[int]], parts: int) -> list[list[int]]:
    """Cut large clusters, gather small ones in order behind the others, then meet the number of parts."""
    target, least, most = _sizes(sum(map(len, clusters)), parts)
    cut = [c for g in clusters for c in (chunks(g, max(1, target)) if len(g) > most else [list(g)])]
    # Clusters of a fair size come first, those gathered from small ones after them.
    out, gathered, small = [g for g in cut if len(g) >= least], [], []
    for g in cut:
        if len(g) < least:
            small = small + g
            if len(small) >= least:
                gathered.append(small)
                small = []
    out += gathered + ([small] if small else [])
    while len(out) > parts:
        out.sort(key=len)
        out = [out[0] + out[1], *out[2:]]
    while len(out) < parts and max(map(len, out), default=0) > 1:
        out.sort(key=len, reverse=True)
        half = len(out[0]) // 2
        out = [*out[1:], out[0][:half], out[0][half:]]
    return out


def split_bucket(bucket: list[int], sets: dict[int, set[int]], size: int) -> list[list[int]]:
    """Groups of ``size``: the first free node and those most like it, ties to larger ids.

    Only nodes that share a member are compared; all others are alike in nothing, the largest ids first.
    """
    holders: dict[int, list[int]] = {}
    for v in bucket:
        for m in sets.get(v, ()):
            holders.setdefault(m, []).append(v)
    rest, free, out = sorted(bucket), set(bucket), []
    for first in bucket:
        if first not in free:
            continue
        free.discard(first)
        mine, common = sets.get(first, set()), Counter()
        for m in mine:
            holders[m] = [v for v in holders[m] if v in free]
            common.update(holders[m])
        near = nlargest(max(0, size - 1), common, key=lambda v: (common[v] / (len(mine) + len(sets[v]) - common[v]), v))
        free.difference_update(near)
        while len(near) < size - 1 and rest:
            if (v := rest.pop()) in free:
                near.append(v)
                free.discard(v)
        out.append([first, *near])
    return out


def merge_largest_first(buckets: list[list[int]], parts: int) -> list[list[int]]:
    """Largest bucket first, each to the part that is smallest so far."""
    out: list[list[int]] = [[] for _ in range(parts)]
    for b in sorted(buckets, key=len, reverse=True):
        min(out, key=len).extend(b)
    return out


def balance_buckets(buckets: list[list[int]], parts: int, sets: dict[int, set[int]]) -> list[list[int]]:
    """Split buckets over the limit by similarity, then merge largest first."""
    target, _, most = _sizes(sum(map(len, buckets)), parts)
    pieces = [p for b in buckets for p in (split_bucket(b, sets, max(1, target)) if len(b) > most else [list(b)])]
    return merge_largest_first(pieces, parts)


def as_table(spark: SparkSession, groups: list[list[int]]) -> DataFrame:
    """(cluster, pos, node)."""
    rows = [(c, p, int(v)) for c, g in enumerate(groups) for p, v in enumerate(g)]
    return spark.createDataFrame(rows, "cluster int, pos int, node long")


def _exact(pairs: DataFrame, vts: DataFrame, parts: int) -> DataFrame:
    """Balanced average-link clusters; one task has the pairs, none of them reach the driver."""
    alone = vts.select(F.col("vt").alias("i")).distinct().withColumns({"j": F.lit(None).cast("long"), "jaccard": F.lit(None).cast("double")})
    dense = MAX_NODES

    def run(batches):
        ids, pairs = [], []
        for batch in batches:
            paired = batch.column("j").is_valid()
            ids.append(batch.filter(pc.invert(paired)).column("i").to_numpy(zero_copy_only=False))
            pairs.append([c.to_numpy(zero_copy_only=False) for c in batch.filter(paired).columns])
        i, j, share = (np.concatenate(x) for x in zip(*pairs, strict=True)) if pairs else np.zeros((3, 0))
        groups = balance(exact_clusters(np.concatenate(ids).tolist() if ids else [], (i, j, share), parts, dense), parts)
        rows = [(c, p, v) for c, g in enumerate(groups) for p, v in enumerate(g)]
        names, kinds = ("cluster", "pos", "node"), (pa.int32(), pa.int32(), pa.int64())
        columns = zip(*rows, strict=True) if rows else ([], [], [])
        yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(columns, kinds, strict=True)], names)

    rows = pairs.select("i", "j", "jaccard").unionByName(alone)
    return rows.repartition(1).mapInArrow(run, "cluster int, pos int, node long")


def partition(sets: DataFrame, vts: DataFrame, parts: int, method: str = "exact", num_perm: int = 256, threshold: float = 0.7) -> DataFrame:
    """(cluster, pos, node): test nodes in ``parts`` groups of similar size and overlap."""
    if method == "exact":
        return _exact(pair_jaccard(sets), vts, parts)
    if method == "lsh":
        candidates = lsh_candidates(minhash(sets, num_perm), *banding(threshold, num_perm))
        led: dict[int, list[int]] = {}
        for r in lsh_clusters(vts.select("vt").distinct(), candidates).orderBy("leader", "vt").collect():
            led.setdefault(r["leader"], []).append(r["vt"])
        members = {r["vt"]: set(r["s"]) for r in sets.groupBy("vt").agg(F.collect_set("node").alias("s")).collect()}
        return as_table(vts.sparkSession, balance_buckets(list(led.values()), parts, members))
    raise ValueError(f"unknown method {method!r}: exact or lsh")


def even_chunks(vts: DataFrame, parts: int, seed: int) -> DataFrame:
    """(cluster, node): a hashed shuffle dealt into parts whose sizes differ by one at most."""
    from skylume.session import seeded

    order = Window.orderBy(seeded(seed, F.col("vt")), "vt")
    return vts.select((F.ntile(parts).over(order) - 1).alias("cluster"), F.col("vt").alias("node"))


def fixed_chunks(vts: DataFrame, size: int) -> DataFrame:
    """(chunk, vt): runs of ``size`` ids in order."""
    rank = F.row_number().over(Window.orderBy("vt")) - 1
    return vts.select(F.floor(rank / size).alias("chunk"), "vt")
