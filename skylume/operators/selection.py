"""Choice of test nodes: well-separated seeds of high degree, grown into groups."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skylume.operators.traversal import capped_distances, degree_rank, lex_first_independent

#: Hops fetched at once when groups grow.
AHEAD = 3


def eligible(ranks: DataFrame, ego_sizes: DataFrame, max_ego: int) -> DataFrame:
    """Ranked nodes whose ego has at most ``max_ego`` nodes."""
    return ranks.join(ego_sizes.filter(F.col("n") <= max_ego).select(F.col("vt").alias("node")), "node", "left_semi")


def seed_conflicts(edges: DataFrame, vts: DataFrame, cap: int) -> DataFrame:
    """(u, v) pairs within ``cap`` steps of each other."""
    near = capped_distances(edges, vts, cap)
    return near.filter("dist > 0").select(F.col("vt").alias("u"), F.col("node").alias("v"))


def select_seeds(edges: DataFrame, candidates: DataFrame, count: int, cap: int) -> DataFrame:
    """(node, rank): by degree, the first ``count`` not within ``cap`` steps of an earlier one."""
    vts = candidates.select(F.col("node").alias("vt"))
    conflicts = seed_conflicts(edges, vts, cap).join(vts.select(F.col("vt").alias("v")), "v", "left_semi")
    taken = lex_first_independent(candidates.select(F.col("node").alias("v"), "rank"), conflicts)
    return taken.orderBy("rank").limit(count).select(F.col("v").alias("node"), "rank")


def grow(seeds: list[int], near: dict[int, list[int]], allowed: set[int], size: int, seed: int = 42) -> list[list[int]]:
    """Breadth-first groups of ``size`` around each seed, no node twice.

    Where a group's queue runs dry, the free eligible node first in hashed order joins it and
    the search goes on from there; with none left the group stays short.
    """
    order = sorted(allowed, key=lambda v: (hashlib.md5(f"{seed}|{v}".encode()).hexdigest(), v))
    used: set[int] = set()
    groups = []
    at = 0
    for s in seeds:
        group: list[int] = []
        queue = [s] if s not in used else []
        while len(group) < size:
            if not queue:
                while at < len(order) and order[at] in used:
                    at += 1
                if at == len(order):
                    break
                queue = [order[at]]
            v = queue.pop(0)
            if v in used or (v not in allowed and v != s):
                continue
            used.add(v)
            group.append(v)
            queue += [u for u in near.get(v, ()) if u not in used]
        groups.append(group)
    return groups


class _Fetched(dict):
    """Sorted eligible neighbours, fetched with those around a node when the growth first asks for it."""

    def __init__(self, edges: DataFrame, allowed: set[int]):
        super().__init__()
        self.edges, self.allowed = edges, allowed

    def get(self, v: int, default=()) -> list[int]:
        if v not in self:
            here = [v]
            for _ in range(AHEAD):
                found: dict[int, set[int]] = {u: set() for u in here}
                for r in self.edges.filter(F.col("src").isin(here)).collect():
                    found[r["src"]].add(r["dst"])
                self.update((u, sorted(near)) for u, near in found.items())
                self.allowed.update(u for near in found.values() for u in near)
                here = sorted({u for near in found.values() for u in near if u not in self})
                if not here:
                    break
        return self[v]


def test_nodes(edges: DataFrame, ego_sizes: DataFrame, groups: int, size: int, cap: int, max_ego: int, seed: int = 42) -> DataFrame:
    """(cluster, pos, node): seeds and their grown groups.

    Growing takes nodes one by one; it runs on the driver and asks for the eligible neighbours of
    the nodes it takes, and of those close by, when it comes to them.  At most ``groups * size``
    nodes are taken and their egos are bounded, so its input does not follow the graph.
    """
    from skylume.operators.partition import as_table
    from skylume.session import settle

    ranks = settle(eligible(degree_rank(edges), ego_sizes, max_ego))
    seeds = [r["node"] for r in select_seeds(edges, ranks, groups, cap).orderBy("rank").collect()]
    inside = edges.join(ranks.select(F.col("node").alias("src")), "src", "left_semi").join(ranks.select(F.col("node").alias("dst")), "dst", "left_semi")
    # So many nodes in hashed order hold a free one as long as there is one at all.
    order = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("node").cast("string")).cast("binary"))
    allowed = {r["node"] for r in ranks.select("node").orderBy(order, "node").limit(groups * size).collect()} | set(seeds)
    near = _Fetched(settle(inside.select("src", "dst")), allowed)
    return as_table(edges.sparkSession, grow(seeds, near, allowed, size, seed))
