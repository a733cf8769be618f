"""Neighbourhoods, hop structure, cores and greedy independent sets over edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skylume.session import settle


def with_incident_edge(vts: DataFrame, edges: DataFrame) -> DataFrame:
    """The vts that are an end of some edge."""
    ends = edges.select(F.col("src").alias("vt")).union(edges.select(F.col("dst").alias("vt"))).distinct()
    return vts.join(ends, "vt", "left_semi")


def khop_nodes(edges: DataFrame, vts: DataFrame, hops: int) -> DataFrame:
    """(vt, node, dist): nodes from which vt can be reached in at most ``hops`` steps."""
    step = edges.select(F.col("dst").alias("node"), F.col("src").alias("next"))
    reach = here = vts.select("vt", F.col("vt").alias("node"), F.lit(0).alias("dist")).distinct()
    for d in range(1, hops + 1):
        here = here.join(step, "node").select("vt", F.col("next").alias("node"), F.lit(d).alias("dist")).distinct()
        reach = reach.union(here)
    return reach.groupBy("vt", "node").agg(F.min("dist").alias("dist"))


def induced_edges(edges: DataFrame, members: DataFrame, key: str = "vt", node: str = "node") -> DataFrame:
    """(key, edge_id, src, dst): edges with both ends among a key's members."""
    ends = members.select(key, F.col(node).alias("src")).distinct()
    starts = edges.join(ends, "src")
    return starts.join(members.select(key, F.col(node).alias("dst")).distinct(), [key, "dst"]).select(key, "edge_id", "src", "dst")


def khop_edges(edges: DataFrame, vts: DataFrame, hops: int) -> DataFrame:
    return induced_edges(edges, khop_nodes(edges, vts, hops))


def neighbour_sets(edges: DataFrame, vts: DataFrame, hops: int) -> DataFrame:
    """(vt, node) of each neighbourhood without its centre."""
    return khop_nodes(edges, vts, hops).filter("node <> vt").select("vt", "node")


def capped_distances(edges: DataFrame, vts: DataFrame, cap: int) -> DataFrame:
    """(vt, node, dist) of breadth-first search that stops at ``cap``; new nodes only each round."""
    step = edges.select(F.col("src").alias("node"), F.col("dst").alias("next"))
    seen = here = settle(vts.select("vt", F.col("vt").alias("node"), F.lit(0).alias("dist")).distinct())
    for d in range(1, cap + 1):
        new = here.join(step, "node").select("vt", F.col("next").alias("node")).distinct()
        here = settle(new.join(seen.select("vt", "node"), ["vt", "node"], "left_anti").withColumn("dist", F.lit(d)))
        if here.isEmpty():
            break
        seen = seen.union(here)
    return seen


def ego_distances(ego_edges: DataFrame, vts: DataFrame, hops: int) -> DataFrame:
    """(vt, node, dist) within each ego, edges taken both ways; ``hops`` rounds reach all of it."""
    both = ego_edges.select("vt", F.col("src").alias("node"), F.col("dst").alias("next")).union(ego_edges.select("vt", F.col("dst").alias("node"), F.col("src").alias("next"))).distinct()
    reach = here = vts.select("vt", F.col("vt").alias("node"), F.lit(0).alias("dist")).distinct()
    for d in range(1, hops + 1):
        here = here.join(both, ["vt", "node"]).select("vt", F.col("next").alias("node"), F.lit(d).alias("dist")).distinct()
        reach = reach.union(here)
    return reach.groupBy("vt", "node").agg(F.min("dist").alias("dist"))


def edges_by_hop(edges: DataFrame, vts: DataFrame, hops: int) -> DataFrame:
    """(vt, edge_id, src, dst, hop): hop is one more than the nearer end's distance."""
    return by_hop(khop_edges(edges, vts, hops), vts, hops)


def by_hop(ego: DataFrame, vts: DataFrame, hops: int) -> DataFrame:
    """As ``edges_by_hop``, of the edges (vt, edge_id, src, dst) of each ego."""
    dist = ego_distances(ego, vts, hops)
    near = ego.join(dist.select("vt", F.col("node").alias("src"), F.col("dist").alias("a")), ["vt", "src"])
    both = near.join(dist.select("vt", F.col("node").alias("dst"), F.col("dist").alias("b")), ["vt", "dst"])
    return both.select("vt", "edge_id", "src", "dst", (F.least("a", "b") + 1).alias("hop"))


def hop_masks(hop_edges: DataFrame, hops: int) -> DataFrame:
    """(vt, mask_hop, edge_id): edges up to a hop; a hop without edges keeps the whole ego."""
    present = hop_edges.groupBy("vt").agg(F.collect_set("hop").alias("present"))
    grid = hop_edges.join(present, "vt").withColumn("mask_hop", F.explode(F.sequence(F.lit(1), F.lit(hops + 1))))
    keep = (F.col("hop") <= F.col("mask_hop")) | ~F.array_contains("present", F.col("mask_hop"))
    return grid.filter(keep).select("vt", "mask_hop", "edge_id")


def ego_records(edges: DataFrame, vts: DataFrame, hops: int) -> DataFrame:
    """(vt, subg_size, edges_by_hop): the nested view, ids ascending."""
    per_hop = edges_by_hop(edges, vts, hops).groupBy("vt", "hop").agg(F.array_sort(F.collect_list("edge_id")).alias("ids"))
    pairs = F.array_sort(F.collect_list(F.struct("hop", "ids")))
    return per_hop.groupBy("vt").agg(F.sum(F.size("ids")).cast("long").alias("subg_size"), F.map_from_entries(pairs).alias("edges_by_hop"))


def degree_rank(edges: DataFrame) -> DataFrame:
    """(node, degree, rank): by degree descending, then id."""
    degree = edges.groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("degree"))
    # The order over all nodes is counted by degree first, so no task sorts them all.
    sizes = degree.groupBy("degree").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("degree", (F.sum("n").over(Window.orderBy(F.desc("degree"))) - F.col("n")).alias("before"))
    inner = F.row_number().over(Window.partitionBy("degree").orderBy("node"))
    return degree.withColumn("r", inner).join(before, "degree").select("node", "degree", (F.col("before") + F.col("r")).alias("rank"))


def core_numbers(edges: DataFrame, key: str | None = None) -> DataFrame:
    """(key, node, core): k-cores as the fixpoint of neighbours' h-index; loops are ignored."""
    edges = edges.withColumn("key", F.col(key) if key else F.lit(0)).filter("src <> dst").select("key", "src", "dst").distinct()
    edges = settle(edges.union(edges.select("key", F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct())
    core = settle(edges.groupBy("key", F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("core")))
    while True:
        near = edges.join(core.select("key", F.col("node").alias("dst"), "core"), ["key", "dst"])
        # h-index from a histogram: how many neighbours have at least each value.
        counts = near.groupBy("key", "src", "core").agg(F.count(F.lit(1)).alias("n"))
        at_least = F.sum("n").over(Window.partitionBy("key", "src").orderBy(F.desc("core")).rowsBetween(Window.unboundedPreceding, 0))
        h = counts.withColumn("h", F.least("core", at_least)).groupBy("key", F.col("src").alias("node")).agg(F.max("h").alias("h"))
        after = settle(core.join(h, ["key", "node"]).select("key", "node", F.least("core", "h").alias("core"), (F.col("h") < F.col("core")).alias("fell")))
        done = after.filter("fell").isEmpty()
        core = after.drop("fell")
        if done:
            return core.withColumnRenamed("key", key) if key else core.drop("key")


def core_rank(cores: DataFrame, key: str = "cluster") -> DataFrame:
    """Position in each cluster by core number descending, then id."""
    return cores.withColumn("pos", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("core"), "node")))


def cluster_order(edges: DataFrame, clusters: DataFrame) -> DataFrame:
    """(cluster, node, core, pos): members ordered by core number in the induced subgraph.

    A member without an edge inside its cluster has core number 0.
    """
    inside = induced_edges(edges, clusters, key="cluster")
    cores = clusters.join(core_numbers(inside, key="cluster"), ["cluster", "node"], "left")
    return core_rank(cores.select("cluster", "node", F.coalesce("core", F.lit(0)).alias("core")))


def lex_first_independent(order: DataFrame, conflicts: DataFrame) -> DataFrame:
    """(v, rank) taken when going through ``order`` (v, rank) and skipping what conflicts.

    ``conflicts`` (u, v) is symmetric.  A round takes each node without an undecided
    earlier rival and drops its rivals; the result is that of the sequential pass.
    """
    ranked = order.select("v", "rank")
    rivals = conflicts.filter("u <> v").join(ranked.withColumnRenamed("v", "u").withColumnRenamed("rank", "ru"), "u").join(ranked, "v")
    rivals = settle(rivals.filter("ru < rank").select("u", "v").distinct())
    left, taken = settle(ranked), None
    while not left.isEmpty():
        active = rivals.join(left.select(F.col("v").alias("u")), "u", "left_semi")
        new = settle(left.join(active.select("v"), "v", "left_anti"))
        out = rivals.join(new.select(F.col("v").alias("u")), "u", "left_semi").select("v").distinct()
        taken = new if taken is None else taken.union(new)
        left = settle(left.join(new.select("v"), "v", "left_anti").join(out, "v", "left_anti"))
    return taken if taken is not None else ranked
