"""Every registered query of the graph operators: (spark, sf_dir) to a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skylume.config import Params
from skylume.functions import measures
from skylume.operators import models, partition, scoring, selection, traversal
from skylume.plans import search
from skylume.session import seeded, settle
from skylume.sources import graphs

P = Params()
TRADE, NEAR = 3, 2
#: The wave that scoring queries show: the outermost hop.
HOP = P.hops
WIDTH = 64


def _r(name: str, digits: int = 6):
    return (F.round(F.col(name), digits) + F.lit(0.0)).alias(name)


def _trade(spark: SparkSession, sf: str) -> DataFrame:
    return settle(graphs.trade_edges(spark, sf, TRADE))


def _near(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    return graphs.embedding_nodes(spark, sf), settle(graphs.nearest_edges(spark, sf, NEAR))


def _vts(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("vt")).distinct()


def _model(name: str = "gcn2"):
    return models.fixed_model(name, WIDTH, P.hidden, P.classes)


class _Wave:
    """The first wave of the search over all nodes of the nearest-neighbour graph."""

    def __init__(self, spark: SparkSession, sf: str):
        self.nodes, self.edges = _near(spark, sf)
        self.vts, self.layers = _vts(self.edges), _model()
        self.first = settle(models.project(self.nodes, self.layers[0]))
        self.members = settle(scoring.members_of(self.edges, self.vts, P.hops))
        self.hop_edges = settle(traversal.edges_by_hop(self.edges, self.vts, P.hops))
        self.ego = self.hop_edges.select("vt", "edge_id", "src", "dst")

    def frontier(self) -> DataFrame:
        return scoring.sample_frontier(self.hop_edges, HOP, P.frontier_limit, P.frontier_keep, P.seed)

    def states(self) -> DataFrame:
        mask = traversal.hop_masks(self.hop_edges, P.hops).filter(F.col("mask_hop") == HOP).select("vt", "edge_id")
        return scoring.expand(self.ego.join(mask, ["vt", "edge_id"]), self.frontier())

    def scored(self) -> DataFrame:
        return settle(scoring.fidelities(self.edges, self.ego, self.members, self.states(), self.first, self.layers))

    def ranked(self) -> DataFrame:
        return scoring.positions(scoring.marginal(self.scored(), self.ego), P.epsilon)


# -------------------------------------------------------------------------- sources


def split_positional(spark, sf):
    nodes = graphs.embedding_nodes(spark, sf)
    return graphs.split_positional(nodes, nodes.count(), 1)


def split_stratified(spark, sf):
    return graphs.split_stratified(graphs.embedding_nodes(spark, sf), 10, 20, P.seed)


def drop_self_loops(spark, sf):
    pairs = graphs.table(spark, sf, "events").select(F.col("user_id").alias("src"), (F.col("event_id") % 97).alias("dst"))
    return graphs.drop_self_loops(pairs.distinct())


def symmetrize(spark, sf):
    return graphs.symmetrize(graphs.trade_pairs(spark, sf).filter(F.col("orders") >= TRADE))


def ego_reload(spark, sf):
    vts = graphs.embedding_nodes(spark, sf).select(F.col("node_id").alias("vt"))
    old = vts.select("vt", (F.col("vt") * 2).alias("subg_size"), F.lit(0).alias("batch"))
    new = vts.filter("vt % 3 = 0").select("vt", (F.col("vt") * 5).alias("subg_size"), F.lit(1).alias("batch"))
    return graphs.latest(old.unionByName(new))


# ------------------------------------------------------------------------ traversal


def has_edge(spark, sf):
    vts = graphs.table(spark, sf, "customer").select(F.col("c_custkey").alias("vt"))
    return traversal.with_incident_edge(vts, _trade(spark, sf))


def khop_nodes(spark, sf):
    e = _trade(spark, sf)
    return traversal.khop_nodes(e, _vts(e), P.hops)


def khop_edges(spark, sf):
    e = _trade(spark, sf)
    return traversal.khop_edges(e, _vts(e), P.hops)


def lhop_nbrs(spark, sf):
    e = _trade(spark, sf)
    return traversal.neighbour_sets(e, _vts(e), P.hops)


def lhop_sets(spark, sf):
    return lhop_nbrs(spark, sf).groupBy("vt").agg(F.array_join(F.transform(F.array_sort(F.collect_set("node")), lambda x: x.cast("string")), ",").alias("members"))


def lhop_sizes(spark, sf):
    return khop_nodes(spark, sf).groupBy("vt").agg(F.count(F.lit(1)).alias("n"))


def bfs_dist(spark, sf):
    _, e = _near(spark, sf)
    return traversal.capped_distances(e, _vts(e), 5)


def hop_dist(spark, sf):
    e = _trade(spark, sf)
    vts = _vts(e)
    return traversal.ego_distances(traversal.khop_edges(e, vts, P.hops), vts, P.hops)


def edges_by_hop(spark, sf):
    e = _trade(spark, sf)
    return traversal.edges_by_hop(e, _vts(e), P.hops)


def hop_masks(spark, sf):
    return traversal.hop_masks(edges_by_hop(spark, sf), P.hops)


def ego_record(spark, sf):
    _, e = _near(spark, sf)
    rec = traversal.ego_records(e, _vts(e), P.hops)
    text = lambda ids: F.array_join(F.transform(ids, lambda x: x.cast("string")), ",")
    return rec.select("vt", "subg_size", *[F.coalesce(text(F.col("edges_by_hop")[h]), F.lit("")).alias(f"hop{h}") for h in (1, 2, 3)])


def degree_rank(spark, sf):
    return traversal.degree_rank(_trade(spark, sf))


def _clusters(vts: DataFrame, parts: int = 4) -> DataFrame:
    return vts.select((F.col("vt") % parts).cast("int").alias("cluster"), F.col("vt").alias("node"))


def induced(spark, sf):
    e = _trade(spark, sf)
    return traversal.induced_edges(e, _clusters(_vts(e)), key="cluster")


def core_number(spark, sf):
    return traversal.core_numbers(_trade(spark, sf))


def core_rank(spark, sf):
    cores = core_number(spark, sf).withColumn("cluster", (F.col("node") % 4).cast("int"))
    return traversal.core_rank(cores).select("cluster", "node", "core", F.col("pos").cast("long").alias("pos"))


def cluster_order(spark, sf):
    e = _trade(spark, sf)
    return traversal.cluster_order(e, _clusters(_vts(e), 2)).select("cluster", "node", "core", F.col("pos").cast("long").alias("pos"))


# ---------------------------------------------------------------- masks and small forms


def _mask(edges: DataFrame) -> DataFrame:
    return edges.filter(seeded(P.seed, F.col("edge_id")) < "8").select("edge_id")


def mask_semi(spark, sf):
    e = _trade(spark, sf)
    return e.join(_mask(e), "edge_id", "left_semi")


def mask_anti(spark, sf):
    e = _trade(spark, sf)
    return e.join(_mask(e), "edge_id", "left_anti")


def chunk_round(spark, sf):
    return partition.even_chunks(graphs.embedding_nodes(spark, sf).select(F.col("node_id").alias("vt")), P.workers, P.seed)


def chunk_fixed(spark, sf):
    return partition.fixed_chunks(graphs.embedding_nodes(spark, sf).select(F.col("node_id").alias("vt")), 100)


def frontier_sample(spark, sf):
    e = _trade(spark, sf)
    hop = traversal.edges_by_hop(e, _vts(e), P.hops)
    return scoring.sample_frontier(hop, HOP, P.frontier_limit, P.frontier_keep, P.seed)


# ------------------------------------------------------------------------ selection


def seed_conflicts(spark, sf):
    _, e = _near(spark, sf)
    return selection.seed_conflicts(e, _vts(e), 3)


def select_seeds(spark, sf):
    _, e = _near(spark, sf)
    return selection.select_seeds(e, traversal.degree_rank(e), P.workers, 5)


def grow_groups(spark, sf):
    _, e = _near(spark, sf)
    sizes = traversal.khop_nodes(e, _vts(e), P.hops).groupBy("vt").agg(F.count(F.lit(1)).alias("n"))
    return selection.test_nodes(e, sizes, P.workers, 30, 5, 200, P.seed)


# -------------------------------------------------------- similarity and partitioning


def _sets(spark, sf) -> tuple[DataFrame, DataFrame, DataFrame]:
    _, e = _near(spark, sf)
    vts = _vts(e)
    return e, vts, settle(traversal.neighbour_sets(e, vts, P.hops))


def pair_jaccard(spark, sf):
    return partition.pair_jaccard(_sets(spark, sf)[2]).select("i", "j", "inter", "uni", _r("jaccard"))


def pair_distance(spark, sf):
    return partition.pair_distance(partition.pair_jaccard(_sets(spark, sf)[2])).select("i", "j", _r("distance"))


def sim_graph(spark, sf):
    return partition.similarity_graph(partition.pair_jaccard(_sets(spark, sf)[2]), 0.3).select("i", "j", _r("jaccard"))


def minhash_sig(spark, sf):
    return partition.minhash(_sets(spark, sf)[2], 16)


def _candidates(spark, sf):
    _, vts, sets = _sets(spark, sf)
    return vts, settle(partition.lsh_candidates(partition.minhash(sets, 32), 8, 4))


def lsh_candidates(spark, sf):
    return _candidates(spark, sf)[1]


def lsh_clusters(spark, sf):
    return partition.lsh_clusters(*_candidates(spark, sf))


def balance_split(spark, sf):
    """Chunk numbers of clusters over the limit: runs of the target size in id order."""
    led = lsh_clusters(spark, sf)
    total = led.count()
    target, most = total // P.workers, int(1.1 * (total // P.workers))
    sized = led.join(led.groupBy("leader").agg(F.count(F.lit(1)).alias("n")), "leader")
    from pyspark.sql.window import Window

    rank = F.row_number().over(Window.partitionBy("leader").orderBy("vt")) - 1
    return sized.select("leader", "vt", F.when(F.col("n") > most, F.floor(rank / target)).otherwise(0).cast("long").alias("chunk"))


def cluster_exact(spark, sf):
    _, vts, sets = _sets(spark, sf)
    return partition.partition(sets, vts, P.workers, "exact")


def balance_lsh(spark, sf):
    _, vts, sets = _sets(spark, sf)
    return partition.partition(sets, vts, P.workers, "lsh", 64, 0.5)


def lpt_merge(spark, sf):
    led = lsh_clusters(spark, sf).groupBy("leader").agg(F.array_sort(F.collect_list("vt")).alias("m")).orderBy("leader").collect()
    return partition.as_table(spark, partition.merge_largest_first([r["m"] for r in led], P.workers))


def split_bucket(spark, sf):
    _, vts, sets = _sets(spark, sf)
    members = {r["vt"]: set(r["s"]) for r in sets.groupBy("vt").agg(F.collect_set("node").alias("s")).collect()}
    return partition.as_table(spark, partition.split_bucket(sorted(r["vt"] for r in vts.collect()), members, 15))


# --------------------------------------------------------------------------- models


def _probs(out: DataFrame) -> DataFrame:
    classes = out.select("node", F.posexplode(measures.softmax(F.col("h"))).alias("class", "p"))
    return classes.select("node", "class", _r("p"))


def _forward(name: str):
    def run(spark, sf):
        nodes, edges = _near(spark, sf)
        hidden = 2 if name == "gat" else P.hidden
        return _probs(models.forward(name, nodes, edges, models.fixed_model(name, WIDTH, hidden, P.classes)))

    return run


def gcn_norm(spark, sf):
    nodes, edges = _near(spark, sf)
    return models.gcn_norm(nodes.select(F.col("node_id").alias("node")), edges, []).select("src", "dst", _r("w"))


def softmax(spark, sf):
    nodes = graphs.embedding_nodes(spark, sf)
    p = nodes.select("node_id", F.posexplode(measures.softmax(F.col("x"))).alias("k", "p"))
    return p.select("node_id", "k", _r("p"))


def activations(spark, sf):
    nodes = graphs.embedding_nodes(spark, sf)
    x = F.col("x")
    zipped = F.posexplode(F.arrays_zip(measures.relu(x).alias("relu"), measures.elu(x).alias("elu"), measures.log_softmax(x).alias("ls"))).alias("k", "a")
    rows = nodes.select("node_id", zipped).select("node_id", "k", F.col("a.relu").alias("relu"), F.col("a.elu").alias("elu"), F.col("a.ls").alias("log_softmax"))
    return rows.select("node_id", "k", _r("relu"), _r("elu"), _r("log_softmax"))


def train(spark, sf):
    """Loss of each epoch of the two-layer network on its training split, from training on Spark."""
    from skylume.operators.training import train_gcn2

    nodes, edges = _near(spark, sf)
    split = graphs.split_positional(nodes, nodes.count(), 1).filter("split = 'train'").select("node_id")
    _, losses = train_gcn2(nodes, edges, split, P.hidden, P.classes, epochs=200, seed=P.seed)
    return spark.createDataFrame([(k, float(v)) for k, v in enumerate(losses)], "epoch int, loss double")


# -------------------------------------------------------------------------- scoring


def pred_ego(spark, sf):
    w = _Wave(spark, sf)
    return scoring.ego_prediction(w.members, w.ego, w.first, w.layers).select("vt", "label", _r("p0"))


def candidates(spark, sf):
    return _Wave(spark, sf).states().groupBy("vt", "cand").agg(F.count(F.lit(1)).alias("n_edges"))


def pred_sub(spark, sf):
    return _Wave(spark, sf).scored().select("vt", "cand", _r("p_sub"), "factual")


def pred_comp(spark, sf):
    return _Wave(spark, sf).scored().select("vt", "cand", _r("p_comp"), "counterfactual")


def fidelity(spark, sf):
    return _Wave(spark, sf).scored().select("vt", "cand", "n_edges", _r("fid_plus"), _r("fid_minus"), "factual", "counterfactual")


def verify(spark, sf):
    return scoring.verified(_Wave(spark, sf).scored().filter("cand >= 0")).select("vt", "cand", "factual", "counterfactual")


def marginal(spark, sf):
    w = _Wave(spark, sf)
    return scoring.marginal(w.scored(), w.ego).select("vt", "cand", _r("t"))


def position(spark, sf):
    return _Wave(spark, sf).ranked().select("vt", "cand", _r("p_plus"), _r("p_minus"), _r("p_size"))


def grid_cell(spark, sf):
    return _Wave(spark, sf).ranked().select("vt", "cand", "c_plus", "c_minus")


def argmin_edge(spark, sf):
    return scoring.best_removal(_Wave(spark, sf).ranked()).select("vt", "cand")


def greedy_step(spark, sf):
    """The state after the wave's best removal: (vt, edge_id)."""
    w = _Wave(spark, sf)
    return w.states().join(scoring.best_removal(w.ranked()).select("vt", "cand"), ["vt", "cand"]).select("vt", "edge_id")


def skyline_heads(spark, sf):
    return scoring.bucket_heads(_Wave(spark, sf).ranked())


def pareto(spark, sf):
    return scoring.pareto(_Wave(spark, sf).ranked()).select("vt", "cand")


def ipf(spark, sf):
    w = _Wave(spark, sf)
    ranked = settle(w.ranked())
    heads = scoring.bucket_heads(ranked).select("vt", "cand").join(ranked, ["vt", "cand"])
    return scoring.ipf(heads).select("vt", _r("ipf"))


def ipf_workers(spark, sf):
    rows = ipf(spark, sf).withColumn("cluster", F.col("vt") % P.workers)
    return rows.groupBy("cluster").agg(F.avg("ipf").alias("m")).agg(F.avg("m").alias("ipf")).select(_r("ipf"))


def _found(spark, sf, method: str):
    nodes, edges = _near(spark, sf)
    return search.explain(nodes, edges, _vts(edges), Params(method=method), _model(), rest=True)


def skyline(spark, sf):
    """The flagship: the k-skyline of every node of the nearest-neighbour graph, and what the k cells have no room for (not kept)."""
    return _found(spark, sf, "simple").select("vt", "rank", "c_plus", "c_minus", "cnt", "n_edges", "edge_ids", _r("fid_plus"), _r("fid_minus"), "subg_size", "kept")


def skyline_share(spark, sf):
    return _found(spark, sf, "share")


def skyline_share_cluster(spark, sf):
    return _found(spark, sf, "share_cluster")


NAMES = """
split_positional split_stratified drop_self_loops symmetrize ego_reload has_edge khop_nodes khop_edges lhop_nbrs
lhop_sets lhop_sizes bfs_dist hop_dist edges_by_hop hop_masks ego_record degree_rank induced core_number core_rank
cluster_order mask_semi mask_anti chunk_round chunk_fixed frontier_sample seed_conflicts select_seeds grow_groups
pair_jaccard pair_distance sim_graph minhash_sig lsh_candidates lsh_clusters balance_split cluster_exact balance_lsh
lpt_merge split_bucket gcn_norm softmax activations train pred_ego candidates pred_sub pred_comp fidelity verify
marginal position grid_cell argmin_edge greedy_step skyline_heads pareto ipf ipf_workers skyline skyline_share
skyline_share_cluster
""".split()


def queries() -> dict:
    out = {n: globals()[n] for n in NAMES}
    for name, key in (("gcn1", "gcn1"), ("gcn2", "gcn2"), ("gcn", "gcn3"), ("gcn4", "gcn4"), ("gat", "gat"), ("gin", "gin"), ("sage", "sage")):
        out[f"{key}_forward"] = _forward(name)
    return out
