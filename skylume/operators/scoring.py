"""One wave of candidate scoring as relations: states, predictions, fidelities, cells.

A state is a set of ego edges: rows (vt, cand, edge_id, src, dst), where cand is the edge
removed from the wave's start, or -1 for the start itself.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skylume.functions.measures import grid_cell, relative_size, softmax
from skylume.operators.models import Layer, gcn
from skylume.operators.traversal import khop_nodes
from skylume.plans.dense import Egos
from skylume.session import seeded

KEYS = ["vt", "cand"]


def sample_frontier(hop_edges: DataFrame, hop: int, limit: int, keep: int, seed: int) -> DataFrame:
    """(vt, cand): edges of a hop; of more than ``limit``, the ``keep`` first in hashed order."""
    edges = hop_edges.filter(F.col("hop") == hop).select("vt", "edge_id")
    order = seeded(seed, F.col("vt"), hop, F.col("edge_id"))
    rank = F.row_number().over(Window.partitionBy("vt").orderBy(order, "edge_id"))
    sized = edges.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("vt"))).withColumn("r", rank)
    return sized.filter((F.col("n") <= limit) | (F.col("r") <= keep)).select("vt", F.col("edge_id").alias("cand"))


def expand(start: DataFrame, frontier: DataFrame) -> DataFrame:
    """States of a wave: the start (vt, edge_id, src, dst) and it without each frontier edge.

    Nothing is expanded where one edge or less is left.
    """
    size = start.groupBy("vt").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("vt")
    moves = frontier.unionByName(frontier.select("vt").distinct().withColumn("cand", F.lit(-1).cast("long"))).join(size, "vt")
    return start.join(moves, "vt").filter("edge_id <> cand").select("vt", "cand", "edge_id", "src", "dst")


def complement(states: DataFrame, ego_edges: DataFrame) -> DataFrame:
    """(vt, cand, edge_id, src, dst): ego edges that a state lacks."""
    grid = ego_edges.join(states.select("vt", "cand").distinct(), "vt")
    return grid.join(states.select("vt", "cand", "edge_id"), ["vt", "cand", "edge_id"], "left_anti").select("vt", "cand", "edge_id", "src", "dst")


def outside_degree(edges: DataFrame, ego_edges: DataFrame, members: DataFrame) -> DataFrame:
    """(vt, node, outside): in-edges of an ego's nodes that come from outside the ego."""
    full = edges.groupBy(F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("full"))
    inside = ego_edges.groupBy("vt", F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("inside"))
    joined = members.join(full, "node", "left").join(inside, ["vt", "node"], "left")
    return joined.select("vt", "node", (F.coalesce("full", F.lit(0)) - F.coalesce("inside", F.lit(0))).alias("outside"))


def predict(members: DataFrame, states: DataFrame, instances: DataFrame, first: DataFrame, layers: list[Layer]) -> DataFrame:
    """(vt, cand, probs): class shares of vt under each state of ``instances`` (vt, cand)."""
    nodes = instances.join(members, "vt")
    out = gcn(nodes, states.select(*KEYS, "src", "dst"), first, layers, KEYS)
    return out.filter(F.col("node") == F.col("vt")).select(*KEYS, softmax(F.col("h")).alias("probs"))


#: Egos that meet in one group of the grouped maps, and the groups at least.
EGOS, GROUPS = 256, 64


def _grouped(egos: DataFrame, members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Ego edges and members (vt, node, outside, h) as rows of one table, and each vt's group."""
    count = members.select("vt").distinct().count()
    group = F.pmod(F.xxhash64("vt"), F.lit(max(GROUPS, count // EGOS)))
    none = F.lit(None)
    edges = egos.select("vt", "edge_id", "src", "dst", none.cast("double").alias("outside"), none.cast("array<double>").alias("h"))
    nodes = members.select("vt", none.cast("long").alias("edge_id"), F.col("node").alias("src"), none.cast("long").alias("dst"), F.col("outside").cast("double").alias("outside"), "h")
    return edges.unionByName(nodes).withColumn("grp", group), group


def _egos(pdf) -> Egos | None:
    """The egos of a group's rows."""
    node = pdf["edge_id"].isna().to_numpy()
    if not node.any():
        return None
    n, e = pdf[node], pdf[~node]
    nodes = {"vt": n["vt"].to_numpy(), "node": n["src"].to_numpy(), "outside": n["outside"].to_numpy(), "h": np.stack(n["h"].to_list())}
    return Egos(nodes, {c: e[c].to_numpy(dtype=np.int64) for c in ("vt", "edge_id", "src", "dst")})


def ego_prediction(members: DataFrame, ego_edges: DataFrame, first: DataFrame, layers: list[Layer]) -> DataFrame:
    """(vt, label, p0): class of vt on its own ego and its share.

    Egos are small graphs of their own: a group of them is scored in one pass of the networks.
    """
    import pandas as pd

    rows, _ = _grouped(ego_edges, members.select("vt", "node", F.lit(0.0).alias("outside")).join(first, "node"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        egos = _egos(pdf)
        label, p0 = egos.origins(layers) if egos else ([], [])
        return pd.DataFrame({"vt": egos.vts if egos else [], "label": label, "p0": p0})

    return rows.groupBy("grp").applyInPandas(run, "vt long, label int, p0 double")


def fidelities(edges: DataFrame, ego_edges: DataFrame, members: DataFrame, states: DataFrame, first: DataFrame, layers: list[Layer]) -> DataFrame:
    """(vt, cand, n_edges, fid_plus, fid_minus, factual, counterfactual, p_sub, p_comp).

    ``ego_edges`` and ``members`` are read several times: settle them if they are costly to make.
    The complement is over the whole graph; a network no deeper than the ego's radius sees of
    the rest only the in-degrees, so the ego with ``outside`` degrees stands for all of it.
    A group of egos meets its states and is scored in one pass of the networks.
    """
    import pandas as pd

    rest = outside_degree(edges, ego_edges, members).join(first, "node")
    rows, group = _grouped(ego_edges, rest)
    # New column identities: states descend from the same edges as the rows they meet.
    tried = states.select(*[F.col(c).alias(c) for c in ("vt", "cand", "edge_id")]).withColumn("grp", group)
    schema = "vt long, cand long, n_edges long, fid_plus double, fid_minus double, factual boolean, counterfactual boolean, p_sub double, p_comp double"

    def run(key, states: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        egos = _egos(rows) if len(states) else None
        if egos is None:
            return pd.DataFrame({c.split()[0]: [] for c in schema.split(", ")})
        vt, cand, edge = (states[c].to_numpy() for c in ("vt", "cand", "edge_id"))
        # States are numbered by (vt, cand); each has a mask over its ego's edges.
        order = np.lexsort((cand, vt))
        vt, cand, edge = vt[order], cand[order], edge[order]
        new = np.r_[True, (vt[1:] != vt[:-1]) | (cand[1:] != cand[:-1])]
        state, of = np.cumsum(new) - 1, np.searchsorted(egos.vts, vt[new])
        m = np.diff(egos.edge_at)[of]
        every = np.unique(egos.edge_id)
        keys = np.searchsorted(egos.vts, egos.edge_vt) * len(every) + np.searchsorted(every, egos.edge_id)
        place = np.searchsorted(keys, of[state] * len(every) + np.searchsorted(every, edge))
        mask = np.zeros(int(m.sum()), dtype=bool)
        mask[place - egos.edge_at[of][state] + (np.cumsum(m) - m)[state]] = True
        label, p0 = (x[of] for x in egos.origins(layers))
        sub, comp = egos.shares(of, mask, False, layers), egos.shares(of, ~mask, True, layers)
        p_sub, p_comp = (p[np.arange(len(of)), label] for p in (sub, comp))
        values = [vt[new], cand[new], np.bincount(state), p0 - p_comp, p_sub - p0 + 1, sub.argmax(axis=1) == label, comp.argmax(axis=1) != label, p_sub, p_comp]
        return pd.DataFrame({c.split()[0]: v for c, v in zip(schema.split(", "), values, strict=True)})

    return tried.groupBy("grp").cogroup(rows.groupBy("grp")).applyInPandas(run, schema)


def verified(scored: DataFrame) -> DataFrame:
    return scored.filter("factual or counterfactual")


def marginal(scored: DataFrame, ego_edges: DataFrame) -> DataFrame:
    """Verified candidates with t, the mean loss against the wave's start, and their cells' inputs."""
    size = ego_edges.groupBy("vt").agg(F.count(F.lit(1)).alias("subg_size"))
    start = scored.filter("cand = -1").select("vt", F.col("fid_plus").alias("plus0"), F.col("fid_minus").alias("minus0"))
    rows = verified(scored.filter("cand >= 0")).join(start, "vt").join(size, "vt")
    t = (F.col("plus0") - F.col("fid_plus") + F.col("minus0") - F.col("fid_minus") - 1.0 / F.col("subg_size")) / 3
    return rows.withColumn("t", F.round(t, 9))


def positions(rows: DataFrame, epsilon: float) -> DataFrame:
    """Positions (smaller is better) and grid cells of scored rows with subg_size."""
    out = rows.withColumns({"p_plus": 1 - F.col("fid_plus"), "p_minus": 1 - F.col("fid_minus"), "p_size": relative_size(F.col("n_edges"), F.col("subg_size"))})
    return out.withColumns({"c_plus": grid_cell(F.col("p_plus"), epsilon), "c_minus": grid_cell(F.col("p_minus"), epsilon)})


def best_removal(rows: DataFrame) -> DataFrame:
    """(vt, cand, t): the removal with the least loss, ties to the smaller edge."""
    best = rows.groupBy("vt").agg(F.min(F.struct("t", "cand")).alias("b"))
    return best.select("vt", "b.cand", "b.t")


def bucket_heads(rows: DataFrame) -> DataFrame:
    """(vt, c_plus, c_minus, cnt, n_edges, cand): smallest state of each cell, first in edge order."""
    grouped = rows.groupBy("vt", "c_plus", "c_minus").agg(F.count(F.lit(1)).alias("cnt"), F.min(F.struct("n_edges", "cand")).alias("h"))
    return grouped.select("vt", "c_plus", "c_minus", "cnt", "h.n_edges", "h.cand")


def pareto(rows: DataFrame) -> DataFrame:
    """Rows no other row of the same vt dominates in all three positions (to 9 decimals)."""
    rows = rows.withColumns({c: F.round(c, 9) for c in ("p_plus", "p_minus", "p_size")})
    p, q = rows.alias("p"), rows.select("vt", "p_plus", "p_minus", "p_size").distinct().alias("q")
    no_worse = (F.col("q.p_plus") <= F.col("p.p_plus")) & (F.col("q.p_minus") <= F.col("p.p_minus")) & (F.col("q.p_size") <= F.col("p.p_size"))
    better = (F.col("q.p_plus") < F.col("p.p_plus")) | (F.col("q.p_minus") < F.col("p.p_minus")) | (F.col("q.p_size") < F.col("p.p_size"))
    return p.join(q, (F.col("p.vt") == F.col("q.vt")) & no_worse & better, "left_anti")


def ipf(heads: DataFrame) -> DataFrame:
    """(vt, ipf) of heads with fid_plus, fid_minus, n_edges, subg_size: mean of three measures."""
    conc = 1 - relative_size(F.col("n_edges"), F.col("subg_size"))
    return heads.groupBy("vt").agg(F.avg((F.col("fid_plus") + F.col("fid_minus") + conc) / 3).alias("ipf"))


def members_of(edges: DataFrame, vts: DataFrame, hops: int) -> DataFrame:
    return khop_nodes(edges, vts, hops).select("vt", "node")
