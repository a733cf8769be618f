import math
import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from skylume.config import Params, load_params
from skylume.operators import models, partition, scoring, selection, traversal
from skylume.plans import dense, search
from skylume.session import settle
from skylume.sources import graphs
from tests import graph7


@pytest.fixture(scope="module")
def g7(spark):
    return graph7.tables(spark)


def test_numbered_edges_are_ranked(spark, g7):
    _, edges, _ = g7
    got = graphs.number_edges(edges.select("src", "dst"), width=3)
    assert sorted(map(tuple, got.collect())) == [(i, s, d) for i, (s, d) in enumerate(graph7.EDGES)]


def test_egos(g7):
    _, edges, vts = g7
    got = {}
    for r in traversal.edges_by_hop(edges, vts, 2).collect():
        got.setdefault(r.vt, {}).setdefault(r.hop, []).append(r.edge_id)
    assert {v: {h: sorted(e) for h, e in x.items()} for v, x in got.items()} == {v: x[1] for v, x in graph7.EGOS.items()}
    nodes = {}
    for r in traversal.khop_nodes(edges, vts, 2).collect():
        nodes.setdefault(r.vt, []).append(r.node)
    assert {v: sorted(x) for v, x in nodes.items()} == {v: x[0] for v, x in graph7.EGOS.items()}


def test_masks_of_an_empty_hop_stay_full(g7):
    _, edges, vts = g7
    hops = traversal.edges_by_hop(edges, vts, 2)
    masks = traversal.hop_masks(hops, 2)
    sizes = {(r.vt, r.mask_hop): r.n for r in masks.groupBy("vt", "mask_hop").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert sizes[0, 1] == 4 and sizes[0, 2] == 10 and sizes[0, 3] == 12
    assert sizes[1, 3] == 14  # no third hop: the whole ego


def test_core_numbers_equal_peeling(spark):
    rng = np.random.default_rng(3)
    pairs = {(int(a), int(b)) for a, b in rng.integers(0, 25, (70, 2)) if a != b}
    near = {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    core, left, k = {}, {v: set(n) for v, n in near.items()}, 0
    while left:
        low = [v for v in left if len(left[v]) <= k]
        if not low:
            k += 1
            continue
        for v in low:
            core[v] = k
            for u in left.pop(v):
                if u in left:
                    left[u].discard(v)
    df = spark.createDataFrame([(a, b) for a, b in pairs], "src long, dst long")
    assert {r.node: r.core for r in traversal.core_numbers(df).collect()} == core


def test_lex_first_equals_sequential(spark):
    rng = np.random.default_rng(4)
    rivals = {(int(a), int(b)) for a, b in rng.integers(0, 40, (60, 2)) if a != b}
    rivals |= {(b, a) for a, b in rivals}
    taken = []
    for v in range(40):
        if not any((u, v) in rivals for u in taken):
            taken.append(v)
    order = spark.createDataFrame([(v, v) for v in range(40)], "v long, rank long")
    got = traversal.lex_first_independent(order, spark.createDataFrame(list(rivals), "u long, v long"))
    assert sorted(r.v for r in got.collect()) == taken


def test_predictions_of_the_whole_graph(spark, g7):
    nodes, edges, _ = g7
    out = models.forward("gcn2", nodes, edges, graph7.LAYERS).collect()
    p0 = {r.node: dense.softmax(np.array(r.h))[0] for r in out}
    assert [round(float(p0[v]), 6) for v in range(7)] == [0.649497, 0.67933, 0.485674, 0.460459, 0.355261, 0.490332, 0.274544]


@pytest.mark.parametrize("name", sorted(models.DEPTH))
def test_networks_agree_with_numpy(spark, g7, name):
    nodes, edges, _ = g7
    model = models.fixed_model(name, 2, 3, 4, heads=2)
    got = {r.node: r.h for r in models.forward(name, nodes, edges, model).collect()}
    src, dst = np.array([e[0] for e in graph7.EDGES]), np.array([e[1] for e in graph7.EDGES])
    want = dense.outputs(name, model, np.array(graph7.X, dtype=float), src, dst, np.zeros(7))
    np.testing.assert_allclose(np.array([got[v] for v in range(7)]), want, atol=1e-12)


def test_unknown_model_is_an_error():
    with pytest.raises(ValueError, match="unknown model"):
        models.fixed_model("mlp", 2, 2, 2)


def test_fidelity_of_the_ego_itself(g7):
    nodes, edges, vts = g7
    one = vts.filter("vt = 0")
    edges = settle(edges)
    members = settle(scoring.members_of(edges, one, 2))
    hops = settle(traversal.edges_by_hop(edges, one, 2))
    ego = hops.select("vt", "edge_id", "src", "dst")
    frontier = hops.filter("edge_id = 0").select("vt", F.col("edge_id").alias("cand"))
    states = settle(scoring.expand(ego, frontier))
    first = settle(models.project(nodes, graph7.LAYERS[0]))
    scored = settle(scoring.fidelities(edges, ego, members, states, first, graph7.LAYERS))
    got = {r.cand: r for r in scored.collect()}
    assert round(got[-1].fid_plus, 6) == -0.310740 and round(got[-1].fid_minus, 6) == 1.0 and got[-1].factual
    assert round(got[0].fid_plus, 6) == -0.310740 and round(got[0].fid_minus, 6) == 0.970265
    cells = scoring.positions(scoring.marginal(scored, ego), 0.1).collect()
    assert [(r.cand, r.c_plus, r.c_minus) for r in cells] == [(0, 2, -37)]


GOLDEN = {
    (0, 10): (0.503308, {(2, -23): (1, [0, 1, 2, 4, 5, 6, 7, 8, 11]), (2, -145): (19, [1, 2, 5]), (1, -21): (1, [0, 1, 5]), (-3, -145): (2, [1, 2])}),
    (0, 3): (0.686349, {(2, -145): (19, [1, 2, 5]), (-3, -145): (2, [1, 2]), (-2, -145): (1, [1])}),
    (6, 10): (0.569495, {(1, -145): (20, [13, 15, 17]), (-6, -145): (2, [13, 17]), (-3, -145): (3, [13]), (-2, -145): (1, [17])}),
}


@pytest.mark.parametrize("vt,k", sorted(GOLDEN))
def test_skyline_goldens(g7, vt, k):
    nodes, edges, vts = g7
    found = search.skyline(nodes, edges, vts.filter(F.col("vt") == vt), Params(k=k), graph7.LAYERS)
    rows = found.collect()
    ipf, buckets = GOLDEN[vt, k]
    got = {(r.c_plus, r.c_minus): (r.cnt, r.edge_ids) for r in rows}
    assert len(rows) <= k and {c: got[c] for c in buckets} == buckets
    assert round(search.heads_ipf(found).first().ipf, 6) == ipf


def test_sharing_reuses_scores(g7):
    nodes, edges, vts = g7
    clusters = vts.select(F.lit(0).alias("cluster"), F.col("vt").alias("pos"), F.col("vt").alias("node"))
    rows = search.skyline_shared(nodes, edges, clusters, Params(), graph7.LAYERS).collect()
    assert {r.vt for r in rows} == set(range(7)) and rows[0].cache_hits > 0 and rows[0].cache_size <= len(graph7.EDGES)


@pytest.mark.parametrize("method", ["share", "share_cluster"])
def test_methods(g7, method):
    nodes, edges, vts = g7
    rows = search.explain(nodes, edges, vts, Params(method=method, workers=2), graph7.LAYERS)
    assert {r.vt for r in rows.collect()} == set(range(7))
    assert 0 < search.workers_ipf(rows).first().ipf < 1


def test_deeper_network_sees_messages_from_outside(g7):
    nodes, edges, vts = g7
    model = models.fixed_model("gcn", 2, 3, 2)
    rows = search.skyline(nodes, edges, vts, Params(model="gcn"), model).collect()
    assert {r.vt for r in rows} <= set(range(7)) and all(set(r.edge_ids) <= {e for h in graph7.EGOS[r.vt][1].values() for e in h} for r in rows)


def test_isolated_nodes_are_skipped(spark, g7):
    nodes, edges, _ = g7
    lone = spark.createDataFrame([(0,), (99,), (0,)], "vt long")
    rows = search.skyline(nodes, edges, lone, Params(), graph7.LAYERS).collect()
    assert {r.vt for r in rows} == {0} and len({r["rank"] for r in rows}) == len(rows)


def test_balance_goldens():
    groups = [[1, 2, 3, 4, 5, 6, 7], [8], [9], [10]]
    assert partition.balance(groups, 2) == [[10, 6, 7, 8, 9], [1, 2, 3, 4, 5]]
    alike = {v: {0} for v in range(1, 11)}
    assert partition.split_bucket([1, 2, 3, 4, 5, 6, 7], alike, 5) == [[1, 7, 6, 5, 4], [2, 3]]
    assert partition.balance_buckets(groups, 2, alike) == [[1, 7, 6, 5, 4], [2, 3, 8, 9, 10]]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 30), min_size=1, max_size=12), st.integers(1, 6))
def test_balance_keeps_every_node(sizes, parts):
    nodes = iter(range(1000))
    groups = [[next(nodes) for _ in range(n)] for n in sizes]
    out = partition.balance(groups, parts)
    assert sorted(v for g in out for v in g) == list(range(sum(sizes)))
    assert len(out) == min(parts, sum(sizes))


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 5), st.lists(st.tuples(st.integers(0, 4), st.integers(0, 4), st.integers(1, 9)), max_size=40))
def test_buckets_stay_within_k(k, offers):
    b = search.Buckets(k)
    for x, y, size in offers:
        b.offer((x, y), size, None)
    assert len(b.cells) <= k and all(count >= 1 for count, _, _ in b.cells.values())


def test_banding_follows_the_threshold():
    assert partition.banding(0.7, 256) == (25, 10) and partition.banding(0.5, 128) == (25, 5)


def test_even_chunks_sizes(spark):
    vts = spark.createDataFrame([(i,) for i in range(10)], "vt long")
    sizes = sorted(r["count"] for r in partition.even_chunks(vts, 4, 1).groupBy("cluster").count().collect())
    assert sizes == [2, 2, 3, 3]


def test_seeds_and_groups(spark, g7):
    _, edges, vts = g7
    ranks = traversal.degree_rank(edges)
    assert [r.node for r in selection.select_seeds(edges, ranks, 8, 5).collect()] == [1]
    near = {}
    for s, d in graph7.EDGES:
        near.setdefault(s, []).append(d)
    assert selection.grow([1], near, set(range(7)), 4) == [[1, 0, 2, 3]]
    assert sorted(v for g in selection.grow([1, 2], near, set(range(7)), 5) for v in g) == list(range(7))


def test_nearest_by_blocks_equals_broadcast(spark):
    nodes = graphs.embedding_nodes(spark, "/root/testdata/sf0.001").filter("node_id < 120")
    near = sorted(map(tuple, graphs.nearest_pairs(nodes, 2).collect()))
    assert near == sorted(map(tuple, graphs._nearest_by_join(nodes.select("node_id", "x"), 2, blocks=4).collect()))


@pytest.mark.parametrize("k", [1, 2, 3])
def test_nearest_equals_all_pairs(k):
    """Copies tie to the smaller id; near copies closer than single precision tells apart are still ranked."""
    rng = np.random.default_rng(k)
    base = rng.normal(size=(150, 8))
    vectors = np.vstack([base, np.repeat(base[:3], 40, axis=0), base[:60] + 1e-9 * rng.normal(size=(60, 8)), np.zeros((2, 8))])
    ids = np.sort(rng.permutation(1000)[: len(vectors)])
    vectors = vectors[rng.permutation(len(vectors))]
    dot = lambda a, b: sum(float(x) * float(y) for x, y in zip(a, b, strict=True))
    want = []
    for i, a in zip(ids, vectors, strict=True):
        sims = [(-min(1.0, dot(a, b) / s) if (s := math.sqrt(dot(a, a) * dot(b, b))) else 0.0, j) for j, b in zip(ids, vectors, strict=True) if j != i]
        want += [(i, j) for _, j in sorted(sims)[:k]]
    targets = graphs._Targets(ids, vectors, k)
    src, dst, _ = targets.nearest(ids, vectors, rows=7, lane=16)
    assert list(zip(src, dst, strict=True)) == want
    assert len(targets.ids) < len(ids)


def test_nearest_takes_large_tables_in_time():
    """30000 vectors: a sort of all pairs takes minutes."""
    vectors = np.random.default_rng(1).normal(size=(30000, 16))
    began = time.process_time()
    src, dst, _ = graphs._Targets(np.arange(30000), vectors, 2).nearest(np.arange(4000), vectors[:4000])
    assert time.process_time() - began < 20 and len(src) == len(dst) == 8000


def test_files_round_trip(spark, g7, tmp_path):
    nodes, edges, vts = g7
    graphs.write_graph(nodes, edges, str(tmp_path / "g"))
    n, e = graphs.read_graph(spark, str(tmp_path / "g"))
    assert n.count() == 7 and e.count() == 18
    for batch, k in ((0, 2), (1, 5)):
        graphs.save_batch(vts.filter(f"vt % {batch + 1} = 0").withColumn("subg_size", F.col("vt") * k), str(tmp_path / "rec"), batch)
    got = {r.vt: r.subg_size for r in graphs.latest(spark.read.parquet(str(tmp_path / "rec"))).collect()}
    assert got[1] == 2 and got[2] == 10
    (tmp_path / "index").write_text("3\n1\n\n")
    assert sorted(r.node_id for r in graphs.read_index(spark, str(tmp_path / "index")).collect()) == [1, 3]


def test_params(tmp_path):
    (tmp_path / "p").write_text("k: 4  # few\nmodel: sage\n")
    assert load_params(str(tmp_path / "p")) == Params(k=4, model="sage")
    (tmp_path / "p").write_text("kk: 4\n")
    with pytest.raises(ValueError, match="kk"):
        load_params(str(tmp_path / "p"))


def test_training_lowers_the_loss(spark, g7):
    from skylume.operators.training import _train_propagated, train_gcn2

    nodes, edges, _ = g7
    ids = nodes.select("node_id")
    layers, losses = train_gcn2(nodes, edges, ids, 4, 2, epochs=60)
    assert losses[-1] < losses[0] and len(layers) == 2
    norm = models.gcn_norm(nodes.select(F.col("node_id").alias("node")), edges, [])
    _, far = _train_propagated(nodes, norm, ids, 4, 2, 3, 42)
    assert far[-1] < far[0]


def test_average_link_equals_search_of_all_pairs():
    rng = np.random.default_rng(5)
    for _ in range(40):
        n, parts = int(rng.integers(1, 30)), int(rng.integers(1, 8))
        d = np.triu(rng.integers(0, 6, (n, n)) / 5, 1)
        d += d.T
        groups = {i: [i] for i in range(n)}
        mean = lambda a, b: round(float(np.mean(d[np.ix_(a, b)])), 9)  # noqa: B023, E731
        while len(groups) > parts:
            i, j = min(((i, j) for i in groups for j in groups if i < j), key=lambda p: (mean(groups[p[0]], groups[p[1]]), p))  # noqa: B023
            groups[i] += groups.pop(j)
        assert partition.average_link(d, parts) == [sorted(g) for g in groups.values()]


def test_training_is_the_same_on_spark(spark, g7, monkeypatch):
    from skylume.operators import training

    nodes, edges, _ = g7
    ids = nodes.select("node_id").filter("node_id < 5")
    layers, losses = training.train_gcn2(nodes, edges, ids, 4, 2, epochs=4)
    monkeypatch.setattr(training, "LOCAL_VALUES", 0)
    far_layers, far = training.train_gcn2(nodes, edges, ids, 4, 2, epochs=4)
    np.testing.assert_allclose(far, losses, rtol=1e-9)
    for (w, b), (v, c) in zip(layers, far_layers, strict=True):
        np.testing.assert_allclose(v, w, atol=1e-9)
        np.testing.assert_allclose(c, b, atol=1e-9)


def test_groups_grow_over_the_whole_graph(spark):
    """A hub fills any pool of fixed size; the chain's group still follows the chain."""
    pairs = [(0, v) for v in range(1, 80)] + [(v, v + 1) for v in range(100, 160)]
    pairs = sorted({p for a, b in pairs for p in ((a, b), (b, a))})
    edges = spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(pairs)], "edge_id long, src long, dst long")
    near = {}
    for a, b in pairs:
        near.setdefault(a, []).append(b)
    sizes = spark.createDataFrame([(v, 1) for v in near], "vt long, n long")
    got = {}
    for r in selection.test_nodes(edges, sizes, 2, 15, 2, 10).orderBy("cluster", "pos").collect():
        got.setdefault(r.cluster, []).append(r.node)
    seeds = [got[0][0], got[1][0]]
    assert list(got.values()) == selection.grow(seeds, near, set(near), 15) and min(got[1]) >= 100
    assert got[1][0] >= 100 and max(got[1]) - min(got[1]) == 14


def test_gathered_clusters_come_after_the_others():
    from skylume.operators.partition import balance

    ids = iter(range(19))
    six, three, ten = ([next(ids) for _ in range(n)] for n in (6, 3, 10))
    # Target 9, least 8, most 9: ten is cut in nine and one, the small ones gather behind the nine,
    # and the one left over joins the first of the two that are equally large.
    assert balance([six, three, ten], 2) == [ten[9:] + ten[:9], six + three]


def test_dense_computes_its_input_once(spark):
    """Layers over layers: an input that is computed anew for each column makes 48 * 48 rounds of the first."""
    from skylume.operators.models import dense, fixed_layer

    n = 48
    h = dense(dense(dense(F.col("x"), fixed_layer(0, n, n)), fixed_layer(1, n, n)), fixed_layer(2, n, n))
    rows = spark.range(100).select(F.transform(F.sequence(F.lit(1), F.lit(n)), lambda v: (v + F.col("id")).cast("double")).alias("x"))
    began = time.perf_counter()
    got = np.array(rows.select("x", h.alias("h")).collect()[7].h)
    want = np.arange(8.0, 8 + n)
    for k in range(3):
        want = want @ np.array(fixed_layer(k, n, n)[0])
    np.testing.assert_allclose(got, want, rtol=1e-9)
    assert time.perf_counter() - began < 15


def test_fidelities_score_groups_of_egos_in_one_pass(g7):
    """The same shares as by joins, without a join of every state with every layer (over 100 exchanges before)."""
    nodes, edges, vts = g7
    edges = settle(edges)
    members = settle(scoring.members_of(edges, vts, 2))
    hops = settle(traversal.edges_by_hop(edges, vts, 2))
    ego = hops.select("vt", "edge_id", "src", "dst")
    states = settle(scoring.expand(ego, scoring.sample_frontier(hops, 2, 10, 8, 42)))
    first = settle(models.project(nodes, graph7.LAYERS[0]))
    scored = scoring.fidelities(edges, ego, members, states, first, graph7.LAYERS)
    assert scored._jdf.queryExecution().executedPlan().toString().count("Exchange ") < 20
    got = {(r.vt, r.cand): r for r in scored.collect()}
    origin = {r.vt: r for r in scoring.ego_prediction(members, ego, first, graph7.LAYERS).collect()}
    by_joins = scoring.predict(members, states, states.select("vt", "cand").distinct(), first, graph7.LAYERS).collect()
    sizes = {(r.vt, r.cand): r["count"] for r in states.groupBy("vt", "cand").count().collect()}
    assert set(got) == {(r.vt, r.cand) for r in by_joins} and len(got) > 20
    for r in by_joins:
        own = got[r.vt, r.cand]
        np.testing.assert_allclose([own.p_sub, own.fid_minus], [r.probs[origin[r.vt].label], r.probs[origin[r.vt].label] - origin[r.vt].p0 + 1], atol=1e-12)
        assert own.n_edges == sizes[r.vt, r.cand]


def test_search_scores_egos_together(g7, monkeypatch):
    """A step of all egos of a group is one pass of the networks, not one for each state; the skylines are those of egos alone."""
    nodes, edges, vts = g7
    e, n = (t.toPandas() for t in search.ego_tables(nodes, edges, vts, Params(), graph7.LAYERS))
    passes = []
    shares = dense.Egos.shares
    monkeypatch.setattr(dense.Egos, "shares", lambda self, of, *a: passes.append(len(of)) or shares(self, of, *a))
    together = search.run_together(search.packed(e, n, graph7.LAYERS), Params(), graph7.LAYERS)
    alone = [r for v in sorted(set(e["vt"])) for r in search.run_alone(search.Ego(v, e[e["vt"] == v], n[n["vt"] == v], "gcn2", graph7.LAYERS), Params())]
    assert [r[:7] for r in together] == [r[:7] for r in alone] and len(passes) < sum(passes) / 5
    np.testing.assert_allclose([r[7:9] for r in together], [r[7:9] for r in alone], atol=1e-12)


def test_sparse_average_link_equals_dense(spark, monkeypatch):
    rng = np.random.default_rng(3)
    for _ in range(60):
        n, parts = int(rng.integers(2, 60)), int(rng.integers(1, 9))
        d = np.triu(np.where(rng.random((n, n)) < rng.choice([0.05, 0.2, 0.6]), rng.integers(0, 30, (n, n)) / 30, 1.0), 1)
        i, j = np.nonzero(np.triu(d < 1, 1))
        assert partition.average_link_sparse(n, i, j, d[i, j], parts) == partition.average_link(d + d.T, parts)
    sets = spark.createDataFrame([(v, v // 3 + k) for v in range(60) for k in range(2)], "vt long, node long")
    want = partition.partition(sets, sets.select("vt"), 4).collect()
    monkeypatch.setattr(partition, "MAX_NODES", 10)
    assert partition.partition(sets, sets.select("vt"), 4).collect() == want and len(want) == 60


def test_split_bucket_compares_only_what_overlaps():
    """As the sort of all free nodes gives it; 20000 nodes took over a thousand such sorts."""

    def by_sorting(bucket, sets, size):
        alike = lambda a, b: len(a & b) / len(a | b) if a and b else 0.0
        left, out = list(bucket), []
        while left:
            near = sorted(left[1:], key=lambda v: (alike(sets.get(left[0], set()), sets.get(v, set())), v), reverse=True)[: size - 1]  # noqa: B023
            out.append([left[0], *near])
            left = [v for v in left if v not in set(out[-1])]  # noqa: B023
        return out

    rng = np.random.default_rng(4)
    for _ in range(100):
        bucket = rng.permutation(300)[: int(rng.integers(1, 80))].tolist()
        sets = {v: set(rng.integers(0, 60, rng.integers(0, 7)).tolist()) for v in bucket if rng.random() < 0.9}
        size = int(rng.integers(1, 9))
        assert partition.split_bucket(bucket, sets, size) == by_sorting(bucket, sets, size)
    began = time.process_time()
    groups = partition.split_bucket(list(range(20000)), {v: {v // 4, v // 4 + 1} for v in range(20000)}, 15)
    assert sum(map(len, groups)) == 20000 and time.process_time() - began < 10


def test_training_has_two_products_an_epoch(g7, monkeypatch):
    """Neighbours are added up by column, once on the way forth and once back (by rows in place, three times an epoch, before)."""
    from skylume.operators.training import train_gcn2

    nodes, edges, _ = g7
    calls, count = [], np.bincount
    monkeypatch.setattr(np, "bincount", lambda *a, **b: calls.append(1) or count(*a, **b))
    train_gcn2(nodes, edges, nodes.select("node_id").filter("node_id < 5"), 4, 2, epochs=3)
    assert len(calls) == len(graph7.X[0]) + 3 * 2 * 4


def test_clusters_take_little_of_the_driver(monkeypatch):
    import tracemalloc

    ids = np.arange(3000)
    i, j = (np.concatenate(x) for x in zip(*[(ids[:-k], ids[k:]) for k in range(1, 13)], strict=True))
    pairs = (i, j, ((i * 7 + j * 13) % 89 + 1) / 90)
    tracemalloc.start()
    try:
        groups, most = partition.exact_clusters(ids.tolist(), pairs, 8), tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert most < 4 * len(ids) ** 2
    monkeypatch.setattr(partition, "MAX_NODES", len(ids))
    assert partition.exact_clusters(ids.tolist(), pairs, 8) == groups


def test_pairs_that_draw_nearer_keep_their_turn():
    rng = np.random.default_rng(5)
    for _ in range(120):
        n, parts = int(rng.integers(2, 120)), int(rng.integers(1, 9))
        d = rng.integers(0, 30, (n, n)) / rng.choice([30, 7, 3])
        d = np.triu(np.where(rng.random((n, n)) < rng.choice([0.02, 0.05, 0.2, 0.6]), np.minimum(d, 1), 1.0), 1)
        i, j = np.nonzero(np.triu(d < 1, 1))
        assert partition.average_link_sparse(n, i, j, d[i, j], parts) == partition.average_link(d + d.T, parts)


def test_shared_search_has_a_short_plan(g7):
    nodes, edges, vts = g7
    found = search.explain(nodes, edges, vts, Params(method="share_cluster", workers=2), graph7.LAYERS)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") + plan.count("Aggregate ") < 60


def test_pairs_stay_off_the_driver(spark, monkeypatch):
    import pandas as pd
    from pyspark.sql.classic.dataframe import DataFrame

    sets = spark.createDataFrame([(v, v // 3 + k) for v in range(60) for k in range(2)] + [(99, 999)], "vt long, node long")
    pairs = partition.pair_jaccard(sets).toPandas()
    want = partition.balance(partition.exact_clusters([*range(60), 99], (pairs["i"].to_numpy(), pairs["j"].to_numpy(), pairs["jaccard"].to_numpy()), 4), 4)
    with monkeypatch.context() as m:
        m.setattr(DataFrame, "toPandas", lambda self: pytest.fail("pairs on the driver"))
        m.setattr(DataFrame, "collect", lambda self: pytest.fail("pairs on the driver"))
        found = partition.partition(sets, sets.select("vt"), 4)
    rows = pd.DataFrame([r.asDict() for r in found.collect()]).sort_values(["cluster", "pos"])
    assert [g["node"].tolist() for _, g in rows.groupby("cluster")] == want
    none = sets.filter("false")
    assert partition.partition(none, none.select("vt"), 4).collect() == []


def star(spark):
    """(nodes, edges, vts, model): a centre with 14 neighbours, some of which are joined to each other."""
    rng = np.random.default_rng(6)
    pairs = [(0, v) for v in range(1, 15)] + [(1, 2), (3, 4), (5, 6), (14, 15)]
    pairs = sorted({p for a, b in pairs for p in ((a, b), (b, a))})
    edges = spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(pairs)], "edge_id long, src long, dst long")
    nodes = spark.createDataFrame([(v, rng.normal(size=2).tolist(), 0) for v in range(16)], "node_id long, x array<double>, y int")
    return nodes, settle(edges), spark.createDataFrame([(0,), (4,), (15,)], "vt long"), models.fixed_model("gcn2", 2, 3, 3)


def every_state(ego, p, shared=None):
    """{cell: (states, smallest size)} of a search that tries every edge of each hop and forgets no cell."""
    cells, hits = {}, 0
    for hop in range(p.hops, 0, -1):
        state, left = ego.start(hop), np.flatnonzero(ego.hop == hop).tolist()
        while left and state.sum() > 1:
            plus0, minus0, _, _ = ego.fidelity(state)
            losses = []
            for e in left:
                tried = state.copy()
                tried[e] = False
                if shared is not None and ego.edge_id[e] in shared:
                    (plus, minus), hits = shared[ego.edge_id[e]], hits + 1
                else:
                    plus, minus, factual, counterfactual = ego.fidelity(tried)
                    if not (factual or counterfactual):
                        continue
                    if shared is not None:
                        shared[ego.edge_id[e]] = plus, minus
                key = tuple(math.floor(math.log(v if v > 0 else 1e-6) / math.log(1 + p.epsilon)) for v in (1 - plus, 1 - minus))
                n, size = cells.get(key, (0, 10**9))
                cells[key] = n + 1, min(size, int(tried.sum()))
                losses.append((round((plus0 - plus + minus0 - minus - 1 / ego.size) / 3, 9), e))
            if not losses:
                break
            best = min(losses, key=lambda x: x[0])[1]
            left.remove(best)
            state[best] = False
    return cells, hits


def by_cell(rows):
    out = {}
    for r in rows:
        n, size = out.get((r.c_plus, r.c_minus), (0, 10**9))
        assert r.n_edges == len(r.edge_ids)
        out[r.c_plus, r.c_minus] = n + r.cnt, min(size, r.n_edges)
    return out


@pytest.mark.parametrize("k", [2, 10])
def test_search_tries_every_edge_and_keeps_every_cell(spark, k):
    """A hop of 28 edges was cut to 8 of them, and cells beyond the k left no trace."""
    nodes, edges, vts, model = star(spark)
    rows = search.skyline(nodes, edges, vts, Params(k=k), model, rest=True).collect()
    e, n = (t.toPandas() for t in search.ego_tables(nodes, edges, vts, Params(), model))
    for v in (0, 4, 15):
        want, _ = every_state(search.Ego(v, e[e["vt"] == v], n[n["vt"] == v].copy(), "gcn2", [(np.eye(3), model[0][1]), model[1]]), Params())
        assert by_cell(r for r in rows if r.vt == v) == want
        assert sum(r.kept for r in rows if r.vt == v) == min(k, len(want))
    assert k == 10 or any(not r.kept for r in rows)
    kept = sorted(r for r in rows if r.kept)
    assert kept == sorted(search.skyline(nodes, edges, vts, Params(k=k), model).collect())


def test_waves_equal_states_one_by_one():
    rng = np.random.default_rng(7)
    layers = models.fixed_model("gcn2", 4, 5, 3)
    for _ in range(60):
        n = int(rng.integers(2, 12))
        pairs = np.array([(a, b) for a in range(n) for b in range(n) if a != b and rng.random() < 0.5] + [(0, 1)])
        src, dst = np.unique(pairs, axis=0).T
        zero = np.zeros(len(src), dtype=int)
        nodes = {"vt": np.zeros(n, dtype=int), "node": np.arange(n), "outside": rng.integers(0, 4, n), "h": rng.normal(size=(n, 5)) * 3}
        egos = dense.Egos(nodes, {"vt": zero, "edge_id": np.arange(len(src)), "src": src, "dst": dst})
        mask = rng.random(len(src)) < 0.7
        for come in (False, True):
            at = np.flatnonzero(mask != come)
            masks = np.tile(mask, (len(at) + 1, 1))
            masks[np.arange(1, len(masks)), at] = come
            want = egos.shares(np.zeros(len(masks), dtype=int), masks.ravel(), come, layers)
            np.testing.assert_allclose(egos.ring(0).shares(mask, at, come, layers), want, atol=1e-12)
    twice = dense.Egos(nodes, {"vt": np.zeros(2, dtype=int), "edge_id": np.arange(2), "src": np.array([1, 1]), "dst": np.array([0, 0])})
    assert not twice.ring(0)


@pytest.mark.parametrize("k", [2, 10])
def test_shared_search_tries_every_edge_and_keeps_every_cell(spark, k):
    """As the search of nodes alone, with the scores of edges handed on from node to node of a cluster."""
    nodes, edges, vts, model = star(spark)
    order = [4, 0, 15]
    clusters = spark.createDataFrame([(0, i, v) for i, v in enumerate(order)], "cluster int, pos long, node long")
    rows = search.skyline_shared(nodes, edges, clusters, Params(k=k), model, rest=True).collect()
    e, n = (t.toPandas() for t in search.ego_tables(nodes, edges, vts, Params(), model))
    shared, hits = {}, 0
    for v in order:
        want, more = every_state(search.Ego(v, e[e["vt"] == v], n[n["vt"] == v].copy(), "gcn2", [(np.eye(3), model[0][1]), model[1]]), Params(), shared)
        hits += more
        assert by_cell(r for r in rows if r.vt == v) == want
        assert sum(r.kept for r in rows if r.vt == v) == min(k, len(want))
    assert {(r.cache_size, r.cache_hits) for r in rows} == {(len(shared), hits)}
    kept = sorted(r for r in rows if r.kept)
    assert kept == sorted(search.skyline_shared(nodes, edges, clusters, Params(k=k), model).collect())
