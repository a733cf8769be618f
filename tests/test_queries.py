"""Queries against their SQL on the smallest tables."""

import math

import duckdb
import pytest

from skylume.plans import oracle, queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events embeddings".split()
KEYS = """split_stratified khop_edges hop_masks ego_record degree_rank core_number cluster_order mask_anti chunk_round
frontier_sample select_seeds pair_jaccard lsh_clusters gcn2_forward sage_forward fidelity skyline_heads pareto ipf_workers""".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def flat(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    fix = lambda v: (round(v, 6) + 0.0 if math.isfinite(v) else None) if isinstance(v, float) else v
    return [names[i] for i in order], sorted((tuple(fix(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("key", KEYS)
def test_query_equals_sql(spark, duck, key):
    got = queries.queries()[key](spark, SF)
    want = duck.execute(oracle.oracle_sql()[key])
    names = [d[0] for d in want.description]
    assert flat(got.columns, got.collect()) == flat(names, want.fetchall())


def test_entry_points(spark):
    import __spark_entry__ as e

    assert set(oracle.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).limit(1).count() == 1


@pytest.mark.parametrize("key,node", [("skyline_share", "vt"), ("skyline_share_cluster", "vt"), ("cluster_exact", "node"), ("balance_lsh", "node"), ("split_bucket", "node")])
def test_whole_table_no_subset(spark, key, node):
    """Every node of the nearest-neighbour graph is searched, clustered or split."""
    every = {r.src for r in queries._near(spark, SF)[1].select("src").collect()}
    assert {r[0] for r in queries.queries()[key](spark, SF).select(node).collect()} == every and len(every) == 500
