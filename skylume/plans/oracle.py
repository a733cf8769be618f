"""DuckDB SQL for the graph queries: an independent statement of each result."""

from __future__ import annotations

SEED, K, EPS, WORKERS, HIDDEN, CLASSES, WIDTH = 42, 10, 0.1, 8, 16, 10, 64


def _numbered() -> str:
    return """und AS (SELECT s, d FROM pairs WHERE s <> d UNION SELECT d, s FROM pairs WHERE s <> d),
edges AS (SELECT row_number() OVER (ORDER BY s, d) - 1 AS edge_id, s AS src, d AS dst FROM und),
vts AS (SELECT DISTINCT src AS vt FROM edges)"""


TRADE_PAIRS = """pairs AS (SELECT o_custkey AS s, l_suppkey + 1000000 AS d
  FROM orders JOIN (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem) ON l_orderkey = o_orderkey
  GROUP BY ALL HAVING count(*) >= 3)"""
TRADE = f"{TRADE_PAIRS}, {_numbered()}"
NEAR = f"""emb AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v, label FROM embeddings),
sims AS (SELECT a.id AS s, b.id AS d, row_number() OVER (PARTITION BY a.id ORDER BY list_cosine_similarity(a.v, b.v) DESC, b.id) AS r
  FROM emb a JOIN emb b ON a.id <> b.id),
pairs AS (SELECT s, d FROM sims WHERE r <= 2), {_numbered()}"""


def _khop(hops: int, source: str = "vts") -> str:
    rounds = [f"h0 AS (SELECT vt, vt AS node, 0 AS dist FROM {source})"]
    rounds += [f"h{k} AS (SELECT DISTINCT vt, e.src AS node, {k} AS dist FROM h{k - 1} JOIN edges e ON e.dst = h{k - 1}.node)" for k in range(1, hops + 1)]
    union = " UNION ALL ".join(f"SELECT * FROM h{k}" for k in range(hops + 1))
    return ", ".join(rounds) + f", reach AS (SELECT vt, node, min(dist) AS dist FROM ({union}) GROUP BY ALL)"


EGO = _khop(2) + """, ego AS (SELECT a.vt, e.edge_id, e.src, e.dst FROM reach a JOIN edges e ON e.src = a.node
  JOIN reach b ON b.vt = a.vt AND b.node = e.dst)"""
DIST = """, bothways AS (SELECT vt, src AS a, dst AS b FROM ego UNION SELECT vt, dst, src FROM ego)
, d1 AS (SELECT DISTINCT vt, b AS node FROM bothways WHERE a = vt)
, d2 AS (SELECT DISTINCT d1.vt, w.b AS node FROM d1 JOIN bothways w ON w.vt = d1.vt AND w.a = d1.node)
, dist AS (SELECT vt, node, min(dist)::INTEGER AS dist FROM (SELECT vt, vt AS node, 0 AS dist FROM vts
    UNION ALL SELECT vt, node, 1 FROM d1 UNION ALL SELECT vt, node, 2 FROM d2) GROUP BY ALL)"""
HOPS = EGO + DIST + """, byhop AS (SELECT g.vt, g.edge_id, g.src, g.dst, (least(a.dist, b.dist) + 1)::INTEGER AS hop
  FROM ego g JOIN dist a ON a.vt = g.vt AND a.node = g.src JOIN dist b ON b.vt = g.vt AND b.node = g.dst)"""
MASKS = HOPS + """, present AS (SELECT DISTINCT vt, hop FROM byhop)
, masks AS (SELECT b.vt, m.mask_hop, b.edge_id FROM byhop b, (SELECT unnest([1, 2, 3])::INTEGER AS mask_hop) m
  LEFT JOIN present p ON p.vt = b.vt AND p.hop = m.mask_hop WHERE b.hop <= m.mask_hop OR p.hop IS NULL)"""
FRONTIER = f""", fr0 AS (SELECT vt, edge_id, count(*) OVER (PARTITION BY vt) AS n,
    row_number() OVER (PARTITION BY vt ORDER BY md5('{SEED}|' || vt || '|2|' || edge_id), edge_id) AS r FROM byhop WHERE hop = 2)
, frontier AS (SELECT vt, edge_id AS cand FROM fr0 WHERE n <= 10 OR r <= 8)"""
SETS = _khop(2) + ", sets AS (SELECT vt, node FROM reach WHERE node <> vt)"
JACCARD = SETS + """, sizes AS (SELECT vt, count(*) AS n FROM sets GROUP BY vt)
, inter AS (SELECT a.vt AS i, b.vt AS j, count(*) AS inter FROM sets a JOIN sets b ON a.node = b.node AND a.vt < b.vt GROUP BY ALL)
, jac AS (SELECT i, j, inter, x.n + y.n - inter AS uni, inter::DOUBLE / (x.n + y.n - inter) AS jaccard
  FROM inter JOIN sizes x ON x.vt = i JOIN sizes y ON y.vt = j)"""


def _minhash(perms: int) -> str:
    return f""", sig AS (SELECT vt, perm::INTEGER AS perm, min(('0x' || substr(md5(perm || '|' || node), 1, 15))::BIGINT) AS h
  FROM sets, (SELECT unnest(range({perms})) AS perm) GROUP BY ALL)"""


LSH = SETS + _minhash(32) + """, bands AS (SELECT vt, perm // 4 AS band, string_agg(h::VARCHAR, ',' ORDER BY perm) AS key FROM sig GROUP BY ALL)
, cand AS (SELECT DISTINCT a.vt AS i, b.vt AS j FROM bands a JOIN bands b ON a.band = b.band AND a.key = b.key AND a.vt < b.vt)"""


def _greedy(order_sql: str, conflict_sql: str) -> str:
    """Sequential pass in rank order (v, rank from 1) with the list of taken nodes as state."""
    return f""", ordered AS ({order_sql}), rivals AS ({conflict_sql})
, rival_lists AS (SELECT v, list(u) AS us FROM rivals GROUP BY v)
, pass AS (
  SELECT 0::BIGINT AS rank, []::BIGINT[] AS taken
  UNION ALL
  SELECT o.rank, CASE WHEN r.us IS NOT NULL AND list_has_any(r.us, pass.taken) THEN taken ELSE list_append(taken, o.v) END
  FROM pass JOIN ordered o ON o.rank = pass.rank + 1 LEFT JOIN rival_lists r ON r.v = o.v
), chosen AS (SELECT unnest(taken) AS v FROM (SELECT taken FROM pass ORDER BY rank DESC LIMIT 1))"""


def _core(rounds: int = 14) -> str:
    steps = ["c0 AS (SELECT src AS node, count(*) AS core FROM edges GROUP BY src)"]
    for k in range(rounds):
        steps.append(f"""c{k + 1} AS (SELECT node, max(least(core, r)) AS core FROM (
    SELECT e.src AS node, c.core, row_number() OVER (PARTITION BY e.src ORDER BY c.core DESC) AS r FROM edges e JOIN c{k} c ON c.node = e.dst) GROUP BY node)""")
    return ", ".join(steps) + f", core AS (SELECT * FROM c{rounds})"


# ------------------------------------------------------------------------ networks


def _w(layer: int, i: str = "i", j: str = "j") -> str:
    return f"((({i} * 31 + {j} * 17 + {layer * 7}) % 13 - 6) / 13.0::DOUBLE)"


X = "x AS (SELECT id AS node, i::INTEGER AS j, v[i + 1] AS v FROM emb, (SELECT unnest(range(64)) AS i))"


def _matmul(name: str, src: str, layer: int, n_out: int) -> str:
    return f"{name} AS (SELECT {src}.node, o.j, sum({src}.v * {_w(layer, src + '.j', 'o.j')}) AS v FROM {src}, (SELECT unnest(range({n_out}))::INTEGER AS j) o GROUP BY ALL)"


NORM = """deg AS (SELECT id AS node, count(e.src) + 1.0::DOUBLE AS d FROM emb LEFT JOIN edges e ON e.dst = emb.id GROUP BY id),
norm AS (SELECT l.src, l.dst, 1.0 / sqrt(a.d * b.d) AS w FROM (SELECT src, dst FROM edges UNION ALL SELECT id, id FROM emb) l
  JOIN deg a ON a.node = l.src JOIN deg b ON b.node = l.dst)"""


def _softmax(src: str) -> str:
    return f"""tops AS (SELECT node, max(v) AS m FROM {src} GROUP BY node),
powers AS (SELECT {src}.node, j, exp(v - m) AS e FROM {src} JOIN tops USING (node))
SELECT node, j::INTEGER AS class, round(e / sum(e) OVER (PARTITION BY node), 6) AS p FROM powers"""


def _gcn_sql(depth: int) -> str:
    sizes = [*[HIDDEN] * (depth - 1), CLASSES]
    parts, src = [X, NORM], "x"
    for k, n in enumerate(sizes):
        parts.append(_matmul(f"z{k}", src, k, n))
        last = k + 1 == depth
        value = "sum(w * v)" if last else "greatest(sum(w * v), 0)"
        parts.append(f"a{k} AS (SELECT norm.dst AS node, j, {value} AS v FROM norm JOIN z{k} ON z{k}.node = norm.src GROUP BY ALL)")
        src = f"a{k}"
    return f"WITH {NEAR}, " + ", ".join(parts) + ", " + _softmax(src)


def _sage_sql() -> str:
    parts, src = [X, "indeg AS (SELECT dst AS node, count(*) AS d FROM edges GROUP BY dst)"], "x"
    for k, n in enumerate([HIDDEN, HIDDEN, CLASSES]):
        parts.append(f"m{k} AS (SELECT e.dst AS node, j, avg(v) AS v FROM edges e JOIN {src} s ON s.node = e.src GROUP BY ALL)")
        parts += [_matmul(f"p{k}", f"m{k}", 2 * k, n), _matmul(f"q{k}", src, 2 * k + 1, n)]
        total = f"coalesce(p{k}.v, 0) + q{k}.v"
        parts.append(f"a{k} AS (SELECT q{k}.node, q{k}.j, {total if k == 2 else f'greatest({total}, 0)'} AS v FROM q{k} LEFT JOIN p{k} ON p{k}.node = q{k}.node AND p{k}.j = q{k}.j)")
        src = f"a{k}"
    return f"WITH {NEAR}, " + ", ".join(parts) + ", " + _softmax(src)


def _gin_sql() -> str:
    parts, src = [X], "x"
    for k in range(3):
        parts.append(f"n{k} AS (SELECT e.dst AS node, j, sum(v) AS v FROM edges e JOIN {src} s ON s.node = e.src GROUP BY ALL)")
        parts.append(f"t{k} AS (SELECT s.node, s.j, s.v * (1 + 0.1 * {k}) + coalesce(n{k}.v, 0) AS v FROM {src} s LEFT JOIN n{k} ON n{k}.node = s.node AND n{k}.j = s.j)")
        parts += [_matmul(f"u{k}0", f"t{k}", 2 * k, HIDDEN), f"u{k} AS (SELECT node, j, greatest(v, 0) AS v FROM u{k}0)"]
        parts += [_matmul(f"a{k}0", f"u{k}", 2 * k + 1, HIDDEN), f"a{k} AS (SELECT node, j, greatest(v, 0) AS v FROM a{k}0)"]
        src = f"a{k}"
    parts.append(_matmul("o", src, 6, CLASSES))
    return f"WITH {NEAR}, " + ", ".join(parts) + ", " + _softmax("o")


def _gat_sql() -> str:
    parts, src = [X, "links AS (SELECT src, dst FROM edges WHERE src <> dst UNION ALL SELECT id, id FROM emb)"], "x"
    for k, (heads, width) in enumerate([(8, 2), (8, 2), (1, CLASSES)]):
        parts.append(_matmul(f"z{k}", src, k, heads * width))
        parts.append(f"s{k} AS (SELECT node, j // {width} AS head, sum(v * {_w(3 + k, f'(j // {width})', f'(j % {width})')}) AS s, sum(v * {_w(6 + k, f'(j // {width})', f'(j % {width})')}) AS t FROM z{k} GROUP BY ALL)")
        parts.append(f"""e{k} AS (SELECT l.src, l.dst, a.head, CASE WHEN a.s + b.t > 0 THEN a.s + b.t ELSE 0.2 * (a.s + b.t) END AS e
  FROM links l JOIN s{k} a ON a.node = l.src JOIN s{k} b ON b.node = l.dst AND b.head = a.head)""")
        parts.append(f"w{k} AS (SELECT src, dst, head, exp(e - max(e) OVER (PARTITION BY dst, head)) AS p FROM e{k})")
        value = "sum(p * v) / sum(p)"
        parts.append(f"b{k} AS (SELECT dst AS node, j, {value} AS v FROM w{k} JOIN z{k} ON z{k}.node = w{k}.src AND z{k}.j // {width} = w{k}.head GROUP BY ALL)")
        parts.append(f"a{k} AS (SELECT node, j, {'v' if k == 2 else 'CASE WHEN v > 0 THEN v ELSE exp(v) - 1 END AS v'} FROM b{k})")
        src = f"a{k}"
    return f"WITH {NEAR}, " + ", ".join(parts) + ", " + _softmax(src)


# ------------------------------------------------------------------ the scoring wave


def _keyed(p: str, members: str, links: str) -> str:
    """Shares of vt's classes ({p}p: vt, cand, j, p) of the two-layer network per instance."""
    return f"""
, {p}d AS (SELECT m.vt, m.cand, m.node, any_value(m.outside) + count(e.src) + 1.0::DOUBLE AS d FROM {members} m
  LEFT JOIN {links} e ON e.vt = m.vt AND e.cand = m.cand AND e.dst = m.node GROUP BY ALL)
, {p}w AS (SELECT l.vt, l.cand, l.src, l.dst, 1.0 / sqrt(a.d * b.d) AS w
  FROM (SELECT vt, cand, src, dst FROM {links} UNION ALL SELECT vt, cand, node, node FROM {members}) l
  JOIN {p}d a ON a.vt = l.vt AND a.cand = l.cand AND a.node = l.src JOIN {p}d b ON b.vt = l.vt AND b.cand = l.cand AND b.node = l.dst)
, {p}h AS (SELECT w.vt, w.cand, w.dst AS node, j, greatest(sum(w.w * v), 0) AS v FROM {p}w w JOIN xw ON xw.node = w.src GROUP BY ALL)
, {p}z AS (SELECT h.vt, h.cand, h.node, o.j, sum(h.v * {_w(1, 'h.j', 'o.j')}) AS v FROM {p}h h, (SELECT unnest(range({CLASSES}))::INTEGER AS j) o GROUP BY ALL)
, {p}o AS (SELECT w.vt, w.cand, j, sum(w.w * v) AS v FROM {p}w w JOIN {p}z z ON z.vt = w.vt AND z.cand = w.cand AND z.node = w.src WHERE w.dst = w.vt GROUP BY ALL)
, {p}e AS (SELECT vt, cand, j, exp(v - max(v) OVER (PARTITION BY vt, cand)) AS e FROM {p}o)
, {p}p AS (SELECT vt, cand, j, e / sum(e) OVER (PARTITION BY vt, cand) AS p FROM {p}e)
, {p}l AS (SELECT vt, cand, arg_max(j, p) AS label, max(p) AS top FROM {p}p GROUP BY ALL)"""


WAVE_STATES = f"""WITH {NEAR}, {MASKS}{FRONTIER}
, start AS (SELECT m.vt, m.edge_id, g.src, g.dst FROM masks m JOIN ego g ON g.vt = m.vt AND g.edge_id = m.edge_id WHERE m.mask_hop = 2)
, big AS (SELECT vt FROM start GROUP BY vt HAVING count(*) > 1)
, moves AS (SELECT vt, cand FROM frontier WHERE vt IN (SELECT vt FROM big)
  UNION ALL SELECT DISTINCT vt, -1 FROM frontier WHERE vt IN (SELECT vt FROM big))
, states AS (SELECT s.vt, m.cand, s.edge_id, s.src, s.dst FROM start s JOIN moves m ON m.vt = s.vt WHERE s.edge_id <> m.cand)"""
EGO_PRED = f""", {X}, {_matmul('xw', 'x', 0, HIDDEN)}
, egom AS (SELECT vt, -1 AS cand, node, 0 AS outside FROM reach), egol AS (SELECT vt, -1 AS cand, src, dst FROM ego){_keyed('g', 'egom', 'egol')}"""
WAVE = WAVE_STATES + EGO_PRED + f"""
, inst AS (SELECT vt, cand, count(*) AS n_edges FROM states GROUP BY ALL)
, fulldeg AS (SELECT dst AS node, count(*) AS n FROM edges GROUP BY dst)
, inner_deg AS (SELECT vt, dst AS node, count(*) AS n FROM ego GROUP BY ALL)
, subm AS (SELECT i.vt, i.cand, r.node, 0 AS outside FROM inst i JOIN reach r ON r.vt = i.vt)
, compm AS (SELECT i.vt, i.cand, r.node, coalesce(f.n, 0) - coalesce(k.n, 0) AS outside FROM inst i JOIN reach r ON r.vt = i.vt
  LEFT JOIN fulldeg f ON f.node = r.node LEFT JOIN inner_deg k ON k.vt = r.vt AND k.node = r.node)
, compl AS (SELECT i.vt, i.cand, g.edge_id, g.src, g.dst FROM inst i JOIN ego g ON g.vt = i.vt
  LEFT JOIN states s ON s.vt = i.vt AND s.cand = i.cand AND s.edge_id = g.edge_id WHERE s.edge_id IS NULL)
{_keyed('s', 'subm', 'states')}{_keyed('c', 'compm', 'compl')}
, scored AS (SELECT i.vt, i.cand, i.n_edges, sp.p AS p_sub, cp.p AS p_comp, gl.top - cp.p AS fid_plus, sp.p - gl.top + 1 AS fid_minus,
    sl.label = gl.label AS factual, cl.label <> gl.label AS counterfactual
  FROM inst i JOIN gl ON gl.vt = i.vt
  JOIN sp ON sp.vt = i.vt AND sp.cand = i.cand AND sp.j = gl.label JOIN cp ON cp.vt = i.vt AND cp.cand = i.cand AND cp.j = gl.label
  JOIN sl ON sl.vt = i.vt AND sl.cand = i.cand JOIN cl ON cl.vt = i.vt AND cl.cand = i.cand)
, subg AS (SELECT vt, count(*) AS subg_size FROM ego GROUP BY vt)
, ranked0 AS (SELECT s.*, g.subg_size, round((b.fid_plus - s.fid_plus + b.fid_minus - s.fid_minus - 1.0 / g.subg_size) / 3, 9) AS t,
    1 - s.fid_plus AS p_plus, 1 - s.fid_minus AS p_minus, ln(s.n_edges) / ln(g.subg_size) AS p_size
  FROM scored s JOIN scored b ON b.vt = s.vt AND b.cand = -1 JOIN subg g ON g.vt = s.vt WHERE s.cand >= 0 AND (s.factual OR s.counterfactual))
, ranked AS (SELECT *, floor(ln(CASE WHEN p_plus <= 0 THEN 1e-6 ELSE p_plus END) / ln(1.1))::INTEGER AS c_plus,
    floor(ln(CASE WHEN p_minus <= 0 THEN 1e-6 ELSE p_minus END) / ln(1.1))::INTEGER AS c_minus FROM ranked0)
, best AS (SELECT vt, arg_min(cand, (t, cand)) AS cand FROM ranked GROUP BY vt)
, heads AS (SELECT vt, c_plus, c_minus, count(*) AS cnt, min((n_edges, cand))[1] AS n_edges, min((n_edges, cand))[2] AS cand FROM ranked GROUP BY vt, c_plus, c_minus)
, ipfs AS (SELECT vt, avg((fid_plus + fid_minus + 1 - p_size) / 3) AS ipf FROM heads JOIN ranked USING (vt, cand) GROUP BY vt)"""


def _r(expression: str, name: str) -> str:
    return f"round({expression}, 6) + 0.0 AS {name}"


def _wave(select: str) -> str:
    return f"{WAVE}\n{select}"


def oracle_sql() -> dict[str, str]:
    trade, near = f"WITH {TRADE}, ", f"WITH {NEAR}, "
    near_rec = f"WITH RECURSIVE {NEAR}, "
    out = {
        "split_positional": """SELECT vec_id AS node_id, CASE WHEN vec_id < floor(0.6 * n) THEN 'train' WHEN vec_id >= n - 1 THEN 'test' ELSE 'val' END AS split
FROM embeddings, (SELECT count(*) AS n FROM embeddings)""",
        "split_stratified": f"""WITH r AS (SELECT vec_id AS id, row_number() OVER (PARTITION BY label ORDER BY md5('{SEED}|' || vec_id), vec_id) <= 10 AS train FROM embeddings),
t AS (SELECT id FROM r WHERE NOT train ORDER BY md5('{SEED}|test|' || id), id LIMIT 20)
SELECT id AS node_id, CASE WHEN train THEN 'train' WHEN id IN (SELECT id FROM t) THEN 'test' ELSE 'none' END AS split FROM r""",
        "drop_self_loops": "SELECT DISTINCT user_id AS src, event_id % 97 AS dst FROM events WHERE user_id <> event_id % 97",
        "symmetrize": f"WITH {TRADE} SELECT s AS src, d AS dst FROM und",
        "ego_reload": """SELECT vec_id AS vt, CASE WHEN vec_id % 3 = 0 THEN vec_id * 5 ELSE vec_id * 2 END AS subg_size,
  CASE WHEN vec_id % 3 = 0 THEN 1 ELSE 0 END AS batch FROM embeddings""",
        "has_edge": f"WITH {TRADE} SELECT c_custkey AS vt FROM customer WHERE c_custkey IN (SELECT src FROM edges UNION SELECT dst FROM edges)",
        "khop_nodes": trade + _khop(2) + " SELECT * FROM reach",
        "khop_edges": trade + EGO + " SELECT * FROM ego",
        "lhop_nbrs": trade + SETS + " SELECT * FROM sets",
        "lhop_sets": trade + SETS + " SELECT vt, string_agg(node::VARCHAR, ',' ORDER BY node) AS members FROM sets GROUP BY vt",
        "lhop_sizes": trade + _khop(2) + " SELECT vt, count(*) AS n FROM reach GROUP BY vt",
        "bfs_dist": near + _khop(5) + " SELECT * FROM reach",
        "hop_dist": trade + EGO + DIST + " SELECT * FROM dist",
        "edges_by_hop": trade + HOPS + " SELECT * FROM byhop",
        "hop_masks": trade + MASKS + " SELECT * FROM masks",
        "ego_record": near + HOPS + """ SELECT vt, count(*) AS subg_size, """ + ", ".join(f"coalesce(string_agg(edge_id::VARCHAR, ',' ORDER BY edge_id) FILTER (hop = {h}), '') AS hop{h}" for h in (1, 2, 3)) + " FROM byhop GROUP BY vt",
        "degree_rank": f"WITH {TRADE} SELECT src AS node, count(*) AS degree, row_number() OVER (ORDER BY count(*) DESC, src) AS rank FROM edges GROUP BY src",
        "induced": f"WITH {TRADE} SELECT (src % 4)::INTEGER AS cluster, edge_id, src, dst FROM edges WHERE src % 4 = dst % 4",
        "core_number": trade + _core() + " SELECT * FROM core",
        "core_rank": trade + _core() + """ SELECT (node % 4)::INTEGER AS cluster, node, core, row_number() OVER (PARTITION BY node % 4 ORDER BY core DESC, node) AS pos FROM core""",
        "cluster_order": f"WITH {TRADE.replace('edges AS', 'all_edges AS').replace('FROM edges)', 'FROM all_edges)')}, edges AS (SELECT * FROM all_edges WHERE src % 2 = dst % 2), " + _core() + """
SELECT (vt % 2)::INTEGER AS cluster, vt AS node, coalesce(core, 0) AS core, row_number() OVER (PARTITION BY vt % 2 ORDER BY coalesce(core, 0) DESC, vt) AS pos
FROM vts LEFT JOIN core ON core.node = vts.vt""",
        "mask_semi": f"WITH {TRADE} SELECT * FROM edges WHERE md5('{SEED}|' || edge_id) < '8'",
        "mask_anti": f"WITH {TRADE} SELECT * FROM edges WHERE NOT md5('{SEED}|' || edge_id) < '8'",
        "chunk_round": f"SELECT (ntile({WORKERS}) OVER (ORDER BY md5('{SEED}|' || vec_id), vec_id) - 1)::INTEGER AS cluster, vec_id AS node FROM embeddings",
        "chunk_fixed": "SELECT (row_number() OVER (ORDER BY vec_id) - 1) // 100 AS chunk, vec_id AS vt FROM embeddings",
        "frontier_sample": trade + HOPS + FRONTIER + " SELECT * FROM frontier",
        "seed_conflicts": near + _khop(3) + " SELECT vt AS u, node AS v FROM reach WHERE dist > 0",
        "select_seeds": near_rec + _khop(5) + _greedy("SELECT src AS v, row_number() OVER (ORDER BY count(*) DESC, src) AS rank FROM edges GROUP BY src", "SELECT vt AS u, node AS v FROM reach WHERE dist > 0")
        + f" SELECT v AS node, rank FROM chosen JOIN ordered USING (v) ORDER BY rank LIMIT {WORKERS}",
        "pair_jaccard": near + JACCARD + f" SELECT i, j, inter, uni, {_r('jaccard', 'jaccard')} FROM jac",
        "pair_distance": near + JACCARD + f" SELECT i, j, {_r('1 - jaccard', 'distance')} FROM jac",
        "sim_graph": near + JACCARD + f" SELECT i, j, {_r('jaccard', 'jaccard')} FROM jac WHERE jaccard >= 0.3",
        "minhash_sig": near + SETS + _minhash(16) + " SELECT * FROM sig",
        "lsh_candidates": near + LSH + " SELECT * FROM cand",
        "lsh_clusters": near_rec + LSH + _greedy("SELECT vt AS v, row_number() OVER (ORDER BY vt) AS rank FROM vts", "SELECT i AS u, j AS v FROM cand UNION SELECT j, i FROM cand")
        + " SELECT vt, CASE WHEN vt IN (SELECT v FROM chosen) THEN vt ELSE (SELECT min(u) FROM rivals WHERE v = vt AND u IN (SELECT v FROM chosen)) END AS leader FROM vts",
        "balance_split": near_rec + LSH + _greedy("SELECT vt AS v, row_number() OVER (ORDER BY vt) AS rank FROM vts", "SELECT i AS u, j AS v FROM cand UNION SELECT j, i FROM cand")
        + f""", led AS (SELECT vt, CASE WHEN vt IN (SELECT v FROM chosen) THEN vt ELSE (SELECT min(u) FROM rivals WHERE v = vt AND u IN (SELECT v FROM chosen)) END AS leader FROM vts)
, goal AS (SELECT count(*) // {WORKERS} AS target FROM vts)
SELECT leader, vt, CASE WHEN count(*) OVER (PARTITION BY leader) > floor(1.1 * target) THEN (row_number() OVER (PARTITION BY leader ORDER BY vt) - 1) // target ELSE 0 END AS chunk FROM led, goal""",
        "gcn_norm": near + NORM + f" SELECT src, dst, {_r('w', 'w')} FROM norm",
        "softmax": """WITH x AS (SELECT vec_id AS node_id, k::INTEGER AS k, embedding[k + 1]::DOUBLE AS v FROM embeddings, (SELECT unnest(range(64)) AS k)),
e AS (SELECT node_id, k, exp(v - max(v) OVER (PARTITION BY node_id)) AS e FROM x)
SELECT node_id, k, round(e / sum(e) OVER (PARTITION BY node_id), 6) + 0.0 AS p FROM e""",
        "activations": """WITH x AS (SELECT vec_id AS node_id, k::INTEGER AS k, embedding[k + 1]::DOUBLE AS v FROM embeddings, (SELECT unnest(range(64)) AS k)),
m AS (SELECT *, max(v) OVER (PARTITION BY node_id) AS m FROM x)
SELECT node_id, k, round(greatest(v, 0), 6) + 0.0 AS relu, round(CASE WHEN v > 0 THEN v ELSE exp(v) - 1 END, 6) + 0.0 AS elu,
  round(v - m - ln(sum(exp(v - m)) OVER (PARTITION BY node_id)), 6) + 0.0 AS log_softmax FROM m""",
        "gcn1_forward": _gcn_sql(1),
        "gcn2_forward": _gcn_sql(2),
        "gcn3_forward": _gcn_sql(3),
        "gcn4_forward": _gcn_sql(4),
        "sage_forward": _sage_sql(),
        "gin_forward": _gin_sql(),
        "gat_forward": _gat_sql(),
        "candidates": WAVE_STATES + " SELECT vt, cand, count(*) AS n_edges FROM states GROUP BY ALL",
        "pred_ego": f"WITH {NEAR}, {EGO}{EGO_PRED} SELECT vt, label, {_r('top', 'p0')} FROM gl",
        "pred_sub": _wave(f"SELECT vt, cand, {_r('p_sub', 'p_sub')}, factual FROM scored"),
        "pred_comp": _wave(f"SELECT vt, cand, {_r('p_comp', 'p_comp')}, counterfactual FROM scored"),
        "fidelity": _wave(f"SELECT vt, cand, n_edges, {_r('fid_plus', 'fid_plus')}, {_r('fid_minus', 'fid_minus')}, factual, counterfactual FROM scored"),
        "verify": _wave("SELECT vt, cand, factual, counterfactual FROM scored WHERE cand >= 0 AND (factual OR counterfactual)"),
        "marginal": _wave(f"SELECT vt, cand, {_r('t', 't')} FROM ranked"),
        "position": _wave(f"SELECT vt, cand, {_r('p_plus', 'p_plus')}, {_r('p_minus', 'p_minus')}, {_r('p_size', 'p_size')} FROM ranked"),
        "grid_cell": _wave("SELECT vt, cand, c_plus, c_minus FROM ranked"),
        "argmin_edge": _wave("SELECT vt, cand FROM best"),
        "greedy_step": _wave("SELECT s.vt, s.edge_id FROM states s JOIN best b ON b.vt = s.vt AND b.cand = s.cand"),
        "skyline_heads": _wave("SELECT * FROM heads"),
        "pareto": _wave(""", flat AS (SELECT vt, cand, round(p_plus, 9) AS p_plus, round(p_minus, 9) AS p_minus, round(p_size, 9) AS p_size FROM ranked)
SELECT vt, cand FROM flat a WHERE NOT EXISTS (SELECT 1 FROM flat b WHERE b.vt = a.vt
  AND b.p_plus <= a.p_plus AND b.p_minus <= a.p_minus AND b.p_size <= a.p_size
  AND (b.p_plus < a.p_plus OR b.p_minus < a.p_minus OR b.p_size < a.p_size))"""),
        "ipf": _wave(f"SELECT vt, {_r('ipf', 'ipf')} FROM ipfs"),
        "ipf_workers": _wave(f"SELECT {_r('avg(m)', 'ipf')} FROM (SELECT avg(round(ipf, 6)) AS m FROM ipfs GROUP BY vt % {WORKERS})"),
    }
    return out
