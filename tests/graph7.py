"""A graph of seven nodes with known answers."""

from __future__ import annotations

UNDIRECTED = ["01", "02", "12", "13", "24", "34", "35", "46", "56"]
EDGES = sorted([(int(a), int(b)) for a, b in UNDIRECTED] + [(int(b), int(a)) for a, b in UNDIRECTED])
X = [[1, 0], [1, 0], [0, 1], [1, 1], [0, 1], [1, 0], [0, 1]]
LAYERS = [([[1.0, -1.0], [-1.0, 1.0]], [0.0, 0.0]), ([[2.0, -1.0], [-1.0, 2.0]], [0.0, 0.0])]
#: vt: (ego nodes, edges by hop)
EGOS = {
    0: ([0, 1, 2, 3, 4], {1: [0, 1, 2, 5], 2: [3, 4, 6, 7, 8, 11], 3: [9, 12]}),
    1: ([0, 1, 2, 3, 4, 5], {1: [0, 2, 3, 4, 6, 8], 2: [1, 5, 7, 9, 10, 11, 12, 14]}),
    2: ([0, 1, 2, 3, 4, 6], {1: [1, 3, 5, 6, 7, 11], 2: [0, 2, 4, 8, 9, 12, 13, 16]}),
    3: ([0, 1, 2, 3, 4, 5, 6], {1: [4, 8, 9, 10, 12, 14], 2: [0, 2, 3, 6, 7, 11, 13, 15, 16, 17], 3: [1, 5]}),
    4: ([0, 1, 2, 3, 4, 5, 6], {1: [7, 9, 11, 12, 13, 16], 2: [1, 3, 4, 5, 6, 8, 10, 14, 15, 17], 3: [0, 2]}),
    5: ([1, 3, 4, 5, 6], {1: [10, 14, 15, 17], 2: [4, 8, 9, 12, 13, 16]}),
    6: ([2, 3, 4, 5, 6], {1: [13, 15, 16, 17], 2: [7, 9, 10, 11, 12, 14]}),
}


def tables(spark):
    edges = spark.createDataFrame([(i, s, d) for i, (s, d) in enumerate(EDGES)], "edge_id long, src long, dst long")
    nodes = spark.createDataFrame([(i, [float(v) for v in x], i % 2) for i, x in enumerate(X)], "node_id long, x array<double>, y int")
    vts = spark.createDataFrame([(i,) for i in range(7)], "vt long")
    return nodes, edges, vts
