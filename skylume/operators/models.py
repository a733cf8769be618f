"""Graph networks as joins and aggregations: each layer is one join on edges and one sum.

Layers take and give (keys..., node, h) with h an array of doubles.  ``keys`` name the
instance (say, vt and candidate) so that many small graphs go through one plan; the
empty list is one graph.  Weights are small and live in the plan as literals.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skylume.functions.measures import elu, relu
from skylume.session import settle

Matrix = list[list[float]]
#: Dense layer: weights and bias.
Layer = tuple[Matrix, list[float]]


def fixed_layer(layer: int, n_in: int, n_out: int) -> Layer:
    """Weights by formula, for checks without training: ((31 i + 17 j + 7 layer) mod 13 - 6) / 13."""
    return [[((i * 31 + j * 17 + layer * 7) % 13 - 6) / 13.0 for j in range(n_out)] for i in range(n_in)], [0.0] * n_out


def dense(h: Column, layer: Layer) -> Column:
    """h W + b; the matrix folds to one literal, column by column.  ``h`` is bound, so it is computed once, not for each column."""
    weights, bias = layer
    columns = F.array(*[F.array(*[F.lit(float(row[j])) for row in weights]) for j in range(len(bias))])
    dot = lambda v: lambda col: F.aggregate(F.zip_with(v, col, lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
    whole = lambda v: F.zip_with(F.transform(columns, dot(v)), F.array(*[F.lit(float(b)) for b in bias]), lambda a, b: a + b)
    return F.transform(F.array(h), whole)[0]


def project(nodes: DataFrame, layer: Layer) -> DataFrame:
    """(node, h) with h = x W, without bias: once for the whole table."""
    weights, bias = layer
    return nodes.select(F.col("node_id").alias("node"), dense(F.col("x"), (weights, [0.0] * len(bias))).alias("h"))


def sum_neighbours(h: DataFrame, edges: DataFrame, width: int, keys: list[str], weight: str | None = None) -> DataFrame:
    """(keys, node, h): weighted sum over incoming edges; nodes without any do not appear."""
    near = edges.join(h.withColumnRenamed("node", "src"), [*keys, "src"])
    term = (lambda j: F.col("h")[j] * F.col(weight)) if weight else (lambda j: F.col("h")[j])
    sums = near.groupBy(*keys, F.col("dst").alias("node")).agg(*[F.sum(term(j)).alias(f"s{j}") for j in range(width)])
    return sums.select(*keys, "node", F.array(*[F.col(f"s{j}") for j in range(width)]).alias("h"))


def gcn_norm(members: DataFrame, edges: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, src, dst, w): edges and self loops with the symmetric degree correction.

    ``members`` is (keys, node) with, optionally, ``outside``: in-edges not in ``edges``.
    """
    inside = edges.groupBy(*keys, F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("n"))
    outside = F.col("outside") if "outside" in members.columns else F.lit(0)
    degree = members.join(inside, [*keys, "node"], "left").select(*keys, "node", (F.coalesce("n", F.lit(0)) + outside + 1).cast("double").alias("d"))
    loops = members.select(*keys, F.col("node").alias("src"), F.col("node").alias("dst"))
    both = edges.select(*keys, "src", "dst").unionByName(loops)
    both = both.join(degree.select(*keys, F.col("node").alias("src"), F.col("d").alias("d1")), [*keys, "src"])
    both = both.join(degree.select(*keys, F.col("node").alias("dst"), F.col("d").alias("d2")), [*keys, "dst"])
    return both.select(*keys, "src", "dst", (1.0 / F.sqrt(F.col("d1") * F.col("d2"))).alias("w"))


def gcn(members: DataFrame, edges: DataFrame, first: DataFrame, layers: list[Layer], keys: list[str] | None = None) -> DataFrame:
    """(keys, node, h): raw outputs.  ``first`` is (node, h) after the first projection."""
    keys = keys or []
    norm = gcn_norm(members, edges, keys)
    h = members.select(*keys, "node").join(first, "node")
    for k, (weights, bias) in enumerate(layers):
        if k:
            h = h.withColumn("h", dense(relu(F.col("h")), (weights, [0.0] * len(bias))))
        h = sum_neighbours(h, norm, len(bias), keys, "w")
        h = h.withColumn("h", F.zip_with("h", F.array(*[F.lit(float(b)) for b in bias]), lambda a, b: a + b))
    return h


def _all(nodes: DataFrame) -> DataFrame:
    return nodes.select(F.col("node_id").alias("node"), F.col("x").alias("h"))


def _with_zeros(h: DataFrame, sums: DataFrame, width: int) -> DataFrame:
    """(node, h, near): sums of the neighbours, zeros for nodes without any."""
    zeros = F.array(*[F.lit(0.0)] * width)
    return h.join(sums.withColumnRenamed("h", "near"), "node", "left").withColumn("near", F.coalesce("near", zeros))


def gin(nodes: DataFrame, edges: DataFrame, blocks: list[tuple[Layer, Layer, float]], last: Layer) -> DataFrame:
    """Sum aggregation, two-layer perceptron, affine normalisation folded into the second layer."""
    h = _all(nodes)
    for one, two, eps in blocks:
        n = len(one[0])
        mixed = _with_zeros(h, sum_neighbours(h, edges, n, []), n)
        total = F.zip_with("h", "near", lambda a, b: a * (1.0 + eps) + b)
        h = mixed.select("node", relu(relu(dense(relu(dense(total, one)), two))).alias("h"))
    return h.select("node", dense(F.col("h"), last).alias("h"))


def sage(nodes: DataFrame, edges: DataFrame, layers: list[tuple[Layer, Layer]]) -> DataFrame:
    """Mean of neighbours and the node itself, each with weights of its own."""
    h = _all(nodes)
    degree = edges.groupBy(F.col("dst").alias("node")).agg(F.count(F.lit(1)).cast("double").alias("d"))
    for k, (near_layer, own_layer) in enumerate(layers):
        n = len(near_layer[0])
        mixed = _with_zeros(h, sum_neighbours(h, edges, n, []), n).join(degree, "node", "left")
        mean = F.transform("near", lambda v: v / F.coalesce(F.col("d"), F.lit(1.0)))
        out = F.zip_with(dense(mean, near_layer), dense(F.col("h"), own_layer), lambda a, b: a + b)
        h = mixed.select("node", (relu(out) if k + 1 < len(layers) else out).alias("h"))
    return h


def gat(nodes: DataFrame, edges: DataFrame, layers: list[tuple[Layer, Matrix, Matrix]], slope: float = 0.2) -> DataFrame:
    """Attention layers; each is a projection to heads * width and two vectors a head.

    A node attends to its in-neighbours and itself; shares are softmax over (node, head).
    """
    h = _all(nodes)
    loops = nodes.select(F.col("node_id").alias("src"), F.col("node_id").alias("dst"))
    both = edges.filter("src <> dst").select("src", "dst").unionByName(loops)
    for k, (layer, from_src, from_dst) in enumerate(layers):
        heads, width = len(from_src), len(from_src[0])
        z = h.select("node", dense(F.col("h"), (layer[0], [0.0] * len(layer[1]))).alias("z"))
        part = lambda i: F.slice("z", i * width + 1, width)  # noqa: E731, B023
        score = lambda vec, i: F.aggregate(F.zip_with(part(i), F.array(*[F.lit(float(v)) for v in vec[i]]), lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)  # noqa: E731, B023
        z = z.withColumn("s", F.array(*[score(from_src, i) for i in range(heads)])).withColumn("t", F.array(*[score(from_dst, i) for i in range(heads)]))
        z = settle(z)  # read four times below, which would run all layers before as often
        pairs = both.join(z.select(F.col("node").alias("src"), "z", "s"), "src").join(z.select(F.col("node").alias("dst"), "t"), "dst")
        bent = F.zip_with("s", "t", lambda a, b: F.when(a + b > 0, a + b).otherwise((a + b) * slope))
        pairs = pairs.withColumn("e", bent)
        top = pairs.groupBy("dst").agg(*[F.max(F.col("e")[i]).alias(f"m{i}") for i in range(heads)])
        pairs = pairs.join(top, "dst")
        power = lambda i: F.exp(F.col("e")[i] - F.col(f"m{i}"))
        sums = [F.sum(power(i)).alias(f"d{i}") for i in range(heads)]
        sums += [F.sum(power(i) * F.col("z")[i * width + j]).alias(f"n{i}_{j}") for i in range(heads) for j in range(width)]
        out = pairs.groupBy(F.col("dst").alias("node")).agg(*sums)
        values = [F.col(f"n{i}_{j}") / F.col(f"d{i}") + F.lit(float(layer[1][i * width + j])) for i in range(heads) for j in range(width)]
        h = out.select("node", F.array(*values).alias("h"))
        if k + 1 < len(layers):
            h = h.withColumn("h", elu(F.col("h")))
    return h


# ---------------------------------------------------------------------- models by name

DEPTH = {"gcn1": 1, "gcn2": 2, "gcn": 3, "gcn4": 4, "gat": 3, "gin": 3, "sage": 3}


def fixed_model(name: str, n_in: int, hidden: int, n_out: int, heads: int = 8):
    """Parameters of a named architecture by the fixed formula; an unknown name is an error."""
    if name not in DEPTH:
        raise ValueError(f"unknown model {name!r}; known: {sorted(DEPTH)}")
    depth = DEPTH[name]
    if name.startswith("gcn"):
        sizes = [n_in, *[hidden] * (depth - 1), n_out]
        return [fixed_layer(k, sizes[k], sizes[k + 1]) for k in range(depth)]
    if name == "sage":
        sizes = [n_in, hidden, hidden, n_out]
        return [(fixed_layer(2 * k, sizes[k], sizes[k + 1]), fixed_layer(2 * k + 1, sizes[k], sizes[k + 1])) for k in range(3)]
    if name == "gin":
        sizes = [n_in, hidden, hidden]
        return [(fixed_layer(2 * k, sizes[k], hidden), fixed_layer(2 * k + 1, hidden, hidden), 0.1 * k) for k in range(3)], fixed_layer(6, hidden, n_out)
    sizes, wide = [n_in, hidden * heads, hidden * heads], [(heads, hidden), (heads, hidden), (1, n_out)]
    return [(fixed_layer(k, sizes[k], h * w), fixed_layer(3 + k, h, w)[0], fixed_layer(6 + k, h, w)[0]) for k, (h, w) in enumerate(wide)]


def forward(name: str, nodes: DataFrame, edges: DataFrame, model) -> DataFrame:
    """(node, h): outputs of a named model on the whole graph, before any softmax."""
    if name.startswith("gcn"):
        members = nodes.select(F.col("node_id").alias("node"))
        return gcn(members, edges, project(nodes, model[0]), model)
    run: dict[str, Callable] = {"gat": gat, "sage": sage}
    return gin(nodes, edges, *model) if name == "gin" else run[name](nodes, edges, model)
