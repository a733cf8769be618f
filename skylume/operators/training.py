"""Training of the two-layer graph convolution: propagation on Spark, steps on 16-wide rows.

Both layers are linear between one relu, so the distributed part is A X (once) and, for each
epoch, two products with A; gradients are sums over rows, added up by Spark.  A table small
enough for ``LOCAL_VALUES`` is trained on the driver with the same formulas.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skylume.operators.models import gcn_norm
from skylume.plans.dense import softmax

LOCAL_VALUES = 1 << 24


class Adam:
    """Adam with weight decay added to the gradient."""

    def __init__(self, shapes: list[tuple[int, ...]], rate: float = 0.01, decay: float = 5e-4):
        self.m, self.v = [np.zeros(s) for s in shapes], [np.zeros(s) for s in shapes]
        self.rate, self.decay, self.t = rate, decay, 0

    def step(self, values: list[np.ndarray], grads: list[np.ndarray]) -> list[np.ndarray]:
        self.t += 1
        out = []
        for k, (w, g) in enumerate(zip(values, grads, strict=True)):
            g = g + self.decay * w
            self.m[k] = 0.9 * self.m[k] + 0.1 * g
            self.v[k] = 0.999 * self.v[k] + 0.001 * g * g
            m, v = self.m[k] / (1 - 0.9**self.t), self.v[k] / (1 - 0.999**self.t)
            out.append(w - self.rate * m / (np.sqrt(v) + 1e-8))
        return out


def _start(n_in: int, hidden: int, n_out: int, seed: int) -> list[np.ndarray]:
    rng = np.random.default_rng(seed)
    glorot = lambda a, b: rng.uniform(-1, 1, (a, b)) * np.sqrt(6 / (a + b))
    return [glorot(n_in, hidden), np.zeros(hidden), glorot(hidden, n_out), np.zeros(n_out)]


def train_gcn2(nodes: DataFrame, edges: DataFrame, train_ids: DataFrame, hidden: int, classes: int, epochs: int = 200, seed: int = 42):
    """(layers, losses): the weights of the epoch with the least loss, copied when it was reached."""
    members = nodes.select(F.col("node_id").alias("node"))
    norm = gcn_norm(members, edges, [])
    n, width = nodes.count(), len(nodes.select("x").first()["x"])
    if n * width > LOCAL_VALUES:
        return _train_propagated(nodes, norm, train_ids, hidden, classes, epochs, seed)
    rows = nodes.orderBy("node_id").toPandas()
    ids = rows["node_id"].to_numpy()
    links = norm.toPandas().sort_values(["dst", "src"])
    s, d, w = np.searchsorted(ids, links["src"]), np.searchsorted(ids, links["dst"]), links["w"].to_numpy()

    def spread(h: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Sums by column, each of which lies in one piece: faster than adding up rows in place."""
        return np.stack([np.bincount(b, weights=column[a] * w, minlength=len(h)) for column in np.ascontiguousarray(h.T)], axis=1)

    mine = np.searchsorted(ids, np.sort(train_ids.toPandas()["node_id"].to_numpy()))
    truth = np.eye(classes)[rows["y"].to_numpy()[mine]]
    ax = spread(np.stack(rows["x"].to_list()), s, d)
    values = _start(width, hidden, classes, seed)
    adam, losses, best = Adam([v.shape for v in values]), [], None
    for _ in range(epochs):
        z = ax @ values[0] + values[1]
        h = np.maximum(z, 0)
        near = spread(h, s, d)
        out = near @ values[2] + values[3]
        p = softmax(out[mine])
        losses.append(float(-np.log((p * truth).sum(axis=1)).mean()))
        if best is None or losses[-1] < best[0]:
            best = (losses[-1], [v.copy() for v in values])
        g = np.zeros_like(out)
        g[mine] = (p - truth) / len(mine)
        back = spread(g @ values[2].T, d, s) * (z > 0)
        values = adam.step(values, [ax.T @ back, back.sum(axis=0), near.T @ g, g.sum(axis=0)])
    w1, b1, w2, b2 = best[1]
    return [(w1.tolist(), b1.tolist()), (w2.tolist(), b2.tolist())], losses


def _train_propagated(nodes: DataFrame, norm: DataFrame, train_ids: DataFrame, hidden: int, classes: int, epochs: int, seed: int):
    """The way for large graphs: A X once, and in each epoch a product with A on the way forth
    and one with its transpose on the way back, all on Spark; gradients are summed over rows."""
    import pandas as pd

    from skylume.operators.models import sum_neighbours
    from skylume.session import settle

    width = len(nodes.select("x").first()["x"])
    norm = settle(norm)
    flipped = norm.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w")
    ax = settle(sum_neighbours(nodes.select(F.col("node_id").alias("node"), F.col("x").alias("h")), norm, width, [], "w").withColumnRenamed("h", "ax"))
    labels = settle(nodes.select(F.col("node_id").alias("node"), "y").join(train_ids.select(F.col("node_id").alias("node")), "node", "left_semi"))
    count = labels.count()
    values = _start(width, hidden, classes, seed)
    adam, losses, best = Adam([v.shape for v in values]), [], None

    def summed(rows: DataFrame, f) -> np.ndarray:
        """Sum over batches of the vector ``f`` makes of each."""

        def run(batches):
            total = None
            for pdf in batches:
                if len(pdf):
                    total = f(pdf) if total is None else total + f(pdf)
            if total is not None:
                yield pd.DataFrame({"k": np.arange(len(total)), "v": total})

        return rows.mapInPandas(run, "k int, v double").groupBy("k").agg(F.sum("v").alias("v")).orderBy("k").toPandas()["v"].to_numpy()

    for _ in range(epochs):
        w1, b1, w2, b2 = values

        def forth(batches, w1=w1, b1=b1):
            for pdf in batches:
                h = np.maximum(np.stack(pdf["ax"].to_list()) @ w1 + b1, 0) if len(pdf) else []
                yield pd.DataFrame({"node": pdf["node"], "h": list(h)})

        def error(pdf, w2=w2, b2=b2):
            h, truth = np.stack(pdf["h"].to_list()), np.eye(classes)[pdf["y"].to_numpy()]
            p = softmax(h @ w2 + b2)
            return h, p, truth, (p - truth) / count

        def outer(pdf, error=error):
            h, p, truth, g = error(pdf)
            return np.concatenate([(h.T @ g).ravel(), g.sum(axis=0), [-np.log((p * truth).sum(axis=1)).sum() / count]])

        def back(batches, error=error, w2=w2):
            for pdf in batches:
                yield pd.DataFrame({"node": pdf["node"], "h": list(error(pdf)[3] @ w2.T) if len(pdf) else []})

        def inner(pdf, w1=w1, b1=b1):
            x = np.stack(pdf["ax"].to_list())
            g = np.stack(pdf["h"].to_list()) * (x @ w1 + b1 > 0)
            return np.concatenate([(x.T @ g).ravel(), g.sum(axis=0)])

        spread = sum_neighbours(ax.mapInPandas(forth, "node long, h array<double>"), norm, hidden, [], "w").join(labels, "node").persist()
        second = summed(spread, outer)
        back_spread = sum_neighbours(spread.mapInPandas(back, "node long, h array<double>"), flipped, hidden, [], "w")
        first = summed(back_spread.join(ax, "node"), inner)
        spread.unpersist()
        losses.append(float(second[-1]))
        if best is None or losses[-1] < best[0]:
            best = (losses[-1], [v.copy() for v in values])
        grads = [first[: w1.size].reshape(w1.shape), first[w1.size :], second[: w2.size].reshape(w2.shape), second[w2.size : -1]]
        values = adam.step(values, grads)
    w1, b1, w2, b2 = best[1]
    return [(w1.tolist(), b1.tolist()), (w2.tolist(), b2.tolist())], losses
