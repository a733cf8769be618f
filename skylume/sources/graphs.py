"""Graphs as tables: nodes, directed edges, splits; readers and writers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Supplier nodes of the trade graph begin here.
SUPPLIERS = 1_000_000
#: Matrices up to this size go to every task as a broadcast; larger ones are met in blocks.
BROADCAST_VALUES = 1 << 24


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def number_edges(pairs: DataFrame, width: int = 4096) -> DataFrame:
    """(edge_id, src, dst): the rank by (src, dst), from 0, of distinct directed pairs.

    Ranks are counted within ranges of sources; only the ranges' sizes meet in one task.
    """
    rows = pairs.select(F.col("src").cast("long"), F.col("dst").cast("long")).distinct().withColumn("part", F.floor(F.col("src") / width))
    sizes = rows.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    rank = F.row_number().over(Window.partitionBy("part").orderBy("src", "dst")) - 1
    return rows.withColumn("rank", rank).join(before, "part").select((F.col("before") + F.col("rank")).cast("long").alias("edge_id"), "src", "dst")


def symmetrize(edges: DataFrame) -> DataFrame:
    """Both directions of every edge, once, without self loops: (src, dst)."""
    both = edges.select("src", "dst").union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return drop_self_loops(both).distinct()


def drop_self_loops(edges: DataFrame) -> DataFrame:
    return edges.filter(F.col("src") != F.col("dst"))


def trade_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, dst, orders): customer, supplier and the number of orders they share."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey").distinct()
    return orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey")).groupBy(F.col("o_custkey").alias("src"), (F.col("l_suppkey") + SUPPLIERS).alias("dst")).agg(F.count(F.lit(1)).alias("orders"))


def trade_edges(spark: SparkSession, sf_dir: str, least: int) -> DataFrame:
    """Bipartite graph: an edge where at least ``least`` orders are shared."""
    return number_edges(symmetrize(trade_pairs(spark, sf_dir).filter(F.col("orders") >= least)))


def embedding_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(node_id, x, y) with x in double precision."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("node_id"), F.col("embedding").cast("array<double>").alias("x"), F.col("label").alias("y"))


class _Targets:
    """Vectors to be found, each value at most k + 1 times: of equal vectors the smallest ids win."""

    def __init__(self, ids, vectors, k: int):
        import numpy as np

        # Equal vectors have equal keys; should others share one, a few more copies are kept.
        key = _in_order(vectors, np.random.default_rng(0).normal(size=(1, vectors.shape[1])))
        order = np.argsort(key, kind="stable")
        same = np.r_[False, (vectors[order][1:] == vectors[order][:-1]).all(axis=1)] if len(ids) else np.zeros(0, dtype=bool)
        group = np.empty(len(ids), dtype=np.int64)
        group[order] = np.cumsum(~same)
        by_id = np.lexsort((ids, group))
        starts = np.r_[True, group[by_id][1:] != group[by_id][:-1]] if len(ids) else np.zeros(0, dtype=bool)
        place = np.arange(len(ids)) - np.maximum.accumulate(np.where(starts, np.arange(len(ids)), 0))
        kept = by_id[place <= k]
        kept = kept[np.argsort(ids[kept])]
        self.ids, self.vectors, self.k = ids[kept], vectors[kept], k
        self.squares = _in_order(self.vectors, self.vectors)
        self.unit = _unit(self.vectors)

    def nearest(self, ids, vectors, rows: int = 128, lane: int = 128):
        """(src, dst, sim): the k nearest of each of ``ids``, itself left out, ties to smaller ids.

        Single precision finds all that can be among them (its error is bounded), double precision ranks those.
        """
        import numpy as np

        out = []
        n, k = len(self.ids), self.k
        if not n or not len(ids):
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0)
        lanes = -(-n // lane)
        margin = (vectors.shape[1] + 4) * 2.0**-22
        unit, squares = _unit(vectors), _in_order(vectors, vectors)
        odd = not (np.isfinite(unit).all() and np.isfinite(self.unit).all())
        sims = np.full((rows, lanes * lane), -np.inf, dtype=np.float32)
        for at in range(0, len(ids), rows):
            own, block = ids[at : at + rows], sims[: min(rows, len(ids) - at)]
            block[:, :n] = unit[at : at + rows] @ self.unit.T
            if odd:
                block[np.isnan(block)] = -np.inf
            place = np.minimum(np.searchsorted(self.ids, own), n - 1)
            found = self.ids[place] == own
            block[np.flatnonzero(found), place[found]] = -np.inf
            tops = block.reshape(len(own), lanes, lane).max(axis=2)
            # The k-th of the lanes' best values is a lower bound of the k-th of all.
            least = np.partition(tops, lanes - k, axis=1)[:, lanes - k] - margin if lanes >= k else np.full(len(own), -np.inf)
            r, g = np.nonzero(tops >= least[:, None])
            for some in range(0, len(r), 8192):
                rr, gg = r[some : some + 8192], g[some : some + 8192]
                near, j = np.nonzero(block.reshape(len(own), lanes, lane)[rr, gg] >= least[rr, None])
                i, j = rr[near], gg[near] * lane + j
                real = j < n
                i, j = i[real], j[real]
                i, j = i[self.ids[j] != own[i]], j[self.ids[j] != own[i]]
                scale = np.sqrt(squares[at + i] * self.squares[j])
                with np.errstate(invalid="ignore", divide="ignore"):
                    sim = np.clip(_in_order(vectors, self.vectors, at + i, j) / scale, -1, 1)
                sim = np.where(scale > 0, sim, np.where(np.isnan(scale), -np.inf, 0.0))
                out.append(_first(k, own[i], self.ids[j], np.where(np.isnan(sim), -np.inf, sim)))
        return _first(k, *(np.concatenate(x) for x in zip(*out, strict=True)))


def _unit(vectors):
    import numpy as np

    return (vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-300)).astype(np.float32)


def _in_order(a, b, i=slice(None), j=slice(None)):
    """Row products, summed in the order of the columns: equal vectors give equal sums."""
    total = 0.0
    for c in range(a.shape[1]):
        total = total + a[i, c] * b[j, c]
    return total


def _first(k: int, src, dst, sim):
    """The first k rows of each source by similarity, then id."""
    import numpy as np

    order = np.lexsort((dst, -sim, src))
    src, dst, sim = src[order], dst[order], sim[order]
    starts = np.r_[True, src[1:] != src[:-1]] if len(src) else np.zeros(0, dtype=bool)
    place = np.arange(len(src)) - np.maximum.accumulate(np.where(starts, np.arange(len(src)), 0))
    return src[place < k], dst[place < k], sim[place < k]


def _stacked(rows):
    """(ids, vectors) of a frame, by id."""
    import numpy as np

    rows = rows.sort_values("node_id")
    return rows["node_id"].to_numpy(dtype=np.int64), np.stack(rows["x"].to_list()).astype(float) if len(rows) else np.zeros((0, 1))


def nearest_pairs(nodes: DataFrame, k: int) -> DataFrame:
    """(src, dst): each node's k nearest by cosine, ties by id.

    A matrix of at most ``BROADCAST_VALUES`` numbers is broadcast and met by row batches; a
    larger one is dealt in blocks that meet pairwise, each pair a bounded group.
    """
    import pandas as pd

    spark = nodes.sparkSession
    rows = nodes.select("node_id", "x").filter("node_id is not null and x is not null")
    n, width = rows.count(), len(rows.select("x").first()[0]) if not rows.isEmpty() else 0
    if n * width > BROADCAST_VALUES:
        return _nearest_by_join(rows, k)
    ids, vectors = _stacked(rows.toPandas())
    shared = spark.sparkContext.broadcast((ids, vectors))

    def search(batches):
        import numpy as np

        ids, vectors = shared.value
        targets = None
        for pdf in batches:
            if len(pdf):
                targets = targets or _Targets(ids, vectors, k)
                own = np.sort(pdf["node_id"].to_numpy())
                src, dst, _ = targets.nearest(own, vectors[np.searchsorted(ids, own)])
                yield pd.DataFrame({"src": src, "dst": dst})

    tasks = max(1, min(n // 512, 4 * spark.sparkContext.defaultParallelism))
    return rows.select("node_id").repartition(tasks).mapInPandas(search, "src long, dst long")


def _nearest_by_join(rows: DataFrame, k: int, blocks: int = 64) -> DataFrame:
    """Beyond the broadcast: every block of rows meets every block in a keyed group; k survive each."""
    import pandas as pd

    keyed = rows.withColumn("b", F.pmod(F.xxhash64("node_id"), F.lit(blocks)).cast("int"))
    grid = F.sequence(F.lit(0), F.lit(blocks - 1))
    left = keyed.select("node_id", "x", F.col("b").alias("i"), F.explode(grid).alias("j"), F.lit(0).alias("side"))
    right = keyed.select("node_id", "x", F.explode(grid).alias("i"), F.col("b").alias("j"), F.lit(1).alias("side"))

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        own, others = _stacked(pdf[pdf["side"] == 0]), _stacked(pdf[pdf["side"] == 1])
        src, dst, sim = _Targets(*others, k).nearest(*own)
        return pd.DataFrame({"src": src, "dst": dst, "sim": sim})

    near = left.unionByName(right).groupBy("i", "j").applyInPandas(meet, "src long, dst long, sim double")
    rank = F.row_number().over(Window.partitionBy("src").orderBy(F.desc("sim"), "dst"))
    return near.withColumn("r", rank).filter(F.col("r") <= k).select("src", "dst")


def nearest_edges(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    """Undirected union of the k nearest neighbours, both directions, numbered."""
    return number_edges(symmetrize(nearest_pairs(embedding_nodes(spark, sf_dir), k)))


# ------------------------------------------------------------------------------- splits


def split_positional(nodes: DataFrame, total: int, n_test: int, train_share: float = 0.6) -> DataFrame:
    """(node_id, split): first share trains, the last ``n_test`` test, the middle validates."""
    first = int(train_share * total)
    place = F.when(F.col("node_id") < first, "train").when(F.col("node_id") >= total - n_test, "test").otherwise("val")
    return nodes.select("node_id", place.alias("split"))


def split_stratified(nodes: DataFrame, per_class: int, n_test: int, seed: int) -> DataFrame:
    """(node_id, split): ``per_class`` of each class train, then ``n_test`` of the rest test."""
    from skylume.session import seeded

    order = seeded(seed, F.col("node_id"))
    rank = F.row_number().over(Window.partitionBy("y").orderBy(order, "node_id"))
    marked = nodes.select("node_id", "y", (rank <= per_class).alias("train"))
    rest = marked.filter(~F.col("train")).orderBy(seeded(seed, "test", F.col("node_id")), "node_id").limit(n_test).select("node_id", F.lit(True).alias("test"))
    named = F.when(F.col("train"), "train").when(F.col("test"), "test").otherwise("none")
    return marked.join(rest, "node_id", "left").select("node_id", named.alias("split"))


# ------------------------------------------------------------------------ files in and out


def write_graph(nodes: DataFrame, edges: DataFrame, folder: str) -> None:
    nodes.write.mode("overwrite").parquet(f"{folder}/nodes")
    edges.write.mode("overwrite").parquet(f"{folder}/edges")


def read_graph(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{folder}/nodes"), spark.read.parquet(f"{folder}/edges")


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """A file of one integer a line as (node_id)."""
    return spark.read.text(path).select(F.trim("value").try_cast("long").alias("node_id")).filter("node_id is not null")


def save_batch(records: DataFrame, folder: str, batch: int) -> None:
    """One batch of records keyed by vt; later batches win when read back."""
    records.withColumn("batch", F.lit(batch)).write.mode("overwrite").parquet(f"{folder}/batch={batch}")


def latest(records: DataFrame, key: str = "vt", batch: str = "batch") -> DataFrame:
    """Of several records of a key, those of its last batch."""
    last = records.groupBy(key).agg(F.max(batch).alias("__last"))
    return records.join(last, key).filter(F.col(batch) == F.col("__last")).drop("__last")
