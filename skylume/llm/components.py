"""Connected components of a link table, by alternating star contractions.

Every round is an aggregation and a join on node ids; the links are written to the
shared folder after each round, so neither links nor components reach the driver.
A hub's neighbours are never gathered in one task: their minimum is kept, and they are dealt
over several tasks where they take it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release, settle, spread_join

#: Rounds after which something must be wrong (they grow with the logarithm of the nodes).
MAX_ROUNDS = 60


def _large_star(links: DataFrame, n: int) -> DataFrame:
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    upper = spread_join(both.filter("b > a"), "a", "b", least, n)
    return upper.select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    to_least = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")
    return to_least.union(least.select("a", F.col("m").alias("b"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root) for each node of ``links`` (a, b); root is the least node reachable.

    The result reads files that stay in the shared folder.  Nodes without links do not appear.  Loops, repeats and either direction are fine.
    """
    links = settle(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = links.agg(F.count(F.lit(1)), F.sum(F.hash("a", "b").cast("long"))).first()
    for _ in range(MAX_ROUNDS):
        if not state[0]:
            break
        after = settle(_small_star(_large_star(links, state[0])))
        now = after.agg(F.count(F.lit(1)), F.sum(F.hash("a", "b").cast("long"))).first()
        release(links)
        links, same = after, now == state
        state = now
        if same:
            break
    else:
        raise RuntimeError("components did not settle")
    return links.select(F.col("a").alias("node"), F.col("b").alias("root")).union(links.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
