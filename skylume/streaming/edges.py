"""Edge streams: degrees kept up to date while edges arrive (an extension of ours)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def running_degrees(edges: DataFrame) -> DataFrame:
    """(node, degree) of a stream of undirected edges (src, dst); loops do not count.

    State is one count a node; use output mode "update" or "complete".
    """
    ends = F.explode(F.array("src", "dst")).alias("node")
    return edges.filter("src <> dst").select(ends).groupBy("node").agg(F.count(F.lit(1)).alias("degree"))


def windowed_edges(edges: DataFrame, at: str = "ts", window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(window, src, dst, n): edges of each tumbling window, dropped once later than ``late``."""
    return edges.withWatermark(at, late).groupBy(F.window(at, window), "src", "dst").agg(F.count(F.lit(1)).alias("n"))
