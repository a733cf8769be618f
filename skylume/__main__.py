"""python -m skylume TABLES OUT [PARAMS]: explain every node of the nearest-neighbour graph.

TABLES is a folder of Parquet tables, OUT a new folder for the skyline, PARAMS a file of
``name: value`` lines.  Prints the number of buckets, the mean quality and the seconds taken.
"""

from __future__ import annotations

import sys
import time


def main(args: list[str]) -> int:
    if not 2 <= len(args) <= 3:
        print(__doc__)
        return 2
    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    from skylume.config import Params, load_params
    from skylume.operators.models import fixed_model
    from skylume.plans.search import explain, heads_ipf
    from skylume.session import settle
    from skylume.sources.graphs import embedding_nodes, nearest_edges

    p = load_params(args[2]) if len(args) == 3 else Params()
    spark = SparkSession.builder.appName("skylume").getOrCreate()
    began = time.perf_counter()
    nodes, edges = embedding_nodes(spark, args[0]), settle(nearest_edges(spark, args[0], 2))
    width = len(nodes.select("x").first()["x"])
    vts = edges.select(F.col("src").alias("vt")).distinct()
    explain(nodes, edges, vts, p, fixed_model(p.model, width, p.hidden, p.classes), rest=True).write.parquet(args[1])
    found = spark.read.parquet(args[1])
    quality = heads_ipf(found).agg(F.avg("ipf")).first()[0]
    print(f"buckets {found.count()}, mean quality {quality}, seconds {time.perf_counter() - began:.1f}")
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
