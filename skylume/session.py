"""Lineage cutting and stable hashing shared by the graph operators."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def settle(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the session's shared folder (a temporary one if none is set)."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(sc.getConf().get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="skylume-"))
    return df.checkpoint(eager=True)


def seeded(*parts: Column | str | int) -> Column:
    """MD5 of the parts joined by bars: one order for sampling, the same in any engine."""
    return F.md5(F.concat_ws("|", *[p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts]).cast("binary"))
