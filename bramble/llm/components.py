"""Connected components by alternating large-star and small-star steps.

Every step is two keyed joins and a partial aggregate over edges.  Each side of a join that may
hold a hub's edges meets one row a vertex, so that adaptive execution can split it among tasks.
Each round's edges are a written table, so that
lineage stays short and an executor's loss costs one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bramble.llm.common import Workspace


def stars(edges: DataFrame, work: Workspace, name: str) -> DataFrame:
    """(hi, lo) for edges (a, b): each vertex but the smallest of its component, with that smallest."""
    at = edges.filter("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct()
    at, k, seen = work.table(at, f"{name}-0"), 0, None
    while True:
        both = at.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(at.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.join(least, "u").filter("v > u and v <> m").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(least, "hi").filter("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        k += 1
        now = work.table(small.union(least.select("hi", F.col("m").alias("lo"))).distinct(), f"{name}-{k}")
        mark = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("hi", "lo").cast("decimal(20,0)"))).first()
        work.drop(f"{name}-{k - 1}")
        at = now
        if mark == seen or mark[0] == 0:
            return at
        seen = mark
