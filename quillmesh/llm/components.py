"""Connected components of an edge table by alternating stars, each round written to shared storage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import stage


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(a, b) longs, not null -> (node, component): the smallest node that each can reach.

    Large-star, then small-star, until the edges no longer change; every edge then points at its
    component's smallest node.  The number of edges never grows, hubs are aggregated before they
    are shuffled by hash, and the rounds needed rise with the logarithm of the longest path.
    """
    spark = edges.sparkSession
    now = stage(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    seen = None
    for _ in range(rounds):
        both = now.union(now.select(F.col("b"), F.col("a"))).toDF("node", "other")
        low = both.groupBy("node").agg(F.least(F.min("other"), F.col("node")).alias("low"))
        large = both.where("other > node").join(low, "node").select(F.col("other").alias("a"), F.col("low").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct("a", F.col("low").alias("b")), F.struct(F.col("b").alias("a"), F.col("low").alias("b")))).alias("e"))
        now = stage(small.select("e.a", "e.b").where("a <> b").distinct(), "edges")
        mark = now.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.col("b").cast("decimal(38,0)")), F.lit(0)), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first()
        if mark == seen:
            break
        seen = mark
    else:
        raise RuntimeError("components did not settle")
    roots = now.select(F.col("b").alias("node")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots.select("node", F.col("node").alias("component")))
