"""Connected components by alternating large and small stars, each round a written table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import apart, discard, stage


def _large(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select("b", "a").toDF("a", "b"))
    low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
    return both.where("b > a").join(apart(low, "a"), "a").select(F.col("b").alias("a"), F.col("low").alias("b")).where("a <> b")


def _small(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b")
    low = down.groupBy("a").agg(F.min("b").alias("low"))
    return low.select("a", F.col("low").alias("b")).union(down.join(apart(low, "a"), "a").where("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b")))


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) of every node that has an edge to another; ``edges`` has the long columns a and b.

    component is the smallest node reachable. A node of very many edges is only ever reduced by minimum (combined before
    the shuffle) and joined by key, where Spark splits skewed partitions.
    """
    now = stage(_small(edges.select("a", "b").distinct()).distinct(), "components")
    sign = None
    for _ in range(rounds):
        nxt = stage(_small(_large(now)).distinct(), "components")
        discard(now)
        now, before = nxt, sign
        sign = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if sign == before:
            return now.toDF("node", "component")
    raise RuntimeError(f"no fixed point after {rounds} rounds")
