"""Connected components by alternating star contraction, each round one written table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators.sinks import materialized

c = F.col


def _to_least(pairs: DataFrame) -> DataFrame:
    """(node, neighbour) -> (neighbour, least of node and its neighbours); the least value per node is a small aggregate."""
    least = pairs.groupBy("a").agg(F.least(F.min("b"), c("a")).alias("m"))
    return pairs.join(least, "a")


def components(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """(node, component) of all nodes of `edges` (two columns a, b of type long); the component is its smallest node.

    Self-links and repeated links do no harm, no links give no rows. Only counts of a round reach the driver. Links shrink
    towards stars with every round, so a hub never holds more than its own neighbours in shuffled, splittable rows.
    """
    now = materialized(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "links")
    seen = None
    for _ in range(rounds):
        both = now.unionByName(now.select(c("b").alias("a"), c("a").alias("b")))
        # large star: larger neighbours of a node move to its least one; every pair keeps its larger node in front
        large = _to_least(both).where("b > a").select(c("b").alias("a"), c("m").alias("b")).distinct()
        # small star: a node and its smaller neighbours move to the least of them
        small = _to_least(large).select(F.explode(F.array("a", "b")).alias("a"), c("m").alias("b"))
        now = materialized(small.where("a <> b").distinct(), "links")
        state = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError("components did not settle")
    return now.select(c("a").alias("node"), c("b").alias("component")).unionByName(
        now.select(c("b").alias("node"), c("b").alias("component")).distinct())
