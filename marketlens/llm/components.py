"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlens.llm.common import stored

MAX_ROUNDS = 60


def _star(edges: DataFrame, upward: bool) -> DataFrame:
    """Link neighbours of a node to the smallest node around: the larger ones, or the smaller ones and itself."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if upward:
        both = both.unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    joined = both.join(least, "u")
    if upward:
        out = joined.filter(F.col("v") > F.col("u")).select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(
            least.select(F.col("u").alias("a"), F.col("m").alias("b"))
        )
    return out.filter("a > b").distinct()


def components(links: DataFrame, name: str = "links") -> DataFrame:
    """(node, component) of all nodes of links (a, b); a component is called by its smallest node.

    Every round is written to the shared folder; only two numbers reach the driver.
    """
    edges = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a > b").distinct()
    edges, mark = stored(edges, name), None
    for _ in range(MAX_ROUNDS):
        edges = stored(_star(_star(edges, True), False), name)
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(state) == mark:
            break
        mark = tuple(state)
    else:
        raise RuntimeError("components did not settle")
    roots = edges.select(F.col("b").alias("node")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        roots.select("node", F.col("node").alias("component"))
    )
