"""Connected components by alternating large-star and small-star rounds over an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.llm.common import saved


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One round: every node hands the least node it knows to its larger (large star) or smaller (small star) neighbours."""
    if large:
        seen = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        seen = edges
    least = seen.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    joined = seen.join(least, "u")
    if large:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """Edges (u long, v long), in any direction, loops and repeats allowed -> (node, component), the least node of each component.

    Nodes without an edge to another node are not returned. Null ends are dropped. Every round is an aggregation with
    map-side combine and a join whose result is shuffled anew, so adaptive execution may split the
    partition that holds a hub with very many neighbours: it is never gathered in one task. Rounds go on until one
    changes nothing; their number grows with the logarithm of the nodes. Each round's table replaces the one before.
    """
    now = edges.where("u is not null and v is not null and u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now = saved(now, "edges")
    mark = lambda df: df.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
    before = mark(now)
    if not before["n"]:
        return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    while True:
        now = saved(_star(_star(now, True), False), "edges", instead_of=now)
        after = mark(now)
        if after == before:
            roots = now.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
        before = after
