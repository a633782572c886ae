"""Connected components of an edge table by alternating large-star and small-star steps.

(Kiveris et al., "Connected Components in MapReduce and Beyond", 2014.)
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kelpline.llm.common import drop_staged, stage


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Large: each greater neighbour of u is tied to the least of u and its neighbours.
    Small: u and each lesser neighbour are tied to the least of them."""
    if large:
        around = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        around = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = around.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    tied = around.join(least, "u")
    if large:
        out = tied.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = tied.select(F.col("v").alias("u"), F.col("m").alias("v")).union(
            least.select("u", F.col("m").alias("v"))
        )
    return out.where("u <> v").distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """edges (u, v: long) -> (node, component): the least node reachable from each node of an edge.

    No node's neighbours are gathered in one row: a hub is a hot key of an aggregate with
    map-side combine and of a join that adaptive execution can split.  Each round is staged.
    Nulls and loops are left out.
    """
    now = stage(edges.where("u <> v").select("u", "v").distinct(), "edges")
    before = None
    for _ in range(rounds):
        then, now = now, stage(_star(_star(now, True), False), "edges")
        drop_staged(then)
        mark = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if mark == before:
            break
        before = mark
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    # Settled: every node but the least of its component has one edge, to that least node.
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
