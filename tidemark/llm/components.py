"""Connected components by alternating large-star and small-star steps, each a grouped Spark job."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import checkpointed, released

ROUNDS = 60


def _both(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.u", "e.v")


def _star(directed: DataFrame, only_larger: bool) -> DataFrame:
    """Ties each node's neighbours (or the larger ones alone) to the least of the node and its neighbours.

    The least is an aggregate with partial sums. It is joined back by u, a hub's neighbours on the one side and a single
    row on the other, which is the join that adaptive execution splits where one u has too many.
    """
    least = directed.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    tied = directed.join(least, "u")
    if only_larger:
        return tied.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    own = least.where("u <> m").select("u", F.col("m").alias("v"))
    return tied.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(own).distinct()


def components(links: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """node, component (the least node reachable) for each node of the links a, b (longs); nodes without links are not listed.

    Rounds go on until one changes nothing and each node has one edge, to its component's least node.
    """
    edges = checkpointed(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = None
    for _ in range(rounds):
        large = _star(_both(edges), only_larger=True)
        edges = checkpointed(_star(large.where("u > v"), only_larger=False).where("u > v"))
        now = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        released(links.sparkSession)
        if now == before and edges.groupBy("u").count().where("count > 1").isEmpty():
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    stars = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    centres = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return stars.unionByName(centres)
