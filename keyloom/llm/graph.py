"""Connected components of an edge table, by alternating large and small stars.

Every round is a DataFrame job whose result is written to the shared folder; the
driver sees two numbers a round (rows and a hash sum), never edges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def _large_star(edges: DataFrame, total: int) -> DataFrame:
    both = edges.union(edges.select("v", "u"))
    least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
    # a hub's edges are spread over tasks
    return common.join_spread(both.where("v > u"), least, ["u"], "n", 2 * total).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()


def _small_star(edges: DataFrame, total: int) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    moved = common.join_spread(edges, least, ["u"], "n", total).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v")
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of an edge; edges: u, v of one ordered type, root: the smallest node reachable."""
    flat = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u > v").distinct()
    flat, before = common.materialize(flat), None
    while True:
        now = flat.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before or not now[0]:
            break
        before = now
        starred = common.materialize(_large_star(flat, now[0]))
        flat = common.materialize(_small_star(starred, now[0]))
    return flat.select(F.col("u").alias("node"), F.col("v").alias("root")).union(flat.select("v", "v").distinct())
