"""Connected components of an edge table by alternating large-star and small-star rounds, all in DataFrame operations.

Edges and labels stay distributed; each round is written to the shared checkpoint folder, so that a lost executor costs
a re-read. The driver only sees one count and one checksum per round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opsloom.session import cut_lineage


def _with_least(edges: DataFrame, key: str) -> DataFrame:
    # the join, not a window: a hub's rows can then be split over tasks
    least = edges.groupBy(key).agg(F.min("v" if key == "u" else "u").alias("m"))
    return edges.join(least, key)


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    found = _with_least(both, "u").filter("v > u")
    return found.select(F.col("v").alias("u"), F.least("m", "u").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """``edges`` with u > v: links u and all its smaller neighbours to the least of them."""
    linked = _with_least(edges, "u")
    return linked.select("u", F.col("m").alias("v")).unionByName(
        linked.filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, left: str, right: str) -> DataFrame:
    """(node, component) for each node of ``edges``: component is the smallest node reachable. Null ends are ignored;
    self edges and repeated edges do not matter; nodes without an edge to another node are not listed."""
    now = cut_lineage(edges.select(F.greatest(left, right).alias("u"), F.least(left, right).alias("v"))
                      .filter(F.col(left).isNotNull() & F.col(right).isNotNull() & (F.col("u") > F.col("v"))).distinct())
    state = None
    while True:
        new = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if new == state:
            break
        state = new
        now = cut_lineage(_small_star(_large_star(now).filter("u > v").distinct()))
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
