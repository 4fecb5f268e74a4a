"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, saved


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node links its larger neighbours to the smallest node it knows."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node links itself and its smaller neighbours to the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """edges (u, v long) -> (node, component_id): for each node with an edge, the smallest node reachable.

    Self-links and repeated edges are allowed; an empty table gives an empty one. Stars are re-linked until a round
    changes nothing; each round's edges go to the shared folder, so lineage stays short and no node's whole
    neighbourhood is ever gathered in one row."""
    edges = saved(edges.select(F.col("u").cast("long"), F.col("v").cast("long")).where("u <> v").distinct(), "edges")
    mark = _mark(edges)
    while mark[0]:
        new = saved(_small_star(_large_star(edges)), "edges")
        dropped(edges)
        edges, old, mark = new, mark, _mark(new)
        if old == mark:
            break
    return edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component_id")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component_id")).distinct())
