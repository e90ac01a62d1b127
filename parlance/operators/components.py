"""Connected components of an edge table, by alternating large and small stars; no neighbour list is ever collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.session import cut


def _both(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _star(links: DataFrame) -> DataFrame:
    """Each link (u, v) with the least vertex next to ``u`` or ``u`` itself; a hub's links stay spread, since only minima are aggregated by key."""
    least = cut(links.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")))
    return links.join(least, "u")


def _settled(links: DataFrame) -> bool:
    """Whether every vertex has one link, and it leads to a vertex without any."""
    if links.groupBy("u").count().where("count > 1").head(1):
        return False
    return not links.select("v").join(links.select(F.col("u").alias("v")), "v", "left_semi").head(1)


def components(edges: DataFrame) -> DataFrame:
    """``id`` and ``component`` (its least reachable id) of every vertex of ``edges`` (u, v), itself included."""
    now = cut(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    while not _settled(now):
        large = _star(_both(now)).where("v > u").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")).where("u <> v")
        large = cut(large.distinct())
        small = _star(large)
        pairs = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v")))
        now = cut(pairs.where("u <> v").distinct())
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("id"), F.col("v").alias("component"))).distinct()
