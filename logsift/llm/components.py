"""Connected components by alternating large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logsift.llm.common import stage


def _are_stars(edges: DataFrame) -> bool:
    """No node hangs on two others, and none that others hang on hangs on another."""
    ends = edges.select(F.col("a").alias("v"), F.lit(1).alias("up"), F.lit(0).alias("down")) \
        .unionAll(edges.select(F.col("b").alias("v"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return ends.groupBy("v").agg(F.sum("up").alias("up"), F.sum("down").alias("down")) \
        .where("up > 1 or (up = 1 and down > 0)").isEmpty()


def _large_star(edges: DataFrame) -> DataFrame:
    """Every node's larger neighbours are tied to the smallest of node and neighbours."""
    both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.min("b").alias("m"))
    return (both.where("b > a").join(low, "a")
            .select(F.col("b").alias("a"), F.least("a", "m").alias("b")))


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node and its smaller neighbours are tied to the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    low = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionAll(low.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of ``edges`` (a, b); component is its least node.

    Self-links and repeated links are allowed.  Each round is written to the shared folder,
    so a lost executor repeats one round at most; minima are combined before the shuffle
    and a node with very many neighbours is split by the skew join."""
    now = stage(_small_star(edges.where("a <> b").select("a", "b")), "star")
    while not _are_stars(now):
        now = stage(_small_star(_large_star(now)), "star")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")) \
        .unionAll(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
