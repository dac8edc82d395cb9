"""Connected components of a link table by alternating stars; every step is a written table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import Workspace


def is_stars(links: DataFrame) -> bool:
    """Whether each node is either a root or has one link, to a root."""
    ends = links.select(F.col("a").alias("node"), F.lit(1).alias("links"), F.lit(False).alias("root")).union(links.select("b", F.lit(0), F.lit(True)))
    return not ends.groupBy("node").agg(F.sum("links").alias("links"), F.max("root").alias("root")).where("links > 1 OR (root AND links > 0)").head(1)


def components(ws: Workspace, links: DataFrame, name: str = "components", rounds: int = 60) -> DataFrame:
    """(node, root) for each node with a link; links: (a, b) long, in any direction. The root is the least node of the component.

    Large star: a node's larger neighbours move to its least one. Small star: so do
    its smaller ones. Both keep components, and they end in stars about the least
    nodes. A node's least neighbour is summed before it is moved and joined from a
    table, so Spark can split the links of a node with very many.
    """
    now = ws.write(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"{name}-links0")
    # the steps only shrink the table: as many tasks as its rows need
    tasks = 1 + now.count() // 100_000
    for i in range(1, rounds + 1):
        if is_stars(now):
            break
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = ws.write(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")).coalesce(tasks), f"{name}-large{i}")
        large = both.where("b > a").join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = ws.write(large.coalesce(tasks), f"{name}-links{i}a")
        least = ws.write(large.groupBy("a").agg(F.min("b").alias("m")).coalesce(tasks), f"{name}-small{i}")
        joined = large.join(least, "a")
        moved = joined.where("b <> m").select(F.greatest("b", "m").alias("a"), F.least("b", "m").alias("b")).union(least.select("a", F.col("m").alias("b"))).distinct()
        now = ws.write(moved.coalesce(tasks), f"{name}-links{i}")
        ws.drop(f"{name}-links{i - 1}", f"{name}-large{i}", f"{name}-links{i}a", f"{name}-small{i}")
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
