"""Connected components of a graph that is held as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import stored


def _star(links: DataFrame, large: bool) -> DataFrame:
    """One half-round: hang neighbours of each node on the least node nearby."""
    turned = links.select(F.col("b").alias("a"), F.col("a").alias("b"))
    near = links.union(turned) if large else links.where("a > b").union(turned.where("a > b"))
    least = near.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
    moved = near.join(least, "a")
    if large:
        moved = moved.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        moved = moved.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
    return moved.where("a != b").distinct()


def extended(found: DataFrame, links: DataFrame) -> DataFrame:
    """The components (node, component) of a graph that gets more links: only the
    few new links between components are followed."""
    for end in ("a", "b"):
        named = found.select(F.col("node").alias(end), F.col("component").alias(f"{end}_"))
        links = links.join(named, end, "left").withColumn(f"{end}_", F.coalesce(f"{end}_", end))
    above = stored(components(links.select(F.col("a_").alias("a"), F.col("b_").alias("b"))), "above")
    moved = found.join(above.select(F.col("node").alias("component"), F.col("component").alias("_c")), "component", "left")
    moved = moved.select("node", F.coalesce("_c", "component").alias("component"))
    new = above.join(found, "node", "left_anti").select("node", "component")
    return moved.union(new)


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of links (a, b), component being the
    least node that can be reached.

    Large-star and small-star rounds: each needs one aggregation with partial
    sums and one join, and the number of rounds grows with the logarithm of the
    longest path. No component is held in memory; the links of a root meet its one
    least neighbour in a join, whose large side adaptive execution splits where a
    root has very many. Every round is written to the shared folder. Null ends and
    loops are ignored."""
    links = links.where("a is not null and b is not null and a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    links, before = stored(links, "links"), None
    while True:
        now = tuple(links.agg(F.count("*"), F.sum(F.hash("a", "b").cast("long"))).first())
        if now == before or not now[0]:
            return links.groupBy("a").agg(F.min("b").alias("component")).withColumnRenamed("a", "node").union(links.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
        before = now
        links = stored(_star(_star(links, True), False), "links")
