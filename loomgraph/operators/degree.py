"""Degrees of nodes, and the nodes with the highest."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.graph import Graph, union


def degrees(graph: Graph, label: str, kind: str = "out_degree") -> DataFrame:
    """(`_id`, `degree`) of the nodes of a label that have edges."""
    ends = []
    for (s, _, d), e in graph.edges.items():
        if s == label and kind in ("out_degree", "degree"):
            ends.append(e.select(F.col("_src").alias("_id")))
        if d == label and kind in ("in_degree", "degree"):
            ends.append(e.select(F.col("_dst").alias("_id")))
    if not ends:
        return graph.spark.createDataFrame([], "_id long, degree long")
    return union(ends).groupBy("_id").agg(F.count(F.lit(1)).alias("degree"))


def top_degree(graph: Graph, label: str, limit: int, kind: str = "out_degree") -> DataFrame:
    """The nodes with the most edges, ties by id; nodes without edges have 0."""
    nodes = graph.nodes[label].select("_id").join(degrees(graph, label, kind), "_id", "left")
    return nodes.select("_id", F.coalesce("degree", F.lit(0)).alias("degree")).orderBy(F.desc("degree"), "_id").limit(limit)
