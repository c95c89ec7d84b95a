"""Variable-length paths, reachability and shortest paths over a table of edges
(`_from`, `_to`) in the direction of travel."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.sources.storage import kept

#: Levels beyond which each level is written, so that plans stay small.
PLAIN_LEVELS = 4


def expand(starts: DataFrame, edges: DataFrame, low: int, high: int) -> DataFrame:
    """(`_s`, `_t`, `_path`) of all simple paths of low to high hops: no node is
    on a path twice, the start included. 0 hops is the start itself."""
    level = starts.select("_s", F.col("_s").alias("_t"), F.array("_s").alias("_path"))
    found = [level] if low == 0 else []
    for depth in range(1, high + 1):
        level = level.join(edges, F.col("_t") == F.col("_from")).where(~F.array_contains("_path", F.col("_to")))
        level = level.select("_s", F.col("_to").alias("_t"), F.concat("_path", F.array("_to")).alias("_path"))
        if high > PLAIN_LEVELS:
            level = kept(level)
            if depth > 1 and level.isEmpty():
                break
        if depth >= low:
            found.append(level)
    if not found:
        return level.where(F.lit(False))
    out = found[0]
    for x in found[1:]:
        out = out.union(x)
    return out


def reach(starts: DataFrame, edges: DataFrame, low: int, high: int) -> DataFrame:
    """(`_s`, `_t`), each once: what expand() can reach if low is 0 or 1. A level
    holds only what was not reached before, so nothing grows with the number of
    paths."""
    here = starts.select("_s", F.col("_s").alias("_t"))
    level, seen = here, here
    for depth in range(1, high + 1):
        level = level.join(edges, F.col("_t") == F.col("_from")).select("_s", F.col("_to").alias("_t")).distinct().join(seen, ["_s", "_t"], "left_anti")
        if high > PLAIN_LEVELS:
            level = kept(level)
            if level.isEmpty():
                break
        seen = seen.union(level)
    return seen if low == 0 else seen.where("_s != _t")


def shortest(pairs: DataFrame, edges: DataFrame, high: int) -> DataFrame:
    """(`_s`, `_t`, `_hops`) for the pairs (`_s`, `_t`) that a path of at most so
    many hops joins; 0 for a node and itself.

    Breadth first from the distinct starts, one table a level, each node once for
    each start. A start whose pairs have all been found goes no further, and the
    search ends when no new node is left."""
    pairs = kept(pairs.where("_s is not null and _t is not null").distinct())
    edges = kept(edges)  # read again by each level
    level = pairs.select("_s").distinct().select("_s", F.col("_s").alias("_t"), F.lit(0).cast("long").alias("_hops"))
    seen = level
    for hops in range(1, high + 1):
        open_ = pairs.join(seen, ["_s", "_t"], "left_anti").select("_s").distinct()
        level = level.join(open_, "_s", "left_semi").join(edges, F.col("_t") == F.col("_from")).select("_s", F.col("_to").alias("_t")).distinct()
        level = kept(level.join(seen, ["_s", "_t"], "left_anti").withColumn("_hops", F.lit(hops).cast("long")))
        if level.isEmpty():
            break
        seen = seen.union(level)
    return pairs.join(seen, ["_s", "_t"])
