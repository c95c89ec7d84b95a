"""Mixing sources to target weights along a curriculum.

Each source has a weight that changes over the training time t in [0, 1]: a base
weight times a piecewise-linear schedule. The integral of that weight fixes how
many words the source gives in all; the share that its integral has reached at t
says how many it has given by then. A document (or its second or third copy)
stands somewhere in its source's shuffled stream of words; inverting the
cumulative demand there gives its training position, and documents are
range-sorted by position.

Positions in a source come from two-level prefix sums: documents fall into salted
blocks by a hash of their id, only sums per (source, block) meet, and each block
is summed alone. So a source that holds a third of all rows is as many tasks.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.llm.common import stored, word_count

#: (t, factor) knots by weight class: the first fades, the last rises.
SCHEDULES = (((0.0, 1.5), (1.0, 0.5)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.25), (0.5, 0.75), (1.0, 2.25)))
ROWS_PER_BLOCK = 20_000


def integral(knots: tuple) -> list[float]:
    """The integral of a schedule up to each of its knots."""
    out = [0.0]
    for (t, w), (u, v) in zip(knots, knots[1:], strict=False):
        out.append(out[-1] + (u - t) * (v + w) / 2)
    return out


def position(share: Column, knots: tuple) -> Column:
    """The time at which a source has given this share of its words: the inverse
    of its integrated schedule."""
    sums = integral(knots)
    need = share * sums[-1]
    out = F.lit(1.0)
    for k in range(len(knots) - 2, -1, -1):
        (t, w), (u, v) = knots[k], knots[k + 1]
        rest, slope = need - sums[k], (v - w) / (u - t)
        within = rest / w if slope == 0 else (F.sqrt(F.greatest(F.lit(0.0), w * w + 2 * slope * rest)) - w) / slope
        out = F.when(need <= sums[k + 1], t + within).otherwise(out)
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), out))


def targets(sources: DataFrame, weights: tuple, most_epochs: int, schedules: tuple = SCHEDULES) -> DataFrame:
    """Words to take of each source (source, source_size).

    Weights repeat over the sources in code-point order, null last; each one's
    weight is its base times the integral of its schedule. Filling from the source
    that reaches its limit first gives the same targets as resharing the excess
    round by round. There is one row per source here, and one task. Sums are those of
    doubles, exact for whole numbers up to 2^53."""
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    s = sources.withColumn("class", (rank % len(weights)).cast("int")).withColumn("w", F.lit(None).cast("double"))
    for k, base in enumerate(weights):
        whole = base * integral(schedules[k % len(schedules)])[-1]
        s = s.withColumn("w", F.when(F.col("class") == k, F.lit(float(whole))).otherwise(F.col("w")))
    s = s.withColumn("cap", F.col("source_size") * most_epochs).withColumn("total", F.sum("source_size").over(every))
    order = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    s = s.withColumn("left", F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0))).withColumn("open", F.sum("w").over(after))
    s = s.withColumn("full", F.col("cap") * F.col("open") <= F.col("w") * F.col("left"))
    s = s.withColumn("rest", F.col("total") - F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))).over(every), F.lit(0))).withColumn("rest_w", F.sum(F.when(~F.col("full"), F.col("w"))).over(every))
    share = (F.col("w") * F.col("rest")).cast("double") / F.col("rest_w")
    return s.select("source", "class", "source_size", F.when(F.col("full"), F.col("cap").cast("double")).otherwise(share).alias("target"))


def mix(docs: DataFrame, weights: tuple = (5, 2, 1), most_epochs: int = 3, schedules: tuple = SCHEDULES, ordered: bool = True) -> DataFrame:
    """All columns of docs (doc_id, text, source, ...) and size, source_size,
    target, taken, copies, positions, in order of the first position if ordered.

    taken counts words: the copy that meets the target is cut there, so a source's
    sum is its target, rounded down. copies counts whole documents instead, the
    copy at the target being in if half of it fits. positions has the training
    position of each copy that is counted or taken in part. Null text: size 0, nothing
    taken. Null source: a source of its own, last. Null doc_id: sorted as if its
    text were it. Rows alike share any order, their sums being the same.
    Nothing is random: reruns agree. An empty table gives an empty result. Columns
    of docs with a name of the result are replaced."""
    added = ("size", "source_size", "target", "taken", "copies", "positions")
    docs = docs.drop(*added).withColumn("source", F.col("source").cast("string"))
    sized = docs.withColumn("size", word_count(F.col("text"))).withColumn("_key", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.col("text").cast("string"), F.lit(""))))
    rows = docs.select("source").count()
    digits = max(0, math.ceil(math.log(max(1, rows / ROWS_PER_BLOCK), 16)))
    sized = sized.withColumn("_block", F.substring("_key", 1, digits))
    blocks = stored(sized.groupBy("source", "_block").agg(F.sum("size").alias("_sum")), "blocks")
    goals = targets(blocks.groupBy("source").agg(F.sum("_sum").alias("source_size")), weights, most_epochs, schedules)
    base = F.coalesce(F.sum("_sum").over(Window.partitionBy("source").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = blocks.withColumn("_base", base).drop("_sum")
    bases = stored(placed.join(goals.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s"), "bases")
    bases = bases.select(F.col("source").alias("_s"), F.col("_block").alias("_b"), "_base", "class", "source_size", "target")

    within = Window.partitionBy("source", "_block").orderBy("_key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    out = sized.withColumn("_at", F.coalesce(F.sum("size").over(within), F.lit(0)))
    out = out.join(bases, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_block") == F.col("_b"))).withColumn("_at", F.col("_at") + F.col("_base"))
    end = F.floor("target")
    starts = [F.col("_at") + e * F.col("source_size") for e in range(most_epochs)]
    parts = [F.greatest(F.lit(0), F.least(F.col("size"), end - s)).cast("long") for s in starts]
    out = out.withColumn("taken", sum(parts[1:], parts[0]))
    counted = [(F.col("size") > 0) & (s + F.col("size") / 2 < F.col("target")) for s in starts]
    out = out.withColumn("copies", sum((F.when(c, 1).otherwise(0) for c in counted), F.lit(0)).cast("int"))
    times = []
    for start, part, whole in zip(starts, parts, counted, strict=True):
        share, at = F.try_divide(start, F.col("target")), F.lit(None).cast("double")
        for k, knots in enumerate(schedules):
            of_class = F.col("class") % len(schedules) == k
            at = F.when(of_class, position(share, knots)).otherwise(at)
        times.append(F.when((part > 0) | whole, at))
    out = out.withColumn("positions", F.array_compact(F.array(*times)))
    out = out.drop("_key", "_block", "_at", "_base", "_s", "_b", "class")
    return out.orderBy(F.get("positions", F.lit(0)).asc_nulls_last(), "doc_id") if ordered else out
