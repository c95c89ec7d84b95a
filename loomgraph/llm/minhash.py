"""Near-duplicate documents: SuperMinHash, banding, verification, grouping.

A document is its set of distinct word shingles. Two documents are linked when
100 * |intersection| >= 100 * threshold * |union|, which is always decided on
their full sets. Signatures only choose what to compare: 252 slots in 42 bands of
6 miss a pair at the threshold of 0.8 with a probability of 3e-6, and less above.
Nothing else loses a link.

Equal sets collapse into one representative first, so thousands of exact copies
cost nothing later. The members of a bucket are first compared with its centre,
the one that shares most buckets with others; this links most of a large group of
near copies. What is still in different components of a bucket is compared next,
by what sets it apart from the centre: with x and y known relative to c,

    |x & y| = |x & c| + |y & c| - |c| + |(x ^ c) & (y ^ c)|,

as a shingle of c that both lack and one that both have beyond c are the only ones
which the first three terms get wrong. So the few differences of near copies
decide exactly, no text moves for it, and a row is made only of a pair that is
linked. A pair's own side is that which is not in the centre's largest component;
the other side is split over tasks by salt.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import lean, sent, stored
from loomgraph.llm.components import components, extended
from loomgraph.llm.shingles import batches, mix, set_keys, shingle_sets, superminhash

SIGNED = "doc_id long, n_shingles long, key_a long, key_b long, bands array<long>"
#: Rows of a centre that meet in one task; beyond, they are dealt out by salt.
MEMBERS = 2_000


def _sign(width: int, rows_per_band: int, size: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            texts = frame["text"].tolist()
            for a, b in batches(texts):
                sets = shingle_sets(texts[a:b], width)
                sig = superminhash(sets, size)
                banded = sig.reshape(len(sets), -1, rows_per_band)
                keys = np.zeros(banded.shape[:2], np.uint64)
                for k in range(rows_per_band):
                    keys = mix(keys + banded[:, :, k] * np.uint64(2 * k + 3))
                keys = mix(keys + np.arange(keys.shape[1], dtype=np.uint64)).view(np.int64)
                key_a, key_b = set_keys(sets)
                yield pd.DataFrame({
                    "doc_id": frame["doc_id"].values[a:b], "n_shingles": [len(s) for s in sets], "key_a": key_a.view(np.int64), "key_b": key_b.view(np.int64),
                    "bands": list(keys),
                })

    return run


def sign(docs: DataFrame, width: int = 4, bands: int = 42, rows_per_band: int = 6) -> DataFrame:
    """Size of the set, its key and its band keys, for every row of docs (doc_id,
    text)."""
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInPandas(lean(_sign(width, rows_per_band, bands * rows_per_band)), SIGNED)


def _pairs(pairs: DataFrame, texts: DataFrame, run, schema: str) -> DataFrame:
    """run() over the pairs (a, b) with the texts of both, sorted by b in each task.
    texts: (doc_id, text); each pair meets its two texts in two shuffles."""
    half = pairs.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("a_text")), "a")
    whole = half.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("b_text")), "b")
    return whole.sortWithinPartitions("b").select("a", "b", "a_text", "b_text").mapInPandas(lean(run), schema)


def _sets(frames: Iterator[pd.DataFrame], width: int) -> Iterator[tuple]:
    """(a, b, set of a, set of b) for each pair; the set of b is kept while it lasts."""
    last: tuple = (None, None)
    for frame in frames:
        for a, b, t, u in zip(frame["a"].tolist(), frame["b"].tolist(), frame["a_text"].tolist(), frame["b_text"].tolist(), strict=True):
            if last[0] != b:
                last = (b, shingle_sets([u], width)[0])
            yield a, b, shingle_sets([t], width)[0], last[1]


def _rows(found: Iterator[tuple], columns: list[str], most: int = 500_000) -> Iterator[pd.DataFrame]:
    """Frames of so many numbers in all (the last column's arrays count)."""
    rows, size = [], 0
    for row in found:
        rows.append(row)
        size += len(row[-1]) if isinstance(row[-1], np.ndarray) else 1
        if size >= most:
            yield pd.DataFrame(rows, columns=columns)
            rows, size = [], 0
    if rows:
        yield pd.DataFrame(rows, columns=columns)


def linked(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) that are linked on their full sets."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def found() -> Iterator[tuple]:
            for a, b, x, y in _sets(frames, width):
                both = len(np.intersect1d(x, y, assume_unique=True))
                if both and 100 * both >= percent * (len(x) + len(y) - both):
                    yield a, b

        yield from _rows(found(), ["a", "b"])

    return _pairs(pairs, texts, run, "a long, b long")


def apart(pairs: DataFrame, texts: DataFrame, width: int) -> DataFrame:
    """(a, b, n_b, shared, differing) of the pairs (a, b): the size of b's set, that
    of the intersection, and the shingles that only one of the two has."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def found() -> Iterator[tuple]:
            for a, b, x, y in _sets(frames, width):
                differing = np.setxor1d(x, y, assume_unique=True)
                yield a, b, len(y), (len(x) + len(y) - len(differing)) // 2, differing.view(np.int64)

        yield from _rows(found(), ["a", "b", "n_b", "shared", "differing"])

    return _pairs(pairs, texts, run, "a long, b long, n_b long, shared long, differing array<long>")


def _between(left: DataFrame, percent: int) -> DataFrame:
    """The links (a, b) between rows (b, doc_id, label, n_shingles, buckets, n_b,
    shared, differing) that have the centre b and a bucket in common, but not their
    label."""
    sizes = left.groupBy("b", "label").agg(F.count("*").alias("k")).groupBy("b").agg(F.max_by("label", F.struct("k", "label")).alias("main"), F.sum("k").alias("members"))
    dealt = left.join(sizes, "b").withColumn("salts", F.ceil(F.col("members") / MEMBERS))
    own = dealt.where("label != main").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1))).drop("main", "members", "salts")
    other = dealt.withColumn("salt", F.pmod(F.hash("doc_id"), F.col("salts").cast("int")).cast("long")).select(*[F.col(c).alias(f"_{c}") for c in ("b", "salt", "doc_id", "label", "n_shingles", "buckets", "shared", "differing")])
    n, m = F.col("n_shingles"), F.col("_n_shingles")
    # 100 * both >= percent * (n + m - both), for whole numbers.
    needed = F.ceil(percent * (n + m) / (100 + percent)) + F.col("n_b") - F.col("shared") - F.col("_shared")
    # Cheap tests first: a later one is only made if those before it hold.
    alike = (F.col("label") != F.col("_label")) & (100 * F.least(n, m) >= percent * F.greatest(n, m))
    alike = alike & (F.least(F.size("differing"), F.size("_differing")) >= needed) & F.arrays_overlap("buckets", "_buckets")
    alike = alike & (F.size(F.array_intersect("differing", "_differing")) >= needed)
    met = own.join(other, (F.col("b") == F.col("_b")) & (F.col("salt") == F.col("_salt")) & alike)
    return met.select(F.greatest("doc_id", "_doc_id").alias("a"), F.least("doc_id", "_doc_id").alias("b")).distinct()


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, bands: int = 42, rows_per_band: int = 6) -> DataFrame:
    """One row (doc_id, n_shingles, component_id, kept) per row of docs.

    component_id is the least doc_id that can be reached over links; kept says
    that it is the document's own. Null, empty and blank texts have an empty set
    and are linked with nothing. Rows that share a doc_id count as one document
    with the links of them all. A null doc_id is linked with nothing and is kept.
    An empty table gives an empty result; other columns are ignored."""
    signed = stored(sign(docs, width, bands, rows_per_band), "signed")
    known = signed.where("n_shingles > 0 and doc_id is not null")
    keys = ["n_shingles", "key_a", "key_b"]
    same = known.groupBy(*keys).agg(F.min("doc_id").alias("rep"))
    rep_of = stored(known.select("doc_id", *keys).join(same, keys).select("doc_id", "rep"), "rep_of")
    reps = known.join(rep_of.where("doc_id = rep").select("doc_id"), "doc_id", "left_semi")

    placed = reps.select("doc_id", "n_shingles", F.explode("bands").alias("bucket"))
    shared = placed.groupBy("bucket").agg(F.count("*").alias("_n")).where("_n > 1")
    members = stored(placed.join(shared, "bucket").dropDuplicates(["bucket", "doc_id"]), "members")
    # What shares most buckets is the likeliest middle of a group.
    weights = stored(members.groupBy("doc_id").agg(F.sum("_n").alias("weight")), "weights")
    texts = stored(docs.select(F.col("doc_id").cast("long"), "text").join(sent(weights.select("doc_id")), "doc_id", "left_semi").dropDuplicates(["doc_id"]), "texts")

    middle = F.max_by(F.struct("doc_id", "n_shingles"), F.struct("weight", -F.col("doc_id"))).alias("c")
    centre = stored(members.join(weights, "doc_id").groupBy("bucket").agg(middle).select("bucket", F.col("c.doc_id").alias("b"), F.col("c.n_shingles").alias("n_b")), "centre")
    sized = members.join(centre, "bucket").where(f"doc_id != b and 100 * least(n_shingles, n_b) >= {percent} * greatest(n_shingles, n_b)")
    pairs = stored(sized.select(F.col("doc_id").alias("a"), "b").distinct(), "pairs")
    found = stored(components(stored(linked(pairs, texts, width, percent), "links")), "found")
    labelled = members.join(found.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("label", F.coalesce("component", "doc_id")).drop("component", "_n")
    # Buckets of two were compared as a whole, others unless all are linked now.
    split = labelled.groupBy("bucket").agg(F.min("label").alias("_l"), F.max("label").alias("_h"), F.count("*").alias("_n")).where("_l != _h and _n > 2").select("bucket")
    # The centre of a bucket has been compared with all of it.
    rest = labelled.join(split, "bucket").join(centre.select("bucket", "b"), "bucket").where("doc_id != b")
    rest = stored(rest.groupBy("b", "doc_id", "label", "n_shingles").agg(F.collect_list("bucket").alias("buckets")), "rest")
    known = stored(apart(rest.select(F.col("doc_id").alias("a"), "b"), texts, width), "apart").withColumnRenamed("a", "doc_id")
    found = stored(extended(found, stored(_between(rest.join(known, ["b", "doc_id"]), percent), "links")), "found")

    grouped = rep_of.join(found.withColumnRenamed("node", "rep"), "rep", "left").select("doc_id", F.coalesce("component", "rep").alias("component_id"))
    # A doc_id of several rows may have been given several representatives.
    grouped = grouped.groupBy("doc_id").agg(F.min("component_id").alias("component_id"))
    out = signed.select("doc_id", "n_shingles").join(grouped, "doc_id", "left")
    out = out.withColumn("component_id", F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
