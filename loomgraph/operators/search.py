"""BM25 full text, vectors, and the fusion of both."""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions.scalar import cosine, dot, euclidean
from loomgraph.plans.expressions import literal
from loomgraph.sources.storage import kept

K1, B, RRF = 1.2, 0.75, 60


def terms(text: Column) -> Column:
    """Lower-cased runs of letters and digits of two bytes or more."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda t: F.octet_length(t) >= 2)


def _is(term: str, x: Column) -> Column:
    return x == F.lit(term)


def bm25(docs: DataFrame, query: str, size: Column | None = None) -> DataFrame:
    """(`_id`, score) of the documents (`_id`, text) that hold a query term.

    A term that the query repeats counts as often. The corpus is read once, and only
    numbers leave the scan: a table of lengths and counts, from which its size, the
    documents with each term and the scores come; no postings are shuffled. Sums are rounded to
    nine digits, so the order of adding doesn't show."""
    spark = docs.sparkSession
    asked = spark.range(1).select(terms(F.lit(query)).alias("q")).first()["q"]
    docs = docs.where(F.col("text").isNotNull()).select("_id", terms(F.col("text")).alias("t")).withColumn("n", F.size("t"))
    if not asked:
        return docs.select("_id", F.lit(0.0).alias("score")).where(F.lit(False))
    distinct = sorted(set(asked))
    tf = [F.size(F.filter("t", partial(_is, q))).alias(f"f{k}") for k, q in enumerate(distinct)]
    counted = kept(docs.select("_id", "n", *tf))
    stats = counted.agg(F.count(F.lit(1)).alias("docs"), F.avg("n").alias("mean"), *[F.count(F.when(F.col(f"f{k}") > 0, 1)).alias(f"d{k}") for k in range(len(distinct))]).first()
    if not stats["docs"] or not stats["mean"]:
        return counted.select("_id", F.lit(0.0).alias("score")).where(F.lit(False))
    total = F.lit(0.0)
    for k, q in enumerate(distinct):
        f, df = F.col(f"f{k}"), stats[f"d{k}"]
        idf = F.log(F.lit((stats["docs"] - df + 0.5) / (df + 0.5) + 1))
        total = total + asked.count(q) * idf * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("n") / F.lit(stats["mean"])))
    hit = F.greatest(*[F.col(f"f{k}") for k in range(len(distinct))], F.lit(0)) > 0
    return counted.where(hit).select("_id", F.round(total, 9).alias("score"))


def bm25_top(docs: DataFrame, query: str, k: int) -> DataFrame:
    return bm25(docs, query).orderBy(F.desc("score"), "_id").limit(k)


def matches(text: Column, query: str, every: bool = False) -> Column:
    """Whether a text holds any, or every, term of a query."""
    asked = terms(F.lit(query))
    return F.size(F.array_except(asked, terms(text))) == 0 if every else F.arrays_overlap(asked, terms(text))


def match_share(docs: DataFrame, query: str) -> DataFrame:
    """(`_id`, score): the share of the query's terms that a document holds."""
    asked = F.array_distinct(terms(F.lit(query)))
    share = F.size(F.array_intersect(terms(F.col("text")), asked)) / F.size(asked)
    return docs.where(F.col("text").isNotNull()).select("_id", share.cast("double").alias("score")).where("score > 0")


def similarity(vector: Column, query: list[float], metric: str) -> Column:
    """Higher is nearer: a distance is negated."""
    q = literal([float(x) for x in query])
    return {"cosine": lambda: cosine(vector, q), "dot": lambda: dot(vector, q), "euclidean": lambda: -euclidean(vector, q)}[metric]()


def vector_top(docs: DataFrame, query: list[float], k: int, metric: str = "cosine") -> DataFrame:
    """(`_id`, score) of the k nearest: exact, one pass, k rows from each task."""
    found = docs.where(F.size("vector") == len(query)).select("_id", F.round(similarity(F.col("vector"), query, metric), 9).alias("score"))
    return found.orderBy(F.desc("score"), "_id").limit(k)


def hybrid(texts: DataFrame, vectors: DataFrame, k: int, alpha: float | None = None) -> DataFrame:
    """(`_id`, score, rank) from two ranked lists (`_id`, score), by reciprocal
    ranks, or with alpha by the blend of min-max scaled scores, alpha being the
    weight of the vectors. The lists are top-k results, hence small."""
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    order = Window.orderBy(F.desc("score"), "_id")

    def side(df: DataFrame, name: str) -> DataFrame:
        low, high = F.min("score").over(every), F.max("score").over(every)
        scaled = F.when(high == low, F.lit(1.0)).otherwise((F.col("score") - low) / (high - low))
        return df.select("_id", F.row_number().over(order).alias(f"r_{name}"), F.count(F.lit(1)).over(every).alias(f"n_{name}"), scaled.alias(f"s_{name}"))

    a, b = side(vectors, "v"), side(texts, "t")
    both = a.join(b, "_id", "full")
    if alpha is None:
        # What a list lacks ranks behind its last.
        score = F.lit(0.0)
        for name in "vt":
            n = F.coalesce(F.max(f"n_{name}").over(every), F.lit(0))
            score = score + 1 / (RRF + F.coalesce(F.col(f"r_{name}"), n + 1))
    else:
        score = alpha * F.coalesce("s_v", F.lit(0.0)) + (1 - alpha) * F.coalesce("s_t", F.lit(0.0))
    ranked = both.select("_id", F.round(score, 9).alias("score"))
    return ranked.select("_id", "score", F.row_number().over(order).cast("long").alias("rank")).where(F.col("rank") <= k)
