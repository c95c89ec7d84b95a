"""An approximate vector index: an inverted file of cells around learned centres.

Centres are fitted by k-means on a bounded sample. Every vector is indexed: it is
written into the folder of the cell of its nearest centre. A search computes exact
scores in the cells whose centres are nearest to the query, and in no others, so
Parquet reads only their folders. Cosine is searched on vectors of length one."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.operators.search import similarity
from loomgraph.sources.storage import scratch

#: Vectors that the centres are fitted on, and rounds of k-means.
MOST_SAMPLED, ROUNDS = 20_000, 12


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((x**2).sum(1)[:, None] - 2 * x @ centres.T + (centres**2).sum(1)).argmin(1)


def fit_centres(x: np.ndarray, cells: int, seed: int = 7) -> np.ndarray:
    """k-means from distinct sampled vectors; a centre that loses all of its vectors
    stays where it was."""
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), min(cells, len(x)), replace=False)].copy()
    for _ in range(ROUNDS):
        at = nearest(x, centres)
        n = np.bincount(at, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, at, x)
        centres[n > 0] = sums[n > 0] / n[n > 0, None]
    return centres


class VectorIndex:
    """Of the vectors (`_id`, vector) of one length; others aren't indexed."""

    def __init__(self, vectors: DataFrame, dimensions: int, metric: str = "cosine", cells: int | None = None, path: str | None = None) -> None:
        self.spark, self.dimensions, self.metric = vectors.sparkSession, dimensions, metric
        self.path = path or scratch(self.spark, "vectors")
        vectors = self._own(vectors)
        n = vectors.count()
        # A bounded sample by a hash of the ids, so reruns agree.
        share = min(1.0, MOST_SAMPLED / max(1, n))
        rows = vectors.where(F.pmod(F.xxhash64("_id"), F.lit(1_000_003)) < share * 1_000_003).select("vector").toPandas()
        sample = np.array(rows["vector"].tolist(), float).reshape(-1, dimensions)
        self.cells = cells or max(1, round(n**0.5))
        self.centres = fit_centres(_unit(sample) if metric == "cosine" else sample, self.cells) if len(sample) else np.zeros((1, dimensions))
        self.insert(vectors)

    def _own(self, vectors: DataFrame) -> DataFrame:
        return vectors.select(F.col("_id").cast("long"), F.col("vector").cast("array<double>")).where(F.col("_id").isNotNull() & (F.size("vector") == self.dimensions) & ~F.exists("vector", lambda x: x.isNull()))

    def insert(self, vectors: DataFrame) -> None:
        """Add vectors; the centres stay."""
        centres, unit = self.centres, self.metric == "cosine"

        def placed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                x = np.array(frame["vector"].tolist(), float).reshape(len(frame), -1)
                yield frame.assign(cell=nearest(_unit(x) if unit else x, centres) if len(frame) else [])

        self._own(vectors).mapInPandas(placed, "_id long, vector array<double>, cell int").repartition("cell").write.mode("append").partitionBy("cell").parquet(self.path)

    def search(self, query: list[float], k: int, probes: int = 8, among: DataFrame | None = None) -> DataFrame:
        """(`_id`, score) of the k nearest in the cells whose centres are nearest, of
        those that are among the rows (`_id`)."""
        if len(query) != self.dimensions:
            raise ValueError(f"the index has {self.dimensions} dimensions, the query {len(query)}")
        q = np.array([query], float)
        q = _unit(q) if self.metric == "cosine" else q
        near = np.argsort(((self.centres - q) ** 2).sum(1), kind="stable")[:probes].tolist()
        stored = self.spark.read.schema("_id long, vector array<double>, cell int").parquet(self.path).where(F.col("cell").isin(near))
        if among is not None:
            stored = stored.join(among.select("_id"), "_id", "left_semi")
        found = stored.select("_id", F.round(similarity(F.col("vector"), query, self.metric), 9).alias("score"))
        return found.orderBy(F.desc("score"), "_id").limit(k)
