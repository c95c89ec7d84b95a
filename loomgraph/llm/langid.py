"""Language identification by prediction by partial matching.

Each language has a context tree over bytes: counts of the byte that follows each
context of up to three bytes. A byte's probability comes from the longest context
that has seen it; every longer one is left by an escape, whose probability is the
share of distinct followers (method C: distinct / (total + distinct)), down to a
uniform guess. The statistics are frozen after training, so the code length of a
text is the exact sum over all of its bytes, and the language with the shortest
code wins.

Training takes at most MOST_PER_LANGUAGE whole documents of a language, chosen by
a hash of doc_id. For speed, costs of all common four-byte strings stand in one
table, by pairs of common byte pairs; the rest are computed from the trees. A letter
is what str.isalpha() takes for one.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import crc_mod

ORDER = 3
MOST_PER_LANGUAGE = 1_500
#: Bytes that the table of common strings may take, for all languages together.
TABLE_BYTES = 1 << 25


def _grams(texts: list, order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """For each byte of all texts the string of it and the three before it, as a
    number (a text is preceded by newlines), and the index of the text."""
    raw = [b"\n" * order + (t or "").lower().encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b"".join(raw), np.uint8).astype(np.uint32)
    sizes = np.array([len(r) for r in raw])
    code = data.copy()
    for k in range(1, order + 1):
        code[k:] |= data[:-k] << np.uint32(8 * k)
    own = np.ones(len(data), bool)
    ends = np.cumsum(sizes)
    for k in range(order):
        own[ends - sizes + k] = False
    return code[own], np.repeat(np.arange(len(texts)), sizes - order)


class Tree:
    """Counts by context and follower, for each order, as sorted numbers."""

    def __init__(self, codes: np.ndarray, counts: np.ndarray) -> None:
        self.levels = []
        for k in range(ORDER, -1, -1):
            key, at = np.unique(codes & np.uint32((1 << 8 * (k + 1)) - 1), return_inverse=True)
            n = np.bincount(at, counts).astype(np.float64)
            ctx, of = np.unique(key >> np.uint32(8), return_inverse=True)
            total, kinds = np.bincount(of, n), np.bincount(of)
            self.levels.append((key, np.log2((total + kinds)[of] / n), ctx, np.log2((total + kinds) / kinds)))

    def cost(self, codes: np.ndarray) -> np.ndarray:
        """Bits of the last byte of each string after the ones before it."""
        out, open_ = np.zeros(len(codes)), np.arange(len(codes))
        for k, (key, bits, ctx, escape) in zip(range(ORDER, -1, -1), self.levels, strict=True):
            own = codes[open_] & np.uint32((1 << 8 * (k + 1)) - 1)
            at = np.minimum(np.searchsorted(key, own), len(key) - 1)
            hit = key[at] == own
            out[open_[hit]] += bits[at[hit]]
            open_, own = open_[~hit], own[~hit] >> np.uint32(8)
            at = np.minimum(np.searchsorted(ctx, own), len(ctx) - 1)
            out[open_] += np.where(ctx[at] == own, escape[at], 0.0)
        out[open_] += 8.0
        return out


class Scorer:
    """Code lengths of texts. It travels as plain arrays, state(), so that a worker
    need not have this module where it can be imported."""

    def __init__(self, trees: dict[str, Tree], common: np.ndarray) -> None:
        """common: byte pairs by falling frequency."""
        self.languages, self.trees = sorted(trees), trees
        n = len(self.languages)
        side = max(2, min(len(common) + 1, math.isqrt(TABLE_BYTES // (8 * max(1, n)))))
        self.side, pairs = side, common[: side - 1].astype(np.uint32)
        self.number = np.zeros(1 << 16, np.int32)  # 0: not a common pair
        self.number[pairs] = np.arange(1, len(pairs) + 1)
        codes = ((pairs[:, None] << np.uint32(16)) | pairs[None, :]).ravel()
        self.table = np.zeros((side, side, n))
        for k, name in enumerate(self.languages):
            self.table[1 : len(pairs) + 1, 1 : len(pairs) + 1, k] = trees[name].cost(codes).reshape(len(pairs), len(pairs))
        self.table = self.table.reshape(side * side, n)

    def state(self) -> dict:
        return {**vars(self), "trees": {k: t.levels for k, t in self.trees.items()}}

    @classmethod
    def of(cls, state: dict) -> Scorer:
        out = cls.__new__(cls)
        vars(out).update(state)
        out.trees = {}
        for k, levels in state["trees"].items():
            out.trees[k] = Tree.__new__(Tree)
            out.trees[k].levels = levels
        return out

    def bits(self, texts: list) -> np.ndarray:
        """Code length of each text in each language."""
        codes, of = _grams(texts)
        a, b = self.number[codes >> np.uint32(16)], self.number[codes & np.uint32(0xFFFF)]
        rare = np.flatnonzero((a == 0) | (b == 0))
        cost = self.table[a * self.side + b]
        if len(rare):
            some, at = np.unique(codes[rare], return_inverse=True)
            cost[rare] = np.stack([self.trees[x].cost(some) for x in self.languages], axis=1)[at]
        return np.stack([np.bincount(of, cost[:, k], len(texts)) for k in range(len(self.languages))], axis=1)

    def predict(self, texts: list) -> tuple[list, np.ndarray]:
        """Language and share of its likelihood, at the root of the length, in
        that of all; `und` and 0 for a text without letters. Ties go to the first
        name."""
        named, share = ["und"] * len(texts), np.zeros(len(texts))
        own = [i for i, t in enumerate(texts) if t and any(map(str.isalpha, t))]
        if not own or not self.languages:
            return named, share
        bits = self.bits([texts[i] for i in own])
        best = bits.argmin(axis=1)
        size = np.array([max(1, len(texts[i])) for i in own])
        rest = (bits - bits.min(axis=1, keepdims=True)) / np.sqrt(size)[:, None]
        p = 1 / np.exp2(-np.minimum(rest, 60)).sum(axis=1)
        for k, i in enumerate(own):
            named[i], share[i] = self.languages[best[k]], p[k]
        return named, share


def _counts(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Four-byte strings of a partition, by language; merged after each batch."""
    found: dict[str, tuple[np.ndarray, np.ndarray]] = {}
    for frame in frames:
        for lang, part in frame.groupby("lang"):
            key, n = np.unique(_grams(part["text"].tolist())[0], return_counts=True)
            if lang in found:
                both, at = np.unique(np.concatenate((found[lang][0], key)), return_inverse=True)
                key, n = both, np.bincount(at, np.concatenate((found[lang][1], n))).astype(np.int64)
            found[lang] = (key, n)
    for lang, (key, n) in found.items():
        yield pd.DataFrame({"lang": lang, "code": key.astype(np.int64), "n": n})


def fit(docs: DataFrame, most: int = MOST_PER_LANGUAGE) -> Scorer:
    """Learn from rows (doc_id, text, lang) whose three columns are known."""
    docs = docs.where("doc_id is not null and text is not null and lang is not null").select("doc_id", F.col("text").cast("string"), F.col("lang").cast("string"))
    sizes = {r["lang"]: r["n"] for r in docs.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    share = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, min(1.0, most / n))]) if sizes else None
    counts = pd.DataFrame({"lang": [], "code": [], "n": []})
    if sizes:
        sample = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) < share[F.col("lang")] * 1_000_003)
        # As many rows as the sample has distinct strings of four bytes.
        counts = sample.select("text", "lang").mapInPandas(_counts, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n")).toPandas()
    trees = {lang: Tree(part["code"].to_numpy().astype(np.uint32), part["n"].to_numpy(float)) for lang, part in counts.groupby("lang")}
    pairs = np.bincount((counts["code"].to_numpy().astype(np.int64) & 0xFFFF), counts["n"].to_numpy(float), 1 << 16) if len(counts) else np.zeros(1 << 16)
    order = np.argsort(-pairs, kind="stable")
    return Scorer(trees, order[: int((pairs > 0).sum())])


def identify(docs: DataFrame, scorer: Scorer) -> DataFrame:
    """doc_id, lang_pred and score for every row of docs (doc_id, text).

    Null texts and texts without a letter are `und` with a score of 0, and so is
    everything if nothing was learned. Other columns are ignored; repeated rows
    give repeated rows."""
    sent = docs.sparkSession.sparkContext.broadcast(scorer.state())

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = Scorer.of(sent.value)
        for frame in frames:
            texts = frame["text"].tolist()
            size = start = 0
            for i, t in enumerate(texts):  # some megabytes at a time
                size += len(t or "")
                if size > 1_000_000 or i == len(texts) - 1:
                    named, score = own.predict(texts[start : i + 1])
                    yield pd.DataFrame({"doc_id": frame["doc_id"].iloc[start : i + 1], "lang_pred": named, "score": score})
                    start, size = i + 1, 0

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInPandas(run, "doc_id long, lang_pred string, score double")


def held_out(column: str = "doc_id"):
    return F.coalesce(crc_mod(column, 4) == 2, F.lit(False))
