"""Removal of repeated passages by sliding spans of sentences and of words.

A text is cut into sentences. A span runs from an edge between sentences over SPAN
sentences, and over further ones until it holds enough words; a second kind of span
doesn't look at sentences at all: it runs between cuts that depend on the words
nearby alone, so that neither glue nor punctuation moves it. All spans are hashed by
their words, and equal hashes meet in one aggregation over the whole corpus. The
first occurrence, by doc_id and then place, stays; every word that is covered by
another occurrence is removed.

Word spans miss no passage of 50 words: cuts are the least of every WINDOW hashes of
two words, so those at least WINDOW - 1 words inside a passage are the same wherever
it stands, and no more than WINDOW words apart. The first is at most 2 WINDOW - 2
words from the start, its span holds LONG to LONG + WINDOW - 1 words, and WINDOW
words more settle its end: 4 WINDOW + LONG - 2 = 50.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import mix, stored
from loomgraph.llm.shingles import _SPREAD, _tables, batches, words

#: Sentences to a span, words that it needs, words of a sentence that is cut again.
SPAN, LEAST_WORDS, LONG = 2, 24, 24
#: Hashes of which the least is a cut; LONG is also what a span of words needs.
WINDOW = 7


def sentences(texts: list) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each text: the byte at which each word starts, a hash of each word, and
    the number of each sentence's first word.

    A sentence ends with a word that ends in . ! or ? or that a newline follows;
    one of more than LONG words ends at words with a comma or semicolon too."""
    raw = [b"" if t is None else t.encode("utf-8", "surrogatepass") for t in texts]
    hashes, of = words(texts)
    at = np.searchsorted(of, np.arange(len(texts) + 1))
    out = []
    for i, text in enumerate(raw):
        data = np.frombuffer(text + b"\n", np.uint8)
        inside = ~((data == 32) | ((data >= 9) & (data <= 13)))
        edge = np.diff(np.concatenate(([False], inside, [False])).astype(np.int8))
        start, stop = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        if not len(start):
            out.append((start, start.astype(np.uint64), start))
            continue
        last = data[stop - 1]
        ends = (last == 46) | (last == 33) | (last == 63) | (data[stop] == 10)
        ends[-1] = True
        number = np.concatenate(([0], np.cumsum(ends)[:-1]))
        ends |= ((last == 44) | (last == 59)) & (np.bincount(number)[number] > LONG)
        out.append((start, hashes[at[i] : at[i + 1]], np.concatenate(([0], np.flatnonzero(ends)[:-1] + 1))))
    return out


def cuts(hashes: np.ndarray) -> np.ndarray:
    """The words at which spans of words start and end."""
    value = mix(hashes[:-1] * np.uint64(_SPREAD[0]) + hashes[1:] * np.uint64(_SPREAD[1]))
    n = len(value) - WINDOW + 1
    if n < 1:
        return np.zeros(0, np.int64)
    least = value[:n].copy()
    for k in range(1, WINDOW):
        np.minimum(least, value[k : k + n], out=least)
    most = np.zeros(len(value), np.uint64)
    for k in range(WINDOW):
        np.maximum(most[k : k + n], least, out=most[k : k + n])
    return np.flatnonzero(value == most)


def ranges(hashes: np.ndarray, first: np.ndarray, span: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """The first word of each span, and the word behind it."""
    edges = np.concatenate((first, [len(hashes)]))
    m = np.arange(len(edges))
    # From each edge on, and back from each edge, so that short ends are covered too.
    stop = np.maximum(m + span, np.searchsorted(edges, edges + least))
    from_ = np.minimum(m - span, np.searchsorted(edges, edges - least, side="right") - 1)
    on, back = stop < len(edges), from_ >= 0
    cut = cuts(hashes)
    end = np.searchsorted(cut, cut + LONG)
    whole = end < len(cut)
    a = np.concatenate((edges[on], edges[from_[back]], cut[whole]))
    b = np.concatenate((edges[stop[on]], edges[back], cut[end[whole]]))
    both = np.unique(a << 32 | b)
    return both >> 32, both & 0xFFFFFFFF


def _spans(span: int, least: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            texts, ids, rows = frame["text"].tolist(), frame["doc_id"].to_numpy(), frame["row"].to_numpy()
            for a, b in batches(texts):
                doc, row, at, size, key = [], [], [], [], []
                for i, (_, own, first) in enumerate(sentences(texts[a:b]), a):
                    if not len(own):
                        continue
                    up, down = _tables(len(own) + 1)
                    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(own) * up[: len(own)], dtype=np.uint64)))
                    start, stop = ranges(own, first, span, least)
                    n = stop - start
                    doc.append(np.full(len(n), ids[i], np.int64))
                    row.append(np.full(len(n), rows[i], np.int64))
                    at.append(start)
                    size.append(n)
                    key.append(mix((sums[stop] - sums[start]) * down[start] + n.astype(np.uint64)))
                if doc:
                    yield pd.DataFrame({"key": np.concatenate(key).view(np.int64), "doc_id": np.concatenate(doc), "row": np.concatenate(row), "at": np.concatenate(at), "size": np.concatenate(size)})

    return run


def _remove(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        texts, gone = frame["text"].tolist(), frame["gone"].tolist()
        for a, b in batches(texts):
            new, total, removed = [], [], []
            for i, (start, own, first) in enumerate(sentences(texts[a:b]), a):
                total.append(len(first))
                if gone[i] is None or not len(gone[i]) or not len(own):
                    removed.append(0)
                    new.append(texts[i])
                    continue
                raw = texts[i].encode("utf-8", "surrogatepass")
                both = np.asarray(gone[i], np.int64)
                step = np.bincount(both >> 32, minlength=len(own) + 1) - np.bincount(both & 0xFFFFFFFF, minlength=len(own) + 1)
                lost = np.cumsum(step)[:-1] > 0
                removed.append(int(np.logical_or.reduceat(lost, first).sum()))
                turn = np.flatnonzero(np.diff(lost, prepend=True, append=True))
                edges = [*start.tolist(), len(raw)]
                kept = [raw[: edges[0]], *(raw[edges[k] : edges[e]] for k, e in zip(turn[::2].tolist(), turn[1::2].tolist(), strict=True))]
                new.append(b"".join(kept).decode("utf-8", "surrogatepass"))
            yield pd.DataFrame({"doc_id": frame["doc_id"].iloc[a:b], "text": new, "n_sentences": total, "n_removed": removed})


def without_repeats(docs: DataFrame, span: int = SPAN, least_words: int = LEAST_WORDS) -> DataFrame:
    """(doc_id, text, n_sentences, n_removed) for every row of docs (doc_id, text),
    text being what is left of it; n_removed counts the sentences that have lost
    words, most of them all.

    Words are compared with A-Z lower-cased and any white space between them. A
    span that occurs twice in one document is a repeat there too; where the two
    overlap, only what is behind the first goes. Null texts stay null. Rows without
    doc_id are returned as they are. Rows that share a doc_id and a text are one
    occurrence, and rows that share only a doc_id are texts of their own, in the
    order of a hash. An empty table gives an empty result; other columns are
    ignored."""
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).withColumn("row", F.xxhash64("text"))
    place = ["doc_id", "row", "at"]
    spans = stored(docs.where("doc_id is not null and text is not null").mapInPandas(_spans(span, least_words), "key long, doc_id long, row long, at int, size int"), "spans")
    again = spans.groupBy("key").agg(F.min(F.struct(*place)).alias("first"), F.count("*").alias("n")).where("n > 1").select("key", "first")
    # Stored, so that this shuffle's files are gone before the next one writes its own.
    again = stored(again, "again")
    covered = spans.join(again, "key").where(F.struct(*place) != F.col("first"))
    own = (F.col("doc_id") == F.col("first.doc_id")) & (F.col("row") == F.col("first.row"))
    behind = F.when(own, F.greatest(F.col("at"), F.col("first.at") + F.col("size"))).otherwise(F.col("at"))
    both = F.shiftleft(behind.cast("long"), 32) + F.col("at") + F.col("size")
    covered = covered.select("doc_id", "row", both.alias("range")).groupBy("doc_id", "row").agg(F.collect_set("range").alias("gone"))
    covered = stored(covered, "covered").select(F.col("doc_id").alias("_id"), F.col("row").alias("_row"), "gone")
    joined = docs.join(covered, (F.col("doc_id") == F.col("_id")) & (F.col("row") == F.col("_row")), "left").select("doc_id", "text", "gone")
    return joined.mapInPandas(_remove, "doc_id long, text string, n_sentences int, n_removed int")
