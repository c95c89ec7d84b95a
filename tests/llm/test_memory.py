"""What workers hold: batches bounded by bytes, short slices, nothing left behind."""

import sys
import tracemalloc

import numpy as np
import pandas as pd

from loomgraph.llm import shingles
from loomgraph.llm.common import STORING, lean, stored
from loomgraph.llm.minhash import _sign
from loomgraph.llm.queries import tokenizer_path
from loomgraph.llm.tokens import encoder, read_tokens


def test_batches_of_long_texts_are_bounded(spark):
    def run(frames):
        for frame in frames:
            yield pd.DataFrame({"size": [int(frame["text"].str.len().sum())]})

    before = [spark.conf.get(k, None) for k in STORING]
    docs = spark.range(0, 300, 1, 1).selectExpr("id", "repeat('ab cd ', 20000) AS text")
    sizes = [r["size"] for r in stored(docs.mapInPandas(run, "size long"), "sizes").collect()]
    assert sum(sizes) == 300 * 120_000 and max(sizes) < 10_000_000
    assert [spark.conf.get(k, None) for k in STORING] == before


def test_signing_takes_short_slices(monkeypatch):
    monkeypatch.setattr(shingles, "_powers", {})
    rng = np.random.default_rng(1)
    names = np.array([f"w{k:04d}" for k in range(400)])
    frame = pd.DataFrame({"doc_id": range(2_000), "text": [" ".join(rng.choice(names, 400)) for _ in range(2_000)]})
    tracemalloc.start()
    try:
        assert sum(len(x) for x in _sign(5, 6, 252)(iter([frame]))) == 2_000
        assert tracemalloc.get_traced_memory()[1] < 60_000_000
    finally:
        tracemalloc.stop()


def test_a_lean_worker_drops_the_encoder():
    encoder(tokenizer_path(), False)
    state = sys.modules["_loomgraph_worker"]
    seen = lean(lambda frames: ((state.encoder, f) for f in frames))(iter([1]))
    assert list(seen) == [(None, 1)]
    assert encoder(tokenizer_path(), False).encode("a b")


def test_the_manifest_starts_no_rows_of_python(spark, monkeypatch):
    def refused(*_, **__):
        raise AssertionError("rows of the driver's Python")

    monkeypatch.setattr(type(spark), "createDataFrame", refused)
    assert read_tokens(spark, "unused", []).collect() == []
