"""The pipeline's stages: what each takes away, and that it hands on the columns."""

import importlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
EXTRA = "doc_id long, text string, lang string, source string, n_chars long, _gone string, size string, positions string, _number int"


@pytest.fixture(scope="module")
def pipeline():
    return importlib.import_module("corpus_pipeline")


def test_pipeline(spark, tmp_path, pipeline):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, sizes = docs.columns, [docs.count()]
    for k, (_, stage) in enumerate(pipeline.STAGES):
        out = stage(spark, docs, SF)
        out.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        sizes.append(docs.count())
        if k < len(pipeline.STAGES) - 1:
            assert docs.columns == columns
    assert sizes[0] >= sizes[1] >= sizes[2] >= sizes[3] > 0 and sizes[4] == sizes[5]
    assert docs.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    # The token files are in the order of training, as the mixing stage wrote it.
    mixed = spark.read.parquet(str(tmp_path / "3")).select("doc_id", "text", "_metadata.file_name", "_metadata.row_index").collect()
    mixed.sort(key=lambda r: (r["file_name"], r["row_index"]))
    rows, at = sorted(docs.collect(), key=lambda r: r["start"]), 0
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(pipeline.tokenizer_path())
    assert [r["doc_id"] for r in rows] != sorted(r["doc_id"] for r in rows)
    for r, m in zip(rows, mixed, strict=True):
        ids = np.append(library.encode(m["text"] or "", add_special_tokens=False).ids, 0).astype("<u4")
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) == (m["doc_id"], at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)


def test_run(spark, pipeline):
    from loomgraph.llm.common import stored

    held = stored(spark.range(3).toDF("x"), "held")
    assert pipeline.run(spark, SF).count() > 0
    assert held.count() == 3  # another result's tables stay


@pytest.mark.parametrize("k", range(5))
def test_stages_take_empty_tables(spark, k, pipeline):
    empty = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    assert pipeline.STAGES[k][1](spark, empty, SF).count() == 0


def odd(spark):
    words = " ".join(f"w{k}" for k in range(60))
    item = spark.read.parquet(f"{SF}/benchmark.parquet").where("text is not null").orderBy("item_id").first()["text"]
    rows = [
        (None, words, "a"), (1, None, "a"), (1, words, None), (2, "", "b"), (3, " \n", "b"), (4, "a b c d e", "a"), (4, "a b c d e", "a"),
        (4, "quite another text of this id", "a"), (5, f"Before. {item} After.", "a"), (5, "clean words beside it", "a"), (None, item, "b"), (6, "long " * 200_000, "b"), (7, words + " w60", "b"),
    ]
    return spark.createDataFrame([(d, t, None, s, 1, "x", "y", None, k) for k, (d, t, s) in enumerate(rows)], EXTRA), item, words


def test_stages_take_odd_rows(spark, pipeline):
    docs, item, words = odd(spark)
    kept = {}
    for name, stage in pipeline.STAGES:
        out = stage(spark, docs, SF)
        if name != "token ids":
            assert out.columns == docs.columns
        kept[name] = out.collect()
    texts = {n: sorted((r["text"] or "" for r in rows), key=lambda t: (len(t), t)) for n, rows in kept.items() if n != "token ids"}
    assert len(kept["toxicity"]) == docs.count()
    # The repeated row, two of the three near copies, and the item alone.
    assert len(kept["near duplicates"]) == docs.count() - 4 and texts["near duplicates"].count("a b c d e") == 1
    assert sum(t.startswith("w0 ") for t in texts["near duplicates"]) == 1 and "quite another text of this id" in texts["near duplicates"]
    assert len(kept["decontamination"]) == docs.count() - 2 and "clean words beside it" in texts["decontamination"] and not any(item in t for t in texts["decontamination"])
    assert {r["_number"] for r in kept["mixing"]} <= set(range(docs.count())) and all(r["_gone"] == "x" and r["size"] == "y" for r in kept["mixing"])
    assert len(kept["token ids"]) == docs.count() and sorted(r["n_tokens"] for r in kept["token ids"])[:2] == [1, 1]


def test_near_duplicates_of_many_rows(spark, pipeline):
    rows = [(k // 2, f"text number {k % 50} with words enough for a window") for k in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("lang", F.lit("x"))
    out = pipeline.drop_near_duplicates(spark, docs, SF).collect()
    assert sorted(r["text"] for r in out) == sorted({t for _, t in rows})
