"""A training corpus from raw documents, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
and read again before the next one starts. All but the last return the columns of
documents.

Rows are what the stages keep or drop: rows that share a doc_id, or have none, are
judged one by one, each by its text. Extra columns are handed on, whatever their
names. Null and empty texts pass the three filters; as token ids they are the end id
alone. Empty tables give empty tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm import toxicity
from loomgraph.llm.common import made_since, mark, release, remove, scratch, sent, stored, table, until_exit
from loomgraph.llm.decontam import held_items
from loomgraph.llm.minhash import near_duplicates
from loomgraph.llm.mixing import mix
from loomgraph.llm.queries import END_ID, tokenizer_path
from loomgraph.llm.tokens import token_files

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
#: Scratch tables of the last stage; its result has been written when the next starts.
_of_last: list[str] = []


def _own_scratch(stage: Stage) -> Stage:
    """Remove the last stage's scratch tables, and no others, when a stage starts."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        release(spark, _of_last)
        point = mark()
        out = stage(spark, docs, sf_dir)
        _of_last[:] = made_since(point)
        return out

    return run


def _text_key() -> Column:
    return F.xxhash64(F.col("text").cast("string"))


def _free(docs: DataFrame, name: str) -> str:
    """A column name that docs hasn't got."""
    while name.lower() in [c.lower() for c in docs.columns]:
        name += "_"
    return name


@_own_scratch
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text isn't predicted toxic, by a model of the labelled ones."""
    model = toxicity.fit(toxicity.training_rows(docs, table(spark, sf_dir, "labels")))
    return toxicity.keep_clean(docs, model)


@_own_scratch
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies (five words, 0.8), the first in the
    order of the table as it was written down here; a repeated row is a copy of the
    first one. Texts without words are copies of nothing."""
    number = _free(docs, "_number")
    # Written, so that a number always means the same row.
    rows = stored(docs.withColumn(number, F.monotonically_increasing_id()), "numbered")
    found = near_duplicates(rows.select(F.col(number).alias("doc_id"), F.col("text")))
    gone = stored(found.where("not kept").select(F.col("doc_id").alias(number)), "gone")
    return rows.join(sent(gone), number, "left_anti").select(*docs.columns)


@_own_scratch
def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text holds no item of the benchmark."""
    texts = docs.where("text is not null").select(_text_key().alias("row"), F.col("text").cast("string").alias("text"))
    key = _free(docs, "_gone")
    gone = stored(held_items(texts, table(spark, sf_dir, "benchmark")).select(F.col("row").alias(key)).distinct(), "gone")
    return docs.join(sent(gone), _text_key() == F.col(key), "left_anti")


@_own_scratch
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, in the order of training: a document that is
    taken twice stands in two places, each copy at its own position."""
    at, names = _free(docs, "_position"), {c: f"_own_{k}" for k, c in enumerate(docs.columns) if c not in ("doc_id", "text", "source")}
    mixed = mix(docs.withColumnsRenamed(names), ordered=False).where("copies > 0")
    taken = mixed.withColumn(at, F.explode(F.slice("positions", F.lit(1), F.col("copies"))))
    ordered = taken.orderBy(at, "doc_id", _text_key())
    return ordered.select(*[F.col(names.get(c, c)).alias(c) for c in docs.columns])


@_own_scratch
def write_token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files in the order of training: that of the rows in the files which the
    mixing stage has written. A table that isn't read from files is put in the order
    of doc_id."""
    order, placed = ("doc_id",), docs
    if docs.inputFiles():
        file = F.col("_metadata.file_name")
        number = F.regexp_extract(file, r"part-(\d+)", 1).try_cast("long")
        try:
            placed = docs.select("doc_id", "text", number.alias("_number"), file.alias("_file"), F.col("_metadata.row_index").alias("_row"))
            order = ("_number", "_file", "_row")
        except AnalysisException:  # something between the files and here hides their rows
            placed = docs
    return token_files(placed, scratch(spark, "tokens"), tokenizer_path(), END_ID, order=order)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("near duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("token ids", write_token_ids),
]
#: A fitted model and a byte-pair encoder are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document of the corpus."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        kept = stage(spark, docs, sf_dir)
        path = until_exit(spark, name.replace(" ", "-"))
        kept.write.parquet(path)
        docs = spark.read.schema(kept.schema).parquet(path)
        if before:
            remove(spark, before)
        before = path
    return docs
