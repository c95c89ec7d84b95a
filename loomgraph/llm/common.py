"""Tables, shared storage and small numeric tools of the operators."""

from __future__ import annotations

import atexit
import ctypes
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: White space that separates words; everything else is part of a word.
WORD = r"[^\x20\x09-\x0D]+"
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
#: What holds while a table is stored. Batches that Python gets are bounded by their
#: bytes, as so many rows of long texts would fill memory on both sides.
STORING = {CLEANUP: "true", BATCH: str(8 << 20)}
_kept: list[tuple[SparkSession, str]] = []
_to_the_end: list[tuple[SparkSession, str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. On a single
    machine, as in tests, it may be unset, and a folder of our own is taken."""
    set_to = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not set_to:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir is unset: executors and driver need a folder that all of them share")
        set_to = tempfile.mkdtemp(prefix="loomgraph-")
        spark.conf.set("spark.checkpoint.dir", f"file://{set_to}")
        set_to = f"file://{set_to}"
    return set_to.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; it is removed by release() or at exit."""
    path = f"{shared_dir(spark)}/loomgraph/{uuid.uuid4().hex}-{name}"
    _kept.append((spark, path))
    return path


def until_exit(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder that release() leaves alone."""
    path = f"{shared_dir(spark)}/loomgraph/{uuid.uuid4().hex}-{name}"
    _to_the_end.append((spark, path))
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: this cuts the
    lineage and survives the loss of executors. The shuffle files of the job are
    of no more use once the table is written, and go at once."""
    spark = df.sparkSession
    path = scratch(spark, name)
    before = {k: spark.conf.get(k, None) for k in STORING}
    for k, v in STORING.items():
        spark.conf.set(k, v)
    try:
        df.write.parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def mark() -> int:
    """A point in the list of scratch tables, for release()."""
    return len(_kept)


def made_since(point: int) -> list[str]:
    return [path for _, path in _kept[point:]]


def release(spark: SparkSession, paths: list[str]) -> None:
    """Remove these scratch tables. To be called only when every result that reads
    them has been written; other tables stay."""
    for path in paths:
        remove(spark, path)
    gone = set(paths)
    _kept[:] = [k for k in _kept if k[1] not in gone]


@atexit.register
def _at_exit() -> None:
    for spark, path in _kept + _to_the_end:
        try:
            remove(spark, path)
        except Exception:  # noqa: BLE001  the JVM may be gone already
            return


def trim() -> None:
    """Give back what this worker process doesn't need now: the encoder that tasks of
    token ids have left in it, and freed memory that allocators keep."""
    state = sys.modules.get("_loomgraph_worker")
    if state is not None:
        state.encoder = None
    pa.default_memory_pool().release_unused()
    give_back = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's
    if give_back:
        give_back(0)


def lean(run: Callable) -> Callable:
    """run, for mapInPandas, in a worker that keeps nothing from before or after it: a
    worker outlives its tasks, beside a JVM whose memory only grows."""

    def within(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        trim()
        yield from run(frames)
        trim()

    return within


def crc_mod(column: str, n: int) -> Column:
    """crc32 of the column's text, modulo n."""
    return F.crc32(F.col(column).cast("string")) % n


def word_count(text: Column) -> Column:
    """Number of words of a text, 0 for null; without building the words."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def bounded(df: DataFrame, most: int) -> bool:
    """Whether df has at most so many rows; counts no further than that."""
    return df.limit(most + 1).count() <= most


#: Bytes of a table that may be broadcast.
MOST_BROADCAST = 32 << 20


def _width(kind: T.DataType) -> int:
    """Bytes of a value, without those of its texts."""
    return 8 + sum(_width(f.dataType) for f in kind.fields) if isinstance(kind, T.StructType) else 8


def small(df: DataFrame, most: int = MOST_BROADCAST) -> bool:
    """Whether all rows of df, whose columns are numbers or texts, take at most so
    many bytes. df is best a stored table, as this reads it."""
    if any(isinstance(f.dataType, T.ArrayType | T.MapType) for f in df.schema.fields):
        raise ValueError(f"no bound of the size is known for {df.schema.simpleString()}")
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType | T.BinaryType)]
    of = sum((F.coalesce(F.octet_length(t), F.lit(0)) for t in texts), F.lit(0)).cast("long")
    n, size = df.agg(F.count("*"), F.sum(of)).first()
    return n * (16 + _width(df.schema)) + (size or 0) <= most


def sent(df: DataFrame, most: int = MOST_BROADCAST) -> DataFrame:
    """df, to be broadcast if it is small; else a join shuffles it."""
    return F.broadcast(df) if small(df, most) else df


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))
