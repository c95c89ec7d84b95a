"""Tables that are written: intermediate ones, and published versions.

A saved graph is a folder with `data-*`, the tables that each version has written, and
`commits`, in which file N names the tables of version N; those that haven't changed
since the version before stay in its folder. A version is published by renaming
its file, written before under another name, to a number that isn't taken yet: a
reader sees it whole or not at all, and of two writers that have started from the
same version only one can publish the next.
"""

from __future__ import annotations

import atexit
import json
import tempfile
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

_made: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. On a single machine, as in tests, it may
    be unset, and a folder of our own is taken."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir is unset: executors and driver need a folder that all of them share")
        found = f"file://{tempfile.mkdtemp(prefix='loomgraph-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def scratch(spark: SparkSession, name: str = "tables") -> str:
    """A new path in the shared folder that goes when the process ends."""
    path = f"{shared_dir(spark)}/loomgraph-{name}/{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


@atexit.register
def _at_exit() -> None:
    for spark, path in _made:
        try:
            fs, at = _filesystem(spark, path)
            fs.delete(at, True)
        except Exception:  # noqa: BLE001  the JVM may be gone already
            return


def kept(df: DataFrame) -> DataFrame:
    """Write a table to the shared folder and read it back; its lineage is cut. It
    stays as long as the process, as graphs and results may read it."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _filesystem(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def _write_text(spark: SparkSession, path: str, text: str) -> None:
    fs, at = _filesystem(spark, path)
    out = fs.create(at, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def _read_text(spark: SparkSession, path: str) -> str:
    return "\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect())


def versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the versions that have been published, ascending."""
    fs, at = _filesystem(spark, f"{path.rstrip('/')}/commits")
    if not fs.exists(at):
        return []
    names = [f.getPath().getName() for f in fs.listStatus(at)]
    return sorted(int(n) for n in names if n.isdigit())


def _publish(spark: SparkSession, draft: str, target: str) -> bool:
    """Rename, unless the target is there."""
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    path = jvm.org.apache.hadoop.fs.Path
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(path(target).toUri(), spark.sparkContext._jsc.hadoopConfiguration()) if "://" in target else jvm.org.apache.hadoop.fs.FileContext.getFileContext(spark.sparkContext._jsc.hadoopConfiguration())
    options = gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
    try:
        context.rename(path(draft), path(target), options)
    except Py4JJavaError as e:
        if "FileAlreadyExistsException" in str(e.java_exception):
            return False
        raise
    return True


def _place(key: str | tuple) -> str:
    """Where a table lies in the folder of a version: nodes of a label, or edges."""
    return f"nodes/{key}" if isinstance(key, str) else f"edges/{'.'.join(key)}"


def _folders(m: dict) -> dict[str, str]:
    """The folder of each table of a version. Versions of old have one for all."""
    places = [*map(_place, m["nodes"]), *(_place((s, r, d)) for s, r, d, _ in m["edges"])]
    return {p: m.get("at", {}).get(p, m["data"]) for p in places}


def save(graph, path: str) -> int:
    """Publish the graph as a new version in `path`; its number. Tables that are the
    same as in the version that the graph stems from aren't written again. If the
    graph was opened here (or saved here before) and others have published since, that
    is a Conflict and nothing changes."""
    from loomgraph.graph import Conflict

    spark, path = graph.spark, path.rstrip("/")
    known = versions(spark, path)
    base = graph.version if graph.path == path else (known[-1] if known else 0)
    if known and known[-1] != base:
        raise Conflict(f"version {known[-1]} was published since version {base} was opened")
    name, tables = f"data-{uuid.uuid4().hex}", {_place(k): t for k, t in (graph.nodes | graph.edges).items()}
    if len(tables) < len(graph.nodes) + len(graph.edges):
        raise ValueError("two edge tables have the same name in files")
    # A table never changes: every write puts a new one in its place.
    same = graph.stored if known and graph.path == path else {}
    at = {p: same[p][1] if p in same and same[p][0] is t else name for p, t in tables.items()}
    for p, t in tables.items():
        if at[p] == name:
            t.write.parquet(f"{path}/{name}/{p}")
    draft = f"{path}/commits/draft-{uuid.uuid4().hex}"
    _write_text(spark, draft, json.dumps({"data": name, "at": at, **graph.manifest()}))
    if not _publish(spark, draft, f"{path}/commits/{base + 1:012d}"):
        for gone in (draft, f"{path}/{name}"):
            fs, at = _filesystem(spark, gone)
            fs.delete(at, True)
        raise Conflict(f"version {base + 1} was published by another writer")
    graph.path, graph.version = path, base + 1
    graph.stored = {p: (t, at[p]) for p, t in tables.items()}
    return base + 1


def load(spark: SparkSession, path: str, version: int | None = None):
    """A version of a saved graph, the last one by default; an empty graph if nothing
    was saved."""
    from loomgraph.graph import Graph, empty

    path = path.rstrip("/")
    known = versions(spark, path)
    if version is not None and version not in known:
        raise ValueError(f"there is no version {version} in {path}")
    if not known:
        graph = empty(spark)
        graph.path = path
        return graph
    version = known[-1] if version is None else version
    m = json.loads(_read_text(spark, f"{path}/commits/{version:012d}"))
    at = _folders(m)

    def table(key: str | tuple, schema: dict) -> DataFrame:
        return spark.read.schema(T.StructType.fromJson(schema)).parquet(f"{path}/{at[_place(key)]}/{_place(key)}")

    nodes = {x: table(x, s) for x, s in m["nodes"].items()}
    edges = {(s, r, d): table((s, r, d), t) for s, r, d, t in m["edges"]}
    graph = Graph(spark, nodes, edges, m["numbers"])
    graph.stored = {_place(k): (t, at[_place(k)]) for k, t in (nodes | edges).items()}
    graph.unique, graph.path, graph.version = {tuple(x) for x in m["unique"]}, path, version
    graph.fulltext, graph.vectors = {k: tuple(v) for k, v in m["fulltext"].items()}, {(a, b): v for a, b, v in m["vectors"]}
    return graph


def vacuum(spark: SparkSession, path: str, keep: int = 1) -> list[int]:
    """Remove all but the last `keep` versions; the numbers of those removed. Tables
    that a kept version shares with them stay. Not to be called while an old version
    is read."""
    path = path.rstrip("/")
    known = versions(spark, path)
    old = known[:-keep]
    read = {v: json.loads(_read_text(spark, f"{path}/commits/{v:012d}")) for v in known}
    used = {(folder, p) for v in known if v not in old for p, folder in _folders(read[v]).items()}
    for version in old:
        m = read[version]
        unused = [(folder, p) for p, folder in _folders(m).items() if (folder, p) not in used]
        # A folder goes as a whole if none of its tables is used.
        whole = {f for f in {m["data"], *(f for f, _ in unused)} if f not in {f for f, _ in used}}
        for gone in (f"commits/{version:012d}", *sorted(whole), *(f"{f}/{p}" for f, p in unused if f not in whole)):
            fs, at = _filesystem(spark, f"{path}/{gone}")
            fs.delete(at, True)
    return old
