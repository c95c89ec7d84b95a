"""Loading graphs from files and writing them out. Everything is read and written
by executors, in parallel, but for file names."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph.graph import KEY_BITS, Graph, union


def _typed(df: DataFrame) -> DataFrame:
    """Texts that are whole numbers, or numbers, in all rows become such columns:
    one pass over the table."""
    names = [c for c, t in df.dtypes if t == "string"]
    if not names:
        return df
    whole, number = r"^[+-]?\d{1,18}$", r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
    tests = [F.coalesce(F.bool_and(F.regexp_like(F.col(f"`{c}`"), F.lit(p))), F.lit(False)).alias(f"{k}{i}") for i, c in enumerate(names) for k, p in (("w", whole), ("n", number))]
    found = df.agg(*tests).first()
    kinds = {c: "bigint" if found[f"w{i}"] else "double" if found[f"n{i}"] else "string" for i, c in enumerate(names)}
    return df.select(*[F.col(f"`{c}`").cast(kinds.get(c, t)).alias(c) for c, t in df.dtypes])


def read_csv(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    return spark.read.csv(path, header=True, sep=sep, escape='"', multiLine=False)


def load_nodes(graph: Graph, path: str, label: str, sep: str = ",", rename: dict | None = None) -> None:
    """Every column of a CSV file becomes a property."""
    df = read_csv(graph.spark, path, sep)
    for old, new in (rename or {}).items():
        df = df.withColumnRenamed(old, new)
    graph.add_nodes(label, _typed(df))


def _resolve(graph: Graph, edges: DataFrame, column: str, label: str, prop: str, alias: str) -> DataFrame:
    ends = graph.nodes[label].select(F.col(prop).cast("string").alias(f"_{alias}"), F.col("_id").alias(alias))
    return edges.join(ends, F.col(f"`{column}`").cast("string") == F.col(f"_{alias}")).drop(f"_{alias}")


def load_edges(graph: Graph, path: str, kind: str, src: str, dst: str, key: str = "id", sep: str = ",", columns: tuple = ("src_id", "dst_id"), keep: bool = True) -> None:
    """The first two columns name the ends by a property; others become properties."""
    df = read_csv(graph.spark, path, sep)
    a, b = columns if columns[0] in df.columns else df.columns[:2]
    if a == b or f"{a}0" in df.columns:
        a, b = df.columns[:2]
    df = _resolve(graph, _resolve(graph, df, a, src, key, "_src"), b, dst, key, "_dst")
    rest = [c for c in df.columns if c not in (a, b, "_src", "_dst")] if keep else []
    graph.add_edges(src, kind, dst, _typed(df.select("_src", "_dst", *[F.col(f"`{c}`") for c in rest])))


def classify(name: str) -> tuple | None:
    """What a file of the benchmark format holds: ("node", kind) for person_0_0,
    ("edge", from, type, to) for person_knows_person_0_0."""
    m = re.fullmatch(r"([a-zA-Z]+(?:_[a-zA-Z]+)*)_\d+_\d+", name.rsplit("/", 1)[-1].removesuffix(".csv"))
    if not m:
        return None
    parts = m[1].split("_")
    if len(parts) == 1:
        return ("node", parts[0])
    return ("edge", *parts) if len(parts) == 3 else None


def _label(kind: str) -> str:
    return {"tagclass": "TagClass"}.get(kind, kind[:1].upper() + kind[1:])


def load_ldbc(graph: Graph, paths: list[str]) -> dict[str, int]:
    """Load pipe-separated files by their names, nodes first; `id` becomes ldbc_id,
    and a type such as hasCreator becomes HAS_CREATOR."""
    kinds = {p: classify(p) for p in paths}
    for p, k in kinds.items():
        if k and k[0] == "node":
            load_nodes(graph, p, _label(k[1]), "|", {"id": "ldbc_id"})
    for p, k in kinds.items():
        if k and k[0] == "edge":
            kind = re.sub(r"(?<=[a-z])(?=[A-Z])", "_", k[2]).upper()
            load_edges(graph, p, kind, _label(k[1]), _label(k[3]), "ldbc_id", "|", keep=False)
    return {"nodes": sum(k is not None and k[0] == "node" for k in kinds.values()), "edges": sum(k is not None and k[0] == "edge" for k in kinds.values()), "skipped": sum(k is None for k in kinds.values())}


def load_apoc(graph: Graph, nodes: str, relationships: str) -> None:
    """Nodes `_id,_labels,...` and relationships `_start,_end,_type,...`. Several
    labels, as in `:Person:Admin`, give a primary one and others."""
    spark = graph.spark
    n = read_csv(spark, nodes).withColumnRenamed("_id", "apoc_id").withColumn("_all", F.filter(F.split("_labels", "[:;]"), lambda x: x != ""))
    many = n.where(F.size("_all") > 1).limit(1).count() > 0
    labels = [r[0] for r in n.select(F.get("_all", F.lit(0)).alias("l")).distinct().collect()]  # one row per label
    for label in sorted(x for x in labels if x):
        own = n.where(F.get("_all", F.lit(0)) == label)
        rest = [c for c in own.columns if c not in ("_labels", "_all")]
        extra = [F.concat(F.array(F.lit(label)), F.array_sort(F.array_remove(F.col("_all"), label))).alias("_labels")] if many else []
        graph.add_nodes(label, _typed(own.select(*[F.col(f"`{c}`") for c in rest])) if not many else _typed(own.select(*[F.col(f"`{c}`") for c in rest], *extra)))
    ends = union([t.select(F.col("apoc_id").cast("string").alias("key"), "_id") for x, t in graph.nodes.items() if "apoc_id" in t.columns])
    r = read_csv(spark, relationships)
    for end, alias in (("_start", "_src"), ("_end", "_dst")):
        r = r.join(ends.select(F.col("key").alias(end), F.col("_id").alias(alias)), end)
    r = r.withColumn("_a", F.shiftright("_src", KEY_BITS)).withColumn("_b", F.shiftright("_dst", KEY_BITS))
    names = {v: k for k, v in graph.numbers.items()}
    for s, t, d in r.select("_a", "_type", "_b").distinct().collect():
        own = r.where((F.col("_a") == s) & (F.col("_type") == t) & (F.col("_b") == d))
        props = [c for c in own.columns if c not in ("_start", "_end", "_type", "_src", "_dst", "_a", "_b")]
        graph.add_edges(names[s], t, names[d], _typed(own.select("_src", "_dst", *[F.col(f"`{c}`") for c in props])))


DUMP_NODE = "node_id long, label string, labels array<string>, properties string"
DUMP_EDGE = "src_id long, dst_id long, rel_type string, src_label string, dst_label string, properties string"


def _props(df: DataFrame) -> Column:
    own = [c for c in df.columns if c[0] != "_"]
    return F.to_json(F.struct(*[F.col(f"`{c}`") for c in own])) if own else F.lit("{}")


def _schemas(spark: SparkSession, path: str) -> dict:
    """Schemas of a dump's tables by name; none if it has no such file."""
    from loomgraph.sources.storage import _filesystem, _read_text

    fs, at = _filesystem(spark, f"{path}/schemas.json")
    return json.loads(_read_text(spark, f"{path}/schemas.json")) if fs.exists(at) else {}


def export_json(graph: Graph, path: str) -> None:
    """Folders of JSON lines: nodes (node_id, label, labels, properties) and edges
    (src_id, dst_id, rel_type, properties); and schemas.json, the types of them."""
    from loomgraph.sources.storage import _write_text

    schemas = {f"node {x}": json.loads(t.schema.json()) for x, t in graph.nodes.items()} | {f"edge {s} {r} {d}": json.loads(t.schema.json()) for (s, r, d), t in graph.edges.items()}
    _write_text(graph.spark, f"{path}/schemas.json", json.dumps(schemas))
    for x, t in graph.nodes.items():
        labels = F.col("_labels") if "_labels" in t.columns else F.array(F.lit(x))
        t.select(F.col("_id").alias("node_id"), F.lit(x).alias("label"), labels.alias("labels"), _props(t).alias("properties")).write.mode("append").json(f"{path}/nodes")
    for (s, r, d), t in graph.edges.items():
        t.select(F.col("_src").alias("src_id"), F.col("_dst").alias("dst_id"), F.lit(r).alias("rel_type"), F.lit(s).alias("src_label"), F.lit(d).alias("dst_label"), _props(t).alias("properties")).write.mode("append").json(f"{path}/edges")


def import_json(spark: SparkSession, path: str) -> Graph:
    """The inverse of export_json(): ids stay."""

    known = _schemas(spark, path)

    def opened(df: DataFrame, name: str) -> DataFrame:
        kept = [c for c in df.columns if c[0] == "_"]
        if name in known:
            schema = T.StructType([f for f in T.StructType.fromJson(known[name]).fields if f.name[0] != "_"])
            body = df.withColumn("_p", F.from_json("properties", schema))
            return body.select(*kept, *[F.col(f"_p.`{c}`").alias(c) for c in schema.fieldNames()])
        # A dump of another hand: the names of its properties, one row for each.
        body = df.withColumn("_p", F.from_json("properties", "map<string,string>"))
        names = sorted(r[0] for r in body.select(F.explode(F.map_keys("_p"))).distinct().collect())
        return _typed(body.select(*kept, *[F.col("_p")[c].alias(c) for c in names]))

    n = spark.read.schema(DUMP_NODE).json(f"{path}/nodes")
    nodes, numbers = {}, {}
    for label, number in sorted((r[0], r[1]) for r in n.groupBy("label").agg(F.min(F.shiftright("node_id", KEY_BITS))).collect()):
        numbers[label] = number
        nodes[label] = opened(n.where(F.col("label") == label).select(F.col("node_id").alias("_id"), F.col("labels").alias("_labels"), "properties"), f"node {label}")
    edges = {}
    try:
        e = spark.read.schema(DUMP_EDGE).json(f"{path}/edges")
        kinds = [tuple(r) for r in e.select("src_label", "rel_type", "dst_label").distinct().collect()]
    except Exception as x:  # noqa: BLE001  a graph without edges has no such folder
        if "PATH_NOT_FOUND" not in str(x):
            raise
        kinds = []
    for s, r, d in sorted(kinds):
        own = e.where((F.col("src_label") == s) & (F.col("rel_type") == r) & (F.col("dst_label") == d))
        edges[s, r, d] = opened(own.select(F.col("src_id").alias("_src"), F.col("dst_id").alias("_dst"), "properties"), f"edge {s} {r} {d}")
    return Graph(spark, nodes, edges, numbers)


def dot_lines(graph: Graph) -> DataFrame:
    """The lines of a Graphviz digraph, unordered but for the braces around them."""

    def quoted(x: Column) -> Column:
        return F.concat(F.lit('"'), F.regexp_replace(F.regexp_replace(x, r"\\", r"\\\\"), '"', r'\\"'), F.lit('"'))

    parts = [graph.spark.range(1).select(F.lit("digraph graph_ {").alias("value"))]
    for x, t in graph.nodes.items():
        named = F.coalesce(F.col("name").cast("string"), F.lit(x)) if "name" in t.columns else F.lit(x)
        parts.append(t.select(F.concat(F.lit("  n"), F.col("_id"), F.lit(" [label="), quoted(F.concat(F.lit(f"{x}: "), named)), F.lit("];")).alias("value")))
    for (_, r, _), t in graph.edges.items():
        parts.append(t.select(F.concat(F.lit("  n"), F.col("_src"), F.lit(" -> n"), F.col("_dst"), F.lit(" [label="), quoted(F.lit(r)), F.lit("];")).alias("value")))
    return union([*parts, graph.spark.range(1).select(F.lit("}").alias("value"))])


def export_dot(graph: Graph, path: str) -> None:
    """The digraph as text files; the first and the last part hold the braces."""
    dot_lines(graph).write.text(path)


MOST_EXACT = 2**53 - 1


def result_json(df: DataFrame) -> DataFrame:
    """One JSON text (`value`) per row; whole numbers that a double cannot hold
    become texts."""
    columns = []
    for c, t in df.dtypes:
        x = F.col(f"`{c}`")
        if t == "bigint":
            big = F.abs(x) > MOST_EXACT
            columns.append(F.when(big, x.cast("string")).alias(f"{c}\0s"))
            columns.append(F.when(~big, x).alias(c))
        else:
            columns.append(x.alias(c))
    # Exactly one of the two columns of a number is not null.
    text = F.to_json(F.struct(*columns))
    return df.select(F.replace(text, F.lit("\\u0000s"), F.lit("")).alias("value"))
