"""The property graph: node and edge tables, and what to do with them.

A node table has `_id` (unique over all labels: a label's number in the upper 16
bits, the row's key in the lower 48), `_labels` if its nodes have more labels than
the table's own, and a column for each property. An edge table of one (source
label, type, target label) has `_src`, `_dst` and a column for each property.
Parallel edges are rows of their own; `distinct()` folds them.
"""

from __future__ import annotations

import json
import threading
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

KEY_BITS = 48


def node_id(number: int, key: Column, checked: bool = False) -> Column:
    """A node id from the number of its label and its key in the table. A key that
    has no room in it would run into another label's ids; checked: that fails."""
    key = key.cast("long")
    if checked:
        key = F.when(key.isNull() | key.between(0, (1 << KEY_BITS) - 1), key).otherwise(F.raise_error(F.concat(F.lit("node key out of range: "), key.cast("string"))).cast("long"))
    return (key + F.lit(number << KEY_BITS)).alias("_id")


def union(frames: list[DataFrame]) -> DataFrame:
    """All rows; columns that some lack are null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


class Conflict(RuntimeError):
    """Another writer is at work, or a rule of the graph would be broken."""


class Graph:
    def __init__(self, spark: SparkSession, nodes: dict[str, DataFrame], edges: dict[tuple[str, str, str], DataFrame], numbers: dict[str, int] | None = None) -> None:
        self.spark, self.nodes, self.edges = spark, dict(nodes), dict(edges)
        self.numbers = dict(numbers) if numbers else {x: k for k, x in enumerate(nodes)}
        self.unique: set[tuple[str, str]] = set()
        self.fulltext: dict[str, tuple[str, str]] = {}
        self.vectors: dict[tuple[str, str], dict] = {}
        #: Approximate vector indexes of this process.
        self.built: dict[tuple[str, str], object] = {}
        #: Where the graph was opened or saved, and which version it stems from.
        self.path: str | None = None
        self.version = 0
        #: Tables of that version by their place, each with the folder it lies in.
        self.stored: dict[str, tuple[DataFrame, str]] = {}
        self._writer = threading.RLock()

    # Reading

    def cypher(self, text: str, params: dict | None = None) -> DataFrame:
        """Run a statement. Reading is lazy, and gives a DataFrame."""
        from loomgraph.plans.compiler import run

        return run(self, text, params or {})

    execute = cypher

    def batch(self, texts: list[str], params: dict | None = None) -> list[DataFrame]:
        """Several statements as one: others see all of them or none, and if one
        fails, none has happened."""
        lock = self.write()
        try:
            work = self.snapshot()
            out = [work.cypher(t, params) for t in texts]
            self.take(work)
            return out
        finally:
            lock.release()

    def take(self, other: Graph) -> None:
        """Become what the other graph is."""
        self.nodes, self.edges, self.numbers = other.nodes, other.edges, other.numbers
        self.unique, self.fulltext, self.vectors = other.unique, other.fulltext, other.vectors

    def execute_with_timeout(self, text: str, seconds: float, params: dict | None = None) -> list:
        """Collect a statement's rows. After so long its jobs are cancelled, and that
        is a TimeoutError."""
        tag, over = f"loomgraph-{uuid.uuid4().hex}", threading.Event()

        def stop() -> None:
            over.set()
            self.spark.sparkContext.cancelJobsWithTag(tag)

        late = threading.Timer(seconds, stop)
        late.start()
        self.spark.addTag(tag)
        self.spark.sparkContext.addJobTag(tag)
        try:
            return self.cypher(text, params).collect()
        except Exception as e:
            if over.is_set():
                raise TimeoutError(f"not done after {seconds} s") from e
            raise
        finally:
            late.cancel()
            self.spark.removeTag(tag)
            self.spark.sparkContext.removeJobTag(tag)

    def snapshot(self) -> Graph:
        """A graph that later writes to this one don't change: a read transaction."""
        other = Graph(self.spark, self.nodes, self.edges, self.numbers)
        other.unique, other.fulltext, other.vectors = set(self.unique), dict(self.fulltext), {k: dict(v) for k, v in self.vectors.items()}
        other.path, other.version, other.built, other.stored = self.path, self.version, dict(self.built), dict(self.stored)
        return other

    begin_read = snapshot

    def distinct(self) -> Graph:
        """The graph with parallel edges folded into the first of their columns'
        least values."""
        folded = {}
        for key, e in self.edges.items():
            props = [c for c in e.columns if c not in ("_src", "_dst")]
            least = F.min(F.struct(*[F.col(f"`{c}`") for c in props])).alias("p") if props else F.lit(None).alias("p")
            folded[key] = e.groupBy("_src", "_dst").agg(least).select("_src", "_dst", *[F.col(f"p.`{c}`") for c in props])
        other = self.snapshot()
        other.edges = folded
        return other

    def labels(self) -> list[str]:
        return sorted(self.nodes)

    def relationship_types(self) -> list[str]:
        return sorted({t for _, t, _ in self.edges})

    def counts(self) -> tuple[int, int]:
        """Nodes and edges in all."""
        return sum(t.count() for t in self.nodes.values()), sum(t.count() for t in self.edges.values())

    def schema_rows(self) -> DataFrame:
        rows = [("node", x, sorted(c for c in t.columns if c[0] != "_")) for x, t in self.nodes.items()]
        types: dict[str, set] = {}
        for (_, name, _), t in self.edges.items():
            types.setdefault(name, set()).update(c for c in t.columns if c[0] != "_")
        rows += [("relationship", name, sorted(props)) for name, props in types.items()]
        return self.spark.createDataFrame(rows, "type string, name string, properties array<string>")

    def stats(self) -> DataFrame:
        """(metric, value): rows of each table, and in all."""
        parts = [t.agg(F.count("*").alias("value")).select(F.lit(f"nodes.{x}").alias("metric"), "value") for x, t in self.nodes.items()]
        parts += [t.agg(F.count("*").alias("value")).select(F.lit(f"edges.{s}.{r}.{d}").alias("metric"), "value") for (s, r, d), t in self.edges.items()]
        if not parts:
            return self.spark.createDataFrame([], "metric string, value long")
        each = union(parts)
        total = [each.where(F.col("metric").startswith(f"{k}.")).agg(F.coalesce(F.sum("value"), F.lit(0)).alias("value")).select(F.lit(f"total_{k}").alias("metric"), "value") for k in ("nodes", "edges")]
        return union([each, *total])

    def get_node(self, id: int) -> DataFrame:
        """The row of one node, without rows if there is none."""
        for label, number in self.numbers.items():
            if id >> KEY_BITS == number and label in self.nodes:
                return self.nodes[label].where(F.col("_id") == id)
        return self.spark.createDataFrame([], "_id long")

    # Search

    def fulltext_search(self, label: str, prop: str, query: str, limit: int = 10) -> DataFrame:
        from loomgraph.operators.search import bm25_top

        return bm25_top(self.nodes[label].select("_id", F.col(f"`{prop}`").alias("text")), query, limit)

    def fulltext_candidates(self, label: str, prop: str, query: str, every: bool = False) -> DataFrame:
        """`_id` of the nodes whose property holds any, or every, term of a query."""
        from loomgraph.operators.search import matches

        t = self.nodes[label].where(F.col(f"`{prop}`").isNotNull())
        return t.where(matches(F.col(f"`{prop}`"), query, every)).select("_id")

    def vector_search(self, label: str, prop: str, query: list[float], k: int = 10, metric: str | None = None, probes: int | None = None) -> DataFrame:
        """(`_id`, score) of the k nearest. It is exact and reads every vector; with
        probes, it reads so many cells of the index that build_vector_index() made,
        and nodes that were deleted since are left out."""
        from loomgraph.operators.search import vector_top

        known = self.vectors.get((label, prop), {})
        if known.get("dimensions") and len(query) != known["dimensions"]:
            raise ValueError(f"the index has {known['dimensions']} dimensions, the query {len(query)}")
        if probes is not None:
            if (label, prop) not in self.built:
                raise ValueError(f"no index of {label}.{prop} has been built")
            return self.built[label, prop].search(query, k, probes, self.nodes[label])
        metric = metric or known.get("similarity", "cosine")
        return vector_top(self.nodes[label].select("_id", F.col(f"`{prop}`").alias("vector")), query, k, metric)

    def build_vector_index(self, label: str, prop: str, cells: int | None = None) -> object:
        """An approximate index over the vectors that there are now; its insert()
        takes later ones. create_vector_index() says how long they are."""
        from loomgraph.operators.ivf import VectorIndex

        known = self.vectors[label, prop]
        vectors = self.nodes[label].select("_id", F.col(f"`{prop}`").alias("vector"))
        self.built[label, prop] = VectorIndex(vectors, known["dimensions"], known["similarity"], cells)
        return self.built[label, prop]

    def hybrid_search(self, label: str, text: str, vector: str, query_vector: list[float], query: str, k: int = 10, alpha: float | None = None) -> DataFrame:
        from loomgraph.operators.search import hybrid

        return hybrid(self.fulltext_search(label, text, query, 2 * k), self.vector_search(label, vector, query_vector, 2 * k), k, alpha)

    def top_degree_nodes(self, label: str, limit: int) -> DataFrame:
        from loomgraph.operators.degree import top_degree

        return top_degree(self, label, limit)

    # Writing: every change makes new tables, and takes effect at once.

    def merge_node_by_property(self, label: str, key: str, value: object, properties: dict | None = None) -> int:
        """The id of the node of this label with that property, which gets the other
        properties; a new node if there is none. Of several nodes with the property
        all are changed, and the least id is returned."""
        names = [key, *(properties or {})]
        if not all(n.isidentifier() for n in [label, *names]):
            raise ValueError(f"not names: {label}, {names}")
        values = {f"p{k}": v for k, v in enumerate([value, *(properties or {}).values()])}
        sets = ", ".join(f"n.{n} = $p{k}" for k, n in enumerate(names) if k)
        on = f" ON CREATE SET {sets} ON MATCH SET {sets}" if sets else ""
        self.cypher(f"MERGE (n:{label} {{{key}: $p0}}){on}", values)
        return self.nodes[label].where(F.col(f"`{key}`") == F.lit(value)).agg(F.min("_id")).first()[0]

    def set_property(self, id: int, name: str, value: object) -> bool:
        """Set a property of one node; whether there is such a node."""
        label = next((x for x, k in self.numbers.items() if k == id >> KEY_BITS and x in self.nodes), None)
        if label is None or self.nodes[label].where(F.col("_id") == id).isEmpty():
            return False
        if not name.isidentifier():
            raise ValueError(f"not a name: {name}")
        self.cypher(f"MATCH (n:{label}) WHERE id(n) = $id SET n.{name} = $value", {"id": id, "value": value})
        return True

    def create_fulltext_index(self, name: str, label: str, prop: str) -> None:
        """Name a property for full-text search. What is added to the label later is
        found too: the search reads the table."""
        self.fulltext[name] = (label, prop)

    def write(self):
        """The one writer's lock; another thread that wants to write is turned away."""
        if not self._writer.acquire(blocking=False):
            raise Conflict("another writer is at work")
        return self._writer

    def add_nodes(self, label: str, rows: DataFrame) -> DataFrame:
        """Append rows of properties (and `_labels`) as nodes and return them with
        their `_id`. Keys continue after the highest one there is."""
        number = self.numbers.setdefault(label, max(self.numbers.values(), default=-1) + 1)
        old = self.nodes.get(label)
        last = None if old is None else old.agg(F.max("_id")).first()[0]
        start = 0 if last is None else last - (number << KEY_BITS) + 1
        # Consecutive numbers from the sizes of the partitions: no global sort.
        rows = rows.persist()
        sizes = {r[0]: r[1] for r in rows.groupBy(F.spark_partition_id()).count().collect()}
        base, at = {}, start
        for part in sorted(sizes):
            base[part] = at
            at += sizes[part]
        offset = F.create_map(*[F.lit(x) for kv in base.items() for x in kv]) if base else F.create_map(F.lit(0), F.lit(0))
        mono = F.monotonically_increasing_id()
        new = rows.withColumn("_m", mono)
        new = new.withColumn("_id", F.lit(number << KEY_BITS) + offset[F.shiftright("_m", 33).cast("int")] + F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))).drop("_m")
        new = self._durable(new)
        rows.unpersist()
        self.check_unique(label, new)
        self.nodes[label] = new if old is None else union([old, new])
        return new

    def check_unique(self, label: str, new: DataFrame) -> None:
        for name, prop in self.unique:
            if name != label or prop not in new.columns:
                continue
            both = new.select(prop) if label not in self.nodes or prop not in self.nodes[label].columns else union([self.nodes[label].select(prop), new.select(prop)])
            if both.where(F.col(prop).isNotNull()).groupBy(prop).count().where("count > 1").limit(1).count():
                raise Conflict(f"{label}.{prop} must be unique")

    def add_edges(self, src: str, kind: str, dst: str, rows: DataFrame) -> None:
        rows = self._durable(rows)
        old = self.edges.get((src, kind, dst))
        self.edges[src, kind, dst] = rows if old is None else union([old, rows])

    def _durable(self, rows: DataFrame) -> DataFrame:
        """New rows are written once, so that reading them again gives the same."""
        from loomgraph.sources.storage import kept

        return kept(rows)

    def save(self, path: str) -> int:
        """Publish a version: write the tables that have changed to a new folder, then
        name all of them in one small file. A Conflict if others have published since
        this graph was opened."""
        from loomgraph.sources.storage import save

        return save(self, path)

    @staticmethod
    def open(spark: SparkSession, path: str, version: int | None = None) -> Graph:
        """A published version, the last one by default."""
        from loomgraph.sources.storage import load

        return load(spark, path, version)

    def create_vector_index(self, label: str, prop: str, dimensions: int, similarity: str = "cosine") -> None:
        if similarity not in ("cosine", "dot", "euclidean"):
            raise ValueError(f"unknown similarity {similarity}")
        self.vectors[label, prop] = {"dimensions": dimensions, "similarity": similarity}

    def manifest(self) -> dict:
        return {
            "numbers": self.numbers, "unique": sorted(map(list, self.unique)), "fulltext": self.fulltext, "vectors": [[*k, v] for k, v in self.vectors.items()],
            "nodes": {x: json.loads(t.schema.json()) for x, t in self.nodes.items()}, "edges": [[*k, json.loads(t.schema.json())] for k, t in self.edges.items()],
        }


def empty(spark: SparkSession) -> Graph:
    return Graph(spark, {}, {})


NODE = T.StructType([T.StructField("_id", T.LongType())])
EDGE = T.StructType([T.StructField("_src", T.LongType()), T.StructField("_dst", T.LongType())])
