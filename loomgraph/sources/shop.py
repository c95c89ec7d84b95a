"""The test tables as a graph: customers, orders, parts and so on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.graph import Graph, node_id

NODES = {"Region": ("region", "r_", "regionkey"), "Nation": ("nation", "n_", "nationkey"), "Customer": ("customer", "c_", "custkey"), "Supplier": ("supplier", "s_", "suppkey"), "Part": ("part", "p_", "partkey"), "Order": ("orders", "o_", "orderkey"), "Event": ("events", "", "event_id"), "User": (None, "", "user_id"), "Document": ("documents", "", "doc_id"), "Vector": ("embeddings", "", "vec_id")}
NUMBERS = {label: k for k, label in enumerate(NODES)}


def shop(spark: SparkSession, sf_dir: str) -> Graph:
    """The tables of a folder as a graph of their own to write to. Schemas and lists
    of files are read once for each session and folder; all tables are lazy."""
    opened = spark.__dict__.setdefault("_loomgraph_shops", {})
    if sf_dir not in opened:
        opened[sf_dir] = _open(spark, sf_dir)
    return opened[sf_dir].snapshot()


def _open(spark: SparkSession, sf_dir: str) -> Graph:
    tables: dict[str, DataFrame] = {}

    def read(name: str) -> DataFrame:
        if name not in tables:
            tables[name] = spark.read.parquet(f"{sf_dir}/{name}.parquet")
        return tables[name]

    def end(label: str, key: str, alias: str):
        return node_id(NUMBERS[label], F.col(key)).alias(alias)

    nodes = {}
    for label, (name, prefix, key) in NODES.items():
        t = read(name) if name else read("events").select("user_id").distinct()
        # Properties are the columns without their prefix.
        columns = [F.col(c).alias(c.removeprefix(prefix)) for c in t.columns]
        nodes[label] = t.select(node_id(NUMBERS[label], F.col(f"{prefix}{key}")), *columns)
    line = read("lineitem")
    pairs = line.alias("a").join(line.alias("b"), F.expr("a.l_orderkey = b.l_orderkey and b.l_linenumber = a.l_linenumber + 1")).select(F.col("a.l_partkey").alias("x"), F.col("b.l_partkey").alias("y")).distinct()
    facts = [F.col(c).alias(c[2:]) for c in line.columns if c not in ("l_orderkey", "l_partkey")]
    edges = {
        ("Nation", "IN_REGION", "Region"): read("nation").select(end("Nation", "n_nationkey", "_src"), end("Region", "n_regionkey", "_dst")),
        ("Customer", "IN_NATION", "Nation"): read("customer").select(end("Customer", "c_custkey", "_src"), end("Nation", "c_nationkey", "_dst")),
        ("Supplier", "IN_NATION", "Nation"): read("supplier").select(end("Supplier", "s_suppkey", "_src"), end("Nation", "s_nationkey", "_dst")),
        ("Customer", "PLACED", "Order"): read("orders").select(end("Customer", "o_custkey", "_src"), end("Order", "o_orderkey", "_dst")),
        ("Order", "CONTAINS", "Part"): line.select(end("Order", "l_orderkey", "_src"), end("Part", "l_partkey", "_dst"), *facts),
        ("Supplier", "SUPPLIES", "Part"): line.select(end("Supplier", "l_suppkey", "_src"), end("Part", "l_partkey", "_dst")).distinct(),
        ("User", "DID", "Event"): read("events").select(end("User", "user_id", "_src"), end("Event", "event_id", "_dst")),
        ("Part", "NEXT_PART", "Part"): pairs.select(end("Part", "x", "_src"), end("Part", "y", "_dst")),
    }
    return Graph(spark, nodes, edges, NUMBERS)
