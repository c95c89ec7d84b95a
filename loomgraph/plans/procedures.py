"""CALL procedures, and the search functions of expressions."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.operators.search import bm25, match_share, matches
from loomgraph.plans.ast import Call, ListOf, Lit, Param, Procedure, Prop, Var
from loomgraph.plans.expressions import Unknown, col


def constant(compiler: Any, e: Any) -> Any:
    """The value of a literal, a parameter or a list of them."""
    if isinstance(e, Lit):
        return e.value
    if isinstance(e, Param):
        return compiler.params.get(e.name)
    if isinstance(e, ListOf):
        return [constant(compiler, x) for x in e.items]
    raise Unknown("only constants can stand here")


def call_procedure(compiler: Any, p: Procedure) -> Any:
    from loomgraph.plans.patterns import Rows, prefixed

    graph, name = compiler.graph, p.name.lower()
    args = [constant(compiler, a) for a in p.args]
    if name == "db.schema":
        found = Rows(graph.schema_rows(), {"type": "value", "name": "value", "properties": "value"})
    elif name == "db.stats":
        found = Rows(graph.stats(), {"metric": "value", "value": "value"})
    elif name == "db.index.fulltext.createnodeindex":
        index, labels, props = args
        graph.fulltext[index] = (labels[0], props[0])
        found = Rows(graph.spark.range(0).select(F.lit("").alias("name")), {"name": "value"})
    elif name == "db.index.fulltext.querynodes":
        index, query = args
        if index not in graph.fulltext:
            raise Unknown(f"unknown index {index}")
        label, prop = graph.fulltext[index]
        nodes = prefixed(graph.nodes[label].withColumn("_labels", F.array(F.lit(label))) if "_labels" not in graph.nodes[label].columns else graph.nodes[label], "node")
        scores = match_share(graph.nodes[label].select("_id", F.col(f"`{prop}`").alias("text")), query)
        found = Rows(nodes.join(scores, col("node._id") == F.col("_id")).drop("_id"), {"node": "node", "score": "value"}, {"node": frozenset([label])})
    else:
        raise Unknown(f"unknown procedure {p.name}")
    if not p.yields:
        return found
    df, vars, labels = found.df, {}, {}
    for column, alias in p.yields:
        if column not in found.vars:
            raise Unknown(f"{p.name} has no column {column}")
        vars[alias] = found.vars[column]
        if column in found.labels:
            labels[alias] = found.labels[column]
    columns = [col(c).alias(alias if c == column else f"{alias}{c[len(column) :]}") for column, alias in p.yields for c in found.df.columns if c == column or c.startswith(f"{column}.")]
    return Rows(df.select(*columns), vars, labels)


def search_mark(compiler: Any, rows: Any, x: Call, name: str) -> DataFrame:
    """The column of full_text_search(), bm25_score() or hybrid_search()."""
    graph, df = compiler.graph, rows.df
    if x.name == "hybrid_search":
        label, vector, text, query_vector, query, k, *alpha = [constant(compiler, a) for a in x.args]
        found = graph.hybrid_search(label, text, vector, query_vector, query, int(k), alpha[0] if alpha else None)
        listed = F.array_sort(F.collect_list(F.struct("rank", F.col("_id").alias("node_id"), "score")))
        one = found.agg(F.transform(listed, lambda s: F.struct(s["node_id"].alias("node_id"), s["score"].alias("score"), s["rank"].alias("rank"))).alias(name))
        return df.crossJoin(one)
    if x.name == "full_text_search":
        label, prop, query = [constant(compiler, a) for a in x.args]
        var = next((v for v, k in rows.vars.items() if k == "node" and label in rows.labels.get(v, ())), None)
        if var is None or f"{var}.{prop}" not in df.columns:
            return df.withColumn(name, F.lit(False))
        return df.withColumn(name, F.coalesce(matches(col(f"{var}.{prop}"), query) & F.array_contains(col(f"{var}._labels"), label), F.lit(False)))
    target, query = x.args[0], constant(compiler, x.args[1])
    if not (isinstance(target, Prop) and isinstance(target.of, Var)):
        raise Unknown("bm25_score() takes a property")
    var = target.of.name
    # Corpus statistics are those of the whole label, not of the matched rows.
    parts = [graph.nodes[label] for label in rows.labels.get(var, graph.nodes) if target.name in graph.nodes[label].columns]
    if not parts:
        return df.withColumn(name, F.lit(0.0))
    from loomgraph.graph import union

    scores = bm25(union([t.select("_id", F.col(f"`{target.name}`").alias("text")) for t in parts]), query).select(F.col("_id").alias("_k"), F.col("score").alias(name))
    return df.join(scores, col(f"{var}._id") == F.col("_k"), "left").drop("_k").withColumn(name, F.coalesce(name, F.lit(0.0)))
