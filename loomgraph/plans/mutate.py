"""Clauses that write, and statements about indexes and constraints.

A change makes new tables from the old ones and puts them into the graph at the
end of its clause, so later clauses see it. If the statement fails, the tables from
before come back. One statement writes at a time."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.graph import Conflict, Graph, union
from loomgraph.plans.ast import Create, Delete, Merge, Node, Schema, SetProps
from loomgraph.plans.expressions import Expressions, Unknown, col

RESERVED = "__SO_"


def schema(graph: Graph, s: Schema) -> DataFrame:
    a, done = s.args, graph.spark.range(0).select(F.lit("").alias("result"))
    if s.kind == "unique":
        graph.unique.add((a["label"], a["prop"]))
        try:
            graph.check_unique(a["label"], graph.nodes[a["label"]].limit(0) if a["label"] in graph.nodes else graph.spark.range(0))
        except Conflict:
            graph.unique.discard((a["label"], a["prop"]))
            raise
    elif s.kind == "fulltext":
        graph.fulltext[a["name"] or f"{a['label']}_{a['prop']}"] = (a["label"], a["prop"])
    elif s.kind == "vector":
        o = a["options"]
        graph.create_vector_index(a["label"], a["prop"], int(o.get("dimensions", 0)), str(o.get("similarity", "cosine")))
    elif s.kind == "drop index":
        graph.fulltext.pop(a["name"], None)
        for label, prop in [k for k in graph.vectors if f"{k[0]}_{k[1]}" == a["name"]]:
            del graph.vectors[label, prop]
    elif s.kind in ("checkpoint", "optimize") and graph.path:
        if s.kind == "optimize":  # neighbours of a node side by side
            graph.edges = {k: e.repartition("_src").sortWithinPartitions("_src", "_dst") for k, e in graph.edges.items()}
        path = graph.path
        graph.save(path)
        new = Graph.open(graph.spark, path, graph.version)
        graph.nodes, graph.edges, graph.stored = new.nodes, new.edges, new.stored
    # An equality index needs nothing: Parquet statistics prune.
    return done


class Changes:
    """The writes of one statement."""

    def __init__(self, compiler: Any) -> None:
        self.compiler, self.graph = compiler, compiler.graph
        self.before: tuple | None = None

    def clause(self, c: Any, rows: Any) -> Any:
        if self.before is None:
            self.graph.write()
            g = self.graph
            self.before = (dict(g.nodes), dict(g.edges), dict(g.numbers))
        try:
            return getattr(self, type(c).__name__.lower())(c, rows)
        except Exception:
            self.graph.nodes, self.graph.edges, self.graph.numbers = self.before
            self.commit()
            raise

    def commit(self) -> None:
        if self.before is not None:
            self.before = None
            self.graph._writer.release()

    def result(self) -> Any:
        from loomgraph.plans.patterns import Rows

        return Rows(self.graph.spark.range(0).select(F.lit("").alias("result")))

    def rows(self, rows: Any) -> Any:
        """The bindings, written once: what follows changes the tables below."""
        from loomgraph.plans.patterns import Rows
        from loomgraph.sources.storage import kept

        rows = rows or self.compiler.one_row()
        return Rows(kept(rows.df), dict(rows.vars), dict(rows.labels))

    def values(self, props: tuple, rows: Any) -> list:
        e = Expressions(rows.df, rows.vars, self.compiler.params)
        out = []
        for k, x in props:
            v = e.value(x)
            out.append((v.cast("string") if e.type_of(v).typeName() == "void" else v).alias(k))
        return out

    # CREATE

    def node(self, p: Node, rows: Any) -> Any:
        """A new node for each row, bound to its variable."""
        from loomgraph.plans.patterns import Rows, prefixed
        from loomgraph.sources.storage import kept

        if any(x.startswith(RESERVED) for x in p.labels):
            raise ValueError(f"names that start with {RESERVED} are reserved")
        label, name = (p.labels or ("Node",))[0], p.var or f"_n{next(self.compiler.fresh)}"
        keyed = kept(rows.df.withColumn("_row", F.monotonically_increasing_id()))
        body = keyed.select("_row", *self.values(p.props, Rows(keyed, rows.vars, rows.labels)))
        if len(p.labels) > 1 or (label in self.graph.nodes and "_labels" in self.graph.nodes[label].columns):
            body = body.withColumn("_labels", F.array(F.lit(label), *map(F.lit, sorted(p.labels[1:]))))
        old = self.graph.nodes.get(label)
        if old is not None and "_labels" in body.columns and "_labels" not in old.columns:
            self.graph.nodes[label] = old.withColumn("_labels", F.array(F.lit(label)))
        new = self.graph.add_nodes(label, body)
        self.graph.nodes[label] = self.graph.nodes[label].drop("_row")
        if "_labels" not in new.columns:
            new = new.withColumn("_labels", F.array(F.lit(label)))
        df = keyed.join(prefixed(new, name).withColumnRenamed(f"{name}._row", "_r"), F.col("_row") == F.col("_r")).drop("_row", "_r")
        return Rows(kept(df), {**rows.vars, name: "node"}, {**rows.labels, name: frozenset([label])}), name

    def edge(self, rel: Any, a: str, b: str, rows: Any, only_new: bool = False) -> None:
        if len(rel.types) != 1:
            raise ValueError("a new relationship needs one type")
        kind = rel.types[0]
        if kind.startswith(RESERVED):
            raise ValueError(f"names that start with {RESERVED} are reserved")
        if rel.direction == "in":
            a, b = b, a
        body = rows.df.select(col(f"{a}._id").alias("_src"), col(f"{b}._id").alias("_dst"), *self.values(rel.props, rows))
        body = body.where("_src is not null and _dst is not null")
        for s in sorted(rows.labels[a]):
            for d in sorted(rows.labels[b]):
                from loomgraph.graph import KEY_BITS

                own = body
                if len(rows.labels[a]) > 1:
                    own = own.where(F.shiftright("_src", KEY_BITS) == self.graph.numbers[s])
                if len(rows.labels[b]) > 1:
                    own = own.where(F.shiftright("_dst", KEY_BITS) == self.graph.numbers[d])
                old = self.graph.edges.get((s, kind, d))
                if only_new:
                    keys = ["_src", "_dst", *[k for k, _ in rel.props]]
                    own = own.dropDuplicates(keys)
                    if old is not None and set(keys) <= set(old.columns):
                        own = own.join(old.select(*[F.col(f"`{k}`") for k in keys]), keys, "left_anti")
                if len(rows.labels[a]) * len(rows.labels[b]) > 1 and own.isEmpty():
                    continue
                self.graph.add_edges(s, kind, d, own)

    def create(self, c: Create, rows: Any) -> Any:
        rows = self.rows(rows)
        for path in c.paths:
            names = []
            for p in path.parts[::2]:
                if p.var in rows.vars:
                    names.append(p.var)
                else:
                    if not p.labels and p.var is None and len(path.parts) > 1 and not p.props:
                        raise ValueError("the ends of a new relationship must be declared")
                    rows, name = self.node(p, rows)
                    names.append(name)
            for k, rel in enumerate(path.parts[1::2]):
                self.edge(rel, names[k], names[k + 1], rows)
        return rows

    # MERGE

    def merge(self, c: Merge, rows: Any) -> Any:
        from loomgraph.plans.patterns import Rows

        rows = self.rows(rows)
        parts = c.path.parts
        for p in parts[::2]:
            if p.var is None or p.var not in rows.vars:
                rows = self.merge_node(p, rows, c)
        if len(parts) > 1:
            for k in range(1, len(parts), 2):
                self.edge(parts[k], parts[k - 1].var, parts[k + 1].var, rows, only_new=True)
        return Rows(rows.df, rows.vars, rows.labels)

    def merge_node(self, p: Node, rows: Any, c: Merge) -> Any:
        from loomgraph.plans.patterns import Rows, joined, prefixed
        from loomgraph.sources.storage import kept

        if not p.labels:
            raise ValueError("MERGE needs a label")
        label, keys = p.labels[0], [k for k, _ in p.props]
        wanted = kept(rows.df.select(*self.values(p.props, rows)).distinct() if keys else rows.df.limit(1).select(F.lit(1).alias("_any")))
        old = self.graph.nodes.get(label)
        known = old is not None and set(keys) <= set(old.columns)

        def same(a: DataFrame, b: DataFrame):
            out = F.lit(True)
            for k in keys:
                out = out & a[k].eqNullSafe(b[k])
            return out

        there = kept(old.join(wanted, same(old, wanted), "left_semi").select("_id")) if known else None
        missing = kept(wanted.join(old, same(wanted, old), "left_anti") if known else wanted)
        made = None
        if not missing.isEmpty():
            made = self.graph.add_nodes(label, missing.drop("_any")).select("_id")
        for ids, items in ((made, c.on_create), (there, c.on_match)):
            if ids is not None and items:
                bound = Rows(prefixed(self.graph.nodes[label].join(ids, "_id", "left_semi"), p.var or "_v"), {p.var or "_v": "node"}, {p.var or "_v": frozenset([label])})
                self.setprops(SetProps(items), bound)
        name = p.var or f"_n{next(self.compiler.fresh)}"
        t = self.graph.nodes[label]
        table = prefixed(t if "_labels" in t.columns else t.withColumn("_labels", F.array(F.lit(label))), name)
        found = Rows(table, {name: "node"}, {name: frozenset([label])})

        def test(a: DataFrame, b: DataFrame, vars: dict):
            e, out = Expressions(a, rows.vars, self.compiler.params), F.lit(True)
            for k, x in p.props:
                out = out & e.value(x).eqNullSafe(col(f"{name}.{k}"))
            return out

        both = joined(rows, found, "inner", test)
        return Rows(kept(both.df), both.vars, both.labels)

    # SET and DELETE

    def setprops(self, c: SetProps, rows: Any) -> Any:
        from loomgraph.plans.patterns import Rows
        from loomgraph.sources.storage import kept

        rows = self.rows(rows)
        e = Expressions(rows.df, rows.vars, self.compiler.params)
        for var in dict.fromkeys(i[0] for i in c.items):
            kind = rows.vars.get(var)
            if kind not in ("node", "rel"):
                raise Unknown(f"unknown variable {var}")
            items = {p: e.value(x) for v, p, x in c.items if v == var}
            ids = ["_id"] if kind == "node" else ["_src", "_dst", "_type"]
            keys = [col(f"{var}.{i}").alias(f"_k{i}") for i in ids]
            new = rows.df.where(col(f"{var}.{ids[0]}").isNotNull()).select(*keys, *[v.alias(f"_v.{p}") for p, v in items.items()])
            # Of several values for one node, any one: here the greatest.
            new = kept(new.groupBy(*[f"_k{i}" for i in ids]).agg(F.max(F.struct(*[col(f"_v.{p}").alias(p) for p in items])).alias("_v")))
            if kind == "node":
                for label in rows.labels.get(var, frozenset(self.graph.nodes)):
                    self.graph.nodes[label] = self._set(self.graph.nodes[label], new, ["_id"], items)
                    self.graph.check_unique(label, self.graph.nodes[label].limit(0))
            else:
                for (s, t, d), table in list(self.graph.edges.items()):
                    own = new.where(F.col("_k_type") == t)
                    if not own.isEmpty():
                        self.graph.edges[s, t, d] = self._set(table, own, ["_src", "_dst"], items)
            df = rows.df
            for p, v in items.items():
                df = df.withColumn(f"{var}.{p}", v)
            rows = Rows(df, rows.vars, rows.labels)
        return rows

    @staticmethod
    def _set(table: DataFrame, new: DataFrame, ids: list, items: dict) -> DataFrame:
        test = F.lit(True)
        for i in ids:
            test = test & (F.col(i) == F.col(f"_k{i}"))
        out = table.join(new.withColumn("_hit", F.lit(True)), test, "left")
        for p in items:
            old = col(p) if p in table.columns else F.lit(None)
            out = out.withColumn(p, F.when(F.col("_hit"), F.col(f"_v.`{p}`")).otherwise(old))
        return out.drop("_hit", "_v", *[c for c in new.columns if c.startswith("_k")])

    def delete(self, c: Delete, rows: Any) -> Any:
        from loomgraph.sources.storage import kept

        if rows is None:
            raise Unknown(f"unknown variable {c.names[0]}")
        rows = self.rows(rows)
        nodes = [v for v in c.names if rows.vars.get(v) == "node"]
        for v in c.names:
            if rows.vars.get(v) == "rel":
                gone = kept(rows.df.select(*[col(f"{v}.{i}").alias(i) for i in ("_src", "_dst", "_type")]).distinct())
                for (s, t, d), table in list(self.graph.edges.items()):
                    own = gone.where(F.col("_type") == t).drop("_type")
                    self.graph.edges[s, t, d] = table.join(own, ["_src", "_dst"], "left_anti")
            elif v not in nodes:
                raise Unknown(f"unknown variable {v}")
        if nodes:
            gone = kept(union([rows.df.select(col(f"{v}._id").alias("_id")) for v in nodes]).where("_id is not null").distinct())
            for key, table in list(self.graph.edges.items()):
                left = table.join(gone, F.col("_src") == F.col("_id"), "left_anti").join(gone, F.col("_dst") == F.col("_id"), "left_anti")
                if c.detach:
                    self.graph.edges[key] = left
                elif not table.join(gone, (F.col("_src") == F.col("_id")) | (F.col("_dst") == F.col("_id")), "left_semi").isEmpty():
                    raise Conflict("a node that has edges can only be deleted with DETACH")
            for label in {x for v in nodes for x in rows.labels.get(v, frozenset(self.graph.nodes))}:
                self.graph.nodes[label] = self.graph.nodes[label].join(gone, "_id", "left_anti")
        return rows


__all__ = ["Changes", "Conflict", "schema"]
