"""From patterns to joins.

A path is compiled by itself to a table with columns `var.prop`; tables of paths
that share variables are joined on node ids, others are crossed. A node table is
joined only if its properties or a label that the edge tables don't imply are
needed: an edge's ends exist, so ids alone come from the edges."""

from __future__ import annotations

import itertools
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph.graph import Graph, union
from loomgraph.operators.paths import expand, reach
from loomgraph.plans.ast import Call, Lit, Node, Path, Prop, Rel, Shortest, Var, walk
from loomgraph.plans.expressions import TIMES, Expressions, col

#: Hops of a variable-length relationship without an upper bound.
MOST_HOPS = 10


@dataclass
class Rows:
    """A table of bindings; vars: node, rel, value, path or hops."""

    df: DataFrame
    vars: dict[str, str] = field(default_factory=dict)
    labels: dict[str, frozenset] = field(default_factory=dict)


@dataclass
class Needs:
    """What of the variables expressions look at: single properties, all of it, or
    just whether it is there, which is enough for count()."""

    columns: set[str] = field(default_factory=set)
    whole: set[str] = field(default_factory=set)
    counted: set[str] = field(default_factory=set)

    def add(self, tree: Any) -> Needs:
        if isinstance(tree, Prop) and isinstance(tree.of, Var):
            self.columns.add(f"{tree.of.name}.{tree.name}")
        elif isinstance(tree, Call) and tree.name == "count" and not tree.distinct and tree.args and isinstance(tree.args[0], Var):
            self.counted.add(tree.args[0].name)
        elif isinstance(tree, Var):
            self.whole.add(tree.name)
        else:
            if isinstance(tree, Node | Rel | Path) and tree.var:
                self.whole.add(tree.var)
            for x in tree if isinstance(tree, tuple | list) else [getattr(tree, f) for f in getattr(tree, "__dataclass_fields__", ())]:
                self.add(x)
        return self


#: Values that group by what they are; doubles would lose the sign of a zero.
PLAIN = (T.ByteType(), T.ShortType(), T.IntegerType(), T.LongType(), T.StringType(), T.BooleanType(), T.DateType(), T.TimestampType())


def folded(rows: Rows, needs: Needs, keys: set[str]) -> Rows:
    """Rows that are alike in all that is looked at later become one, with their
    number. Nothing is done where every node's id is kept. keys: variables that
    later joins need."""
    kept, lost = [], False
    for v, kind in rows.vars.items():
        id = {"node": f"{v}._id", "rel": f"{v}._src"}.get(kind, v)
        own = [c for c in rows.df.columns if c == v or c.startswith(f"{v}.")]
        keep = [c for c in own if v in needs.whole or c in needs.columns or (v in keys and c == id)]
        kept += [col(c) for c in keep]
        if v in needs.counted and id in own and id not in keep:
            kept.append(F.when(col(id).isNotNull(), F.lit(0)).cast("long").alias(id))
        lost = lost or (kind == "node" and id in own and id not in keep)
    mine = {c for v in rows.vars for c in rows.df.columns if c == v or c.startswith(f"{v}.")} | {TIMES}
    kept += [col(c) for c in rows.df.columns if c not in mine]
    df = rows.df.select(*kept, F.col(TIMES) if TIMES in rows.df.columns else F.lit(1).cast("long").alias(TIMES))
    if not lost or not all(f.dataType in PLAIN for f in df.schema):
        return rows
    by = [col(c) for c in df.columns if c != TIMES]
    out = df.groupBy(*by).agg(F.sum(TIMES).alias(TIMES)) if by else df.agg(F.sum(TIMES).alias(TIMES)).where(F.col(TIMES) > 0)
    return Rows(out, rows.vars, rows.labels)


def legs(paths: tuple) -> tuple:
    """Paths cut at nodes into which both neighbours point, where many meet many:
    as comma patterns, both legs can be folded. Paths that hold a property stay
    whole: it may leave few rows, which are better joined as they are."""
    out = []
    for i, p in enumerate(paths):
        parts, start = list(p.parts), 0
        if p.var is None and all(isinstance(x, Node | Rel) and not x.props for x in parts) and not any(x.hops for x in parts[1::2]):
            for k in range(2, len(parts) - 1, 2):
                if parts[k - 1].direction == "out" and parts[k + 1].direction == "in":
                    parts[k] = parts[k] if parts[k].var else replace(parts[k], var=f"_leg{i}_{k}")
                    out.append(Path(tuple(parts[start : k + 1])))
                    start = k
        out.append(Path(tuple(parts[start:]), p.var))
    return tuple(out)


def prefixed(df: DataFrame, var: str) -> DataFrame:
    return df.select(*[F.col(f"`{c}`").alias(f"{var}.{c}") for c in df.columns])


class Patterns:
    def __init__(self, graph: Graph, props: set[str] | None, distinct: bool) -> None:
        """props: names of properties that the statement mentions, None for all;
        distinct: whether only distinct ends of long paths matter."""
        self.graph, self.props, self.distinct = graph, props, distinct
        self.fresh = itertools.count()

    # Nodes

    def candidates(self, labels: tuple) -> frozenset:
        """Tables whose nodes may have all these labels."""
        if not labels:
            return frozenset(self.graph.nodes)
        return frozenset(x for x, t in self.graph.nodes.items() if set(labels) <= {x} or "_labels" in t.columns)

    def implied(self, labels: tuple, tables: frozenset) -> bool:
        """Whether every node of these tables has the labels anyhow."""
        return all(set(labels) <= {x} for x in tables)

    def scan(self, var: str, labels: tuple, tables: frozenset) -> DataFrame:
        parts = []
        for x in sorted(tables):
            t = self.graph.nodes[x]
            if "_labels" in t.columns:
                if set(labels) - {x}:
                    t = t.where(F.forall(F.array(*map(F.lit, labels)), lambda y: F.array_contains(F.col("_labels"), y)))
            elif set(labels) - {x}:
                continue
            else:
                t = t.withColumn("_labels", F.array(F.lit(x)))
            keep = [c for c in t.columns if c[0] == "_" or self.props is None or c in self.props]
            parts.append(t.select(*[F.col(f"`{c}`") for c in keep]))
        if not parts:
            parts = [self.graph.spark.createDataFrame([], "_id long, _labels array<string>")]
        return prefixed(union(parts), var)

    # Relationships

    def edge_table(self, var: str, rel: Rel, a: frozenset, b: frozenset) -> tuple[DataFrame, frozenset, frozenset]:
        """Rows (`_from`, `_to`, var.*) in the direction of travel, and the tables
        that both ends can be in."""
        parts, left, right = [], set(), set()
        for (s, kind, d), t in sorted(self.graph.edges.items(), key=lambda x: x[0]):
            if rel.types and kind not in rel.types:
                continue
            keep = [c for c in t.columns if c[0] != "_" and (self.props is None or c in self.props)]
            own = t.select("_src", "_dst", F.lit(kind).alias("_type"), *[F.col(f"`{c}`") for c in keep])
            forth = rel.direction in ("out", "both") and s in a and d in b
            back = rel.direction in ("in", "both") and s in b and d in a
            if forth:
                parts.append(own.select(F.col("_src").alias("_from"), F.col("_dst").alias("_to"), "*"))
                left.add(s), right.add(d)
            if back:
                # A loop is the same edge in both directions.
                turned = own.where("_src != _dst") if forth else own
                parts.append(turned.select(F.col("_dst").alias("_from"), F.col("_src").alias("_to"), "*"))
                left.add(d), right.add(s)
        if not parts:
            return self.graph.spark.createDataFrame([], f"_from long, _to long, `{var}._src` long, `{var}._dst` long, `{var}._type` string"), frozenset(), frozenset()
        e = union(parts)
        return e.select("_from", "_to", *[F.col(f"`{c}`").alias(f"{var}.{c}") for c in e.columns if c not in ("_from", "_to")]), frozenset(left), frozenset(right)

    # Paths

    def path(self, path: Path, bound: Rows, params: dict, conditions: list) -> Rows:
        """One path as a table. Inline properties that need other variables, and
        ends that were bound before, are added to conditions."""
        parts = path.parts
        if isinstance(parts[0], Shortest):
            raise ValueError("shortestPath() stands in expressions; give it to RETURN or WHERE")
        names = [p.var or f"_{next(self.fresh)}" for p in parts]
        # A path of nodes bound before starts from their ids, not from all nodes.
        tables = []
        for k in range(0, len(parts), 2):
            known = bound.labels.get(names[k])
            own = self.candidates(parts[k].labels)
            tables.append(own & known if known else own)
        edges: dict[int, DataFrame] = {}
        for k in range(1, len(parts), 2):  # narrow the tables by the edges, both ways
            rel = parts[k]
            if rel.hops is None:
                _, left, right = self.edge_table(names[k], rel, tables[k // 2], tables[k // 2 + 1])
                tables[k // 2], tables[k // 2 + 1] = tables[k // 2] & left, tables[k // 2 + 1] & right
        for k in range(1, len(parts), 2):
            if parts[k].hops is None:
                edges[k], _, _ = self.edge_table(names[k], parts[k], tables[k // 2], tables[k // 2 + 1])

        seen: dict[str, int] = {}
        vars: dict[str, str] = {}
        labels: dict[str, frozenset] = {}
        df: DataFrame | None = None

        def node(k: int, at: str | None) -> None:
            """Join node k; at: the column of its id, None for the first one."""
            nonlocal df
            name, p, own = names[k], parts[k], tables[k // 2]
            if name in seen:
                df = df.where(col(at) == col(f"{name}._id")).drop(at)
                return
            seen[name], vars[name], labels[name] = k, "node", own
            if at is not None and self.bare(name, p, own, bound):
                df = df.withColumnRenamed(at, f"{name}._id")
            else:
                # Bound before: its properties come with the join on its id.
                table = self.scan(name, p.labels, own)
                if name in bound.vars and not (p.labels and not self.implied(p.labels, own)):
                    table = table.select(col(f"{name}._id"))
                if at is None:
                    df = table
                else:
                    df = df.join(table, col(at) == col(f"{name}._id")).drop(at)
            if name in bound.vars:
                # Only the id stays; the rest is bound already.
                extra = [c for c in df.columns if c.startswith(f"{name}.") and c != f"{name}._id"]
                df = df.drop(*extra)
            self.inline(name, p.props, Rows(df, vars), bound, params, conditions)

        if len(parts) > 1 and self.bare(names[0], parts[0], tables[0], bound) and parts[1].hops is None:
            df = edges[1].withColumnRenamed("_from", f"{names[0]}._id").withColumnRenamed("_to", "_at2")
            seen[names[0]], vars[names[0]], labels[names[0]] = 0, "node", tables[0]
            self.inline(names[0], parts[0].props, Rows(df, vars), bound, params, conditions)
            self.bind_rel(names[1], parts[1], vars, Rows(df, vars), bound, params, conditions)
            node(2, "_at2")
            rest = 3
        else:
            node(0, None)
            rest = 1
        for k in range(rest, len(parts), 2):
            rel, name = parts[k], names[k]
            # Constant inline properties cut the start before anything grows.
            df = self.early(df, vars, conditions, params)
            if rel.hops is None:
                e = edges[k].withColumnRenamed("_to", f"_at{k + 1}")
                if name in vars or name in bound.vars:
                    raise ValueError(f"relationship {name} is bound twice")
                df = df.join(e, col(f"{names[k - 1]}._id") == col("_from")).drop("_from")
                self.bind_rel(name, rel, vars, Rows(df, vars), bound, params, conditions)
            else:
                df = self.long(df, names[k - 1], rel, name, k, tables, bound)
                vars[name] = "path"
            node(k + 1, f"_at{k + 1}")
        df = self.early(df, vars, conditions, params)
        if path.var:
            df = df.withColumn(path.var, self.nodes_of(names, parts))
            vars[path.var] = "path"
        return Rows(df, vars, labels)

    def bare(self, name: str, p: Node, own: frozenset, bound: Rows) -> bool:
        """Whether a node's id is enough."""
        if p.labels and not self.implied(p.labels, own):
            return False
        if name in bound.vars:
            return True
        return not self.wanted(name) and not p.props

    def wanted(self, name: str) -> bool:
        return self.used is None or name in self.used

    used: set[str] | None = None

    def bind_rel(self, name: str, rel: Rel, vars: dict, rows: Rows, bound: Rows, params: dict, conditions: list) -> None:
        vars[name] = "rel"
        self.inline(name, rel.props, rows, bound, params, conditions)

    def inline(self, name: str, props: tuple, rows: Rows, bound: Rows, params: dict, conditions: list) -> None:
        from loomgraph.plans.ast import Op

        for key, expr in props:
            if isinstance(expr, Lit) and expr.value is None:
                continue  # a null passes every row
            conditions.append(Op("=", (Prop(Var(name), key), expr)))

    def early(self, df: DataFrame, vars: dict, conditions: list, params: dict) -> DataFrame:
        """Apply the conditions that this table alone can decide."""
        later = []
        for c in conditions:
            names = {x.name for x in walk(c) if isinstance(x, Var)}
            if names <= set(vars):
                df = df.where(Expressions(df, vars, params).condition(c))
            else:
                later.append(c)
        conditions[:] = later
        return df

    def long(self, df: DataFrame, start: str, rel: Rel, name: str, k: int, tables: list, bound: Rows) -> DataFrame:
        """A variable-length step from the ids bound so far."""
        low, high = rel.hops[0], rel.hops[1] if rel.hops[1] is not None else max(MOST_HOPS, rel.hops[0])
        every = frozenset(self.graph.nodes)
        e, _, _ = self.edge_table("_e", Rel(None, rel.types, (), rel.direction), every, every)
        for key, expr in rel.props:
            e = e.where(col(f"_e.{key}") == Expressions(e, {}, {}).value(expr)) if f"_e.{key}" in e.columns else e.where(F.lit(False))
        e = e.select("_from", "_to").distinct()
        starts = df.select(col(f"{start}._id").alias("_s")).distinct()
        only_ends = self.distinct and low <= 1 and rel.var is None
        found = reach(starts, e, low, high) if only_ends else expand(starts, e, low, high)
        goal = self.candidates(()) if k // 2 + 1 >= len(tables) else tables[k // 2 + 1]
        if goal != every:  # ids tell the table
            numbers = [self.graph.numbers[x] for x in goal]
            from loomgraph.graph import KEY_BITS

            found = found.where(F.shiftright("_t", KEY_BITS).isin(numbers)) if numbers else found.where(F.lit(False))
        found = found.select("_s", F.col("_t").alias(f"_at{k + 1}"), *([F.col("_path").alias(name)] if not only_ends else [F.array("_s", "_t").alias(name)]))
        return df.join(found, col(f"{start}._id") == col("_s")).drop("_s")

    def nodes_of(self, names: list, parts: tuple) -> Column:
        """Ids of the nodes along a named path."""
        out = F.array(col(f"{names[0]}._id"))
        for k in range(1, len(parts), 2):
            more = F.array(col(f"{names[k + 1]}._id")) if parts[k].hops is None else F.slice(col(names[k]), F.lit(2), F.greatest(F.size(col(names[k])), F.lit(1)))
            out = F.concat(out, more)
        return out

    # Clauses

    def all(self, paths: tuple, bound: Rows, params: dict, needs: Needs | None = None) -> tuple[Rows, list]:
        """All paths of a clause joined with each other, and the conditions that
        need variables bound before. needs: what the aggregates behind them look at;
        then both sides are folded before each join, as the join of two tables that
        have many rows for a node has as many as their product."""
        conditions: list[Any] = []
        rows: Rows | None = None
        todo = list(paths)
        while todo:
            # Take next a path that shares a variable with what is there.
            names = set(rows.vars) if rows else set()
            k = next((i for i, p in enumerate(todo) if names & {x.var for x in walk(p) if isinstance(x, Node) and x.var}), 0)
            own = self.path(todo.pop(k), bound, params, conditions)
            if rows is not None and needs is not None:
                look = Needs(set(needs.columns), set(needs.whole), set(needs.counted)).add(conditions)
                later = set(bound.vars) | {x.var for x in walk(tuple(todo)) if isinstance(x, Node | Rel) and x.var}
                first, twice = rows.vars, set(rows.vars) & set(own.vars)
                rows = folded(rows, look, later | twice)
                # What both sides have is read from the first.
                there = Needs({c for c in look.columns if c.split(".")[0] not in first}, look.whole - set(first), look.counted - set(first))
                own = folded(own, there, later | twice)
            rows = own if rows is None else joined(rows, own, "inner")
            rows.df = self.early(rows.df, rows.vars, conditions, params)
        return rows, conditions


def joined(left: Rows, right: Rows, how: str, condition: Any = None) -> Rows:
    """Join on the ids of shared nodes (and values of shared variables), and a
    condition that sees both sides."""
    shared = [v for v in right.vars if v in left.vars]
    df = right.df
    both = TIMES in left.df.columns and TIMES in df.columns
    if both:
        df = df.withColumnRenamed(TIMES, f"{TIMES}2")
    on: list[Column] = []
    for v in shared:
        kind = right.vars[v]
        key = f"{v}._id" if kind == "node" else v if kind != "rel" else None
        if key is None:
            raise ValueError(f"relationship {v} is bound twice")
        df = df.withColumnRenamed(key, f"_k.{v}").drop(*[c for c in df.columns if c.startswith(f"{v}.")])
        own = f"{v}._id" if left.vars[v] == "node" else v
        # Optional variables may be null, and null joins nothing.
        on.append(col(own) == col(f"_k.{v}"))
    vars = {**left.vars, **{v: k for v, k in right.vars.items() if v not in left.vars}}
    labels = {**right.labels, **left.labels}
    if condition is not None:
        on.append(condition(left.df, df, vars))
    if not on:
        out = left.df.crossJoin(df) if how == "inner" else left.df.join(df, F.lit(True), how)
    else:
        test = on[0]
        for c in on[1:]:
            test = test & c
        out = left.df.join(df, test, how)
    if how in ("left_semi", "left_anti"):
        return Rows(out, left.vars, left.labels)
    if both:
        out = out.withColumn(TIMES, F.col(TIMES) * F.col(f"{TIMES}2")).drop(f"{TIMES}2")
    return Rows(out.drop(*[f"_k.{v}" for v in shared]), vars, labels)
