"""From statements to DataFrames: each clause is a step from a table of bindings
to the next."""

from __future__ import annotations

import itertools
from dataclasses import replace
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph.graph import KEY_BITS, Graph, union
from loomgraph.operators.degree import degrees
from loomgraph.operators.paths import shortest
from loomgraph.plans import mutate
from loomgraph.plans.ast import (
    Call, Create, Delete, Exists, Item, Lit, Match, Merge, Node, Op, Procedure, Projection, Prop, Query, Rel, Return, Schema, SetProps, Shortest,
    Subquery, Union, Unwind, Var, With, walk,
)
from loomgraph.plans.expressions import AGGREGATES, Expressions, Unknown, col, literal
from loomgraph.plans.parser import parse
from loomgraph.plans.patterns import MOST_HOPS, Needs, Patterns, Rows, joined, legs
from loomgraph.plans.procedures import call_procedure

#: Functions whose value differs from row to row.
SINGLE = {"rand", "random"}


def run(graph: Graph, text: str, params: dict) -> DataFrame:
    tree = parse(text)
    if isinstance(tree, Schema):
        return mutate.schema(graph, tree)
    return Compiler(graph, tree, params).statement(tree).df


def is_aggregate(e: Any) -> bool:
    return any(isinstance(x, Call) and x.name in AGGREGATES for x in walk(e))


def conjuncts(e: Any) -> list:
    if isinstance(e, Op) and e.name == "AND":
        return [y for x in e.args for y in conjuncts(x)]
    return [] if e is None else [e]


def rewritten(e: Any, swap: dict) -> Any:
    """The tree with some subtrees replaced."""
    if any(e == k and type(e) is type(k) for k in swap):
        return swap[e]
    if isinstance(e, tuple):
        return tuple(rewritten(x, swap) for x in e)
    if hasattr(e, "__dataclass_fields__") and not isinstance(e, Item):
        return replace(e, **{f: rewritten(getattr(e, f), swap) for f in e.__dataclass_fields__})
    return e


class Compiler:
    def __init__(self, graph: Graph, tree: Any, params: dict) -> None:
        self.graph, self.params, self.fresh = graph, params, itertools.count()
        everything = list(walk(tree))
        props = {x.name for x in everything if isinstance(x, Prop)} | {k for x in everything if isinstance(x, Node | Rel) for k, _ in x.props}
        props |= {p for x in everything if isinstance(x, SetProps | Merge) for p in self._set_names(x)}
        for x in everything:  # arguments of searches name properties as texts
            if isinstance(x, Call) and x.name in ("full_text_search", "hybrid_search", "bm25_score"):
                props |= {a.value for a in x.args if isinstance(a, Lit) and isinstance(a.value, str)}
        whole = self._whole(tree)
        self.patterns = Patterns(graph, None if whole else props, self._only_ends(tree))
        self.patterns.used = None if whole else self._used(everything)

    @staticmethod
    def _set_names(x: Any) -> set:
        return {i[1] for i in (x.items if isinstance(x, SetProps) else x.on_create + x.on_match)}

    @staticmethod
    def _whole(tree: Any) -> bool:
        """Whether a node or relationship is asked for with all its properties: a
        bare variable in a projection, or properties(), keys(). What a WITH only
        hands on doesn't count."""
        for x in walk(tree):
            if isinstance(x, Return) and (x.body.star or any(isinstance(i.expr, Var) for i in x.body.items)):
                return True
            if isinstance(x, Call) and (x.name in ("properties", "keys") or (x.name in ("collect", "head", "last", "coalesce") and any(isinstance(a, Var) for a in x.args))):
                return True
        return False

    @staticmethod
    def _used(everything: list) -> set:
        """Variables of which more than the id is needed."""
        out = {x.of.name for x in everything if isinstance(x, Prop) and isinstance(x.of, Var)}
        out |= {a.name for x in everything if isinstance(x, Call) and x.name not in ("id", "count") for a in x.args if isinstance(a, Var)}
        # A variable may be handed on under another name, with its properties.
        return out | {i.expr.name for x in everything if isinstance(x, With | Return) for i in x.body.items if isinstance(i.expr, Var)}

    @staticmethod
    def _only_ends(tree: Any) -> bool:
        """One MATCH and RETURN DISTINCT without aggregates: how often an end is
        reached doesn't matter."""
        return isinstance(tree, Query) and len(tree.clauses) == 2 and isinstance(tree.clauses[0], Match) and isinstance(tree.clauses[1], Return) and tree.clauses[1].body.distinct and not is_aggregate(tree.clauses[1].body.items) and not any(p.var for p in tree.clauses[0].paths)

    # Statements

    def one_row(self) -> Rows:
        return Rows(self.graph.spark.range(1).select(F.lit(0).alias("_one")))

    def statement(self, tree: Any, seed: Rows | None = None, keys: tuple = ()) -> Rows:
        if isinstance(tree, Union):
            a, b = self.statement(tree.left, seed, keys), self.statement(tree.right, seed, keys)
            if len(a.df.columns) != len(b.df.columns):
                raise ValueError("both sides of UNION need as many columns")
            both = a.df.union(b.df)
            return Rows(both if tree.all else both.distinct(), a.vars, a.labels)
        rows, changes = seed, mutate.Changes(self)
        for clause, after in zip(tree.clauses, (*tree.clauses[1:], None), strict=True):
            needs = self.needs(clause, after)
            rows = self.clause(clause, rows, keys, changes) if needs is None else self.match(clause, rows, needs)
        changes.commit()
        if not isinstance(tree.clauses[-1], Return | Procedure):
            return changes.result()
        return rows

    def clause(self, c: Any, rows: Rows | None, keys: tuple, changes: Any) -> Rows:
        if isinstance(c, Match):
            return self.match(c, rows)
        if isinstance(c, Unwind):
            return self.unwind(c, rows or self.one_row())
        if isinstance(c, With):
            return self.project(c.body, rows or self.one_row(), keys)
        if isinstance(c, Return):
            out = self.project(c.body, rows or self.one_row(), keys)
            return self.shown(out, c.body, keys)
        if isinstance(c, Subquery):
            return self.subquery(c, rows)
        if isinstance(c, Procedure):
            found = call_procedure(self, c)
            return found if rows is None else Rows(rows.df.crossJoin(found.df), {**rows.vars, **found.vars})
        if isinstance(c, Create | Merge | SetProps | Delete):
            return changes.clause(c, rows)
        raise ValueError(f"unknown clause {c}")

    def shown(self, rows: Rows, body: Projection, keys: tuple) -> Rows:
        """The columns of the result, by their names in order."""
        e = Expressions(rows.df, rows.vars, self.params)
        names = list(rows.vars) if body.star else []
        names += [i.name for i in body.items]
        names = [n for n in dict.fromkeys(names)]
        carried = [col(k) for k in keys if k in rows.df.columns]
        columns = [e.value(Var(n)).alias(n) for n in names if not n.startswith("_k:")]
        return Rows(rows.df.select(*columns, *carried), {n: "value" for n in names})

    # MATCH

    def needs(self, m: Any, after: Any) -> Needs | None:
        """What is looked at of the rows of a MATCH that is only aggregated: how often
        a row is there is then a number. None if each row is wanted by itself."""
        if not isinstance(m, Match) or m.optional or not isinstance(after, With | Return) or len(legs(m.paths)) == 1:
            return None
        body, tree = after.body, list(walk((m, after)))
        found = [x for x in tree if isinstance(x, Call) and x.name in AGGREGATES]
        if body.star or not any(is_aggregate(i.expr) for i in body.items) or any(x.name == "collect" and not x.distinct for x in found):
            return None
        if any(isinstance(x, Call) and (x.name in SINGLE or not self._plain_call(x)) for x in tree):
            return None
        if any(x.name in ("sum", "avg") for x in found) and self._decimals({x.name for x in tree if isinstance(x, Prop)}):
            return None  # a product has other digits than a sum
        inline = [e for x in walk(m.paths) if isinstance(x, Node | Rel) for _, e in x.props]
        return Needs().add((m.where, body, inline))

    def _decimals(self, props: set) -> bool:
        tables = [*self.graph.nodes.values(), *self.graph.edges.values()]
        return any(isinstance(f.dataType, T.DecimalType) for t in tables for f in t.schema if f.name in props)

    def match(self, m: Match, rows: Rows | None, needs: Needs | None = None) -> Rows:
        bound = rows or Rows(self.graph.spark.range(0))
        paths = legs(m.paths) if needs is not None and rows is None and m.where is None else m.paths
        found, conditions = self.patterns.all(paths, bound if rows else Rows(bound.df), self.params, needs)
        where = conjuncts(m.where)
        if m.optional:
            left = rows or self.one_row()
            own, mixed = [], []
            for c in where:
                plain = not any(isinstance(x, Exists | Shortest | Call) and not self._plain_call(x) for x in walk(c))
                (own if plain and {x.name for x in walk(c) if isinstance(x, Var)} <= set(found.vars) - set(left.vars) else mixed).append(c)
            for c in own:
                found.df = found.df.where(Expressions(found.df, found.vars, self.params).condition(c))
            tests = conditions + mixed
            if any(isinstance(x, Exists | Shortest | Call) and not self._plain_call(x) for x in walk(tuple(tests))):
                return self.match_by_row(m, left)

            def condition(a: DataFrame, b: DataFrame, vars: dict):
                both = a.crossJoin(b).limit(0)  # for the types alone
                out = F.lit(True)
                for c in tests:
                    out = out & Expressions(both, vars, self.params).condition(c)
                return out

            return joined(left, found, "left", condition if tests else None)
        out = found if rows is None else joined(rows, found, "inner")
        for c in conditions:
            out.df = out.df.where(Expressions(out.df, out.vars, self.params).condition(c))
        return self.filtered(out, where)

    def match_by_row(self, m: Match, left: Rows) -> Rows:
        """OPTIONAL MATCH whose test needs joins of its own: a MATCH of numbered rows,
        which are joined with what it finds by their numbers."""
        from loomgraph.sources.storage import kept

        key = f"_q{next(self.fresh)}"
        numbered = kept(left.df.withColumn(key, F.monotonically_increasing_id()))
        inner = self.match(replace(m, optional=False), Rows(numbered, dict(left.vars), dict(left.labels)))
        new = [col(c) for c in inner.df.columns if c not in numbered.columns]
        return Rows(numbered.join(inner.df.select(key, *new), key, "left").drop(key), {**left.vars, **inner.vars}, {**left.labels, **inner.labels})

    @staticmethod
    def _plain_call(x: Any) -> bool:
        return isinstance(x, Call) and x.name not in ("full_text_search", "bm25_score", "hybrid_search", "out_degree", "in_degree", "degree")

    def filtered(self, rows: Rows, tests: list) -> Rows:
        """WHERE: patterns become semi and anti joins where they stand alone."""
        later = []
        for c in tests:
            inner, negated = c, False
            while isinstance(inner, Op) and inner.name == "NOT":
                inner, negated = inner.args[0], not negated
            if isinstance(inner, Exists):
                later.append((inner, negated))
                continue
            rows = self.marked(rows, c)
            out = Expressions(rows.df, rows.vars, self.params, self.marks(rows)).condition(c)
            rows = Rows(rows.df.where(out), rows.vars, rows.labels)
        for inner, negated in later:
            rows = self.exists(rows, inner, "left_anti" if negated else "left_semi")
        return self.unmarked(rows)

    def exists(self, rows: Rows, e: Exists, how: str) -> Rows:
        found, conditions = self.patterns.all(e.paths, rows, self.params)
        tests = conditions + conjuncts(e.where)

        def condition(a: DataFrame, b: DataFrame, vars: dict):
            both = a.crossJoin(b).limit(0)
            out = F.lit(True)
            for c in tests:
                out = out & Expressions(both, vars, self.params).condition(c)
            return out

        if not tests:  # only the ids of the shared variables matter
            shared = [f"{v}._id" if k == "node" else v for v, k in found.vars.items() if v in rows.vars]
            found = Rows(found.df.select(*map(col, shared)).distinct() if shared else found.df.limit(1), {v: k for v, k in found.vars.items() if v in rows.vars})
        return joined(rows, found, how, condition if tests else None)

    # Subtrees that need a join: computed into a column before the expression

    def marked(self, rows: Rows, tree: Any) -> Rows:
        df = rows.df
        self._marks: dict = getattr(self, "_marks", {})
        for x in walk(tree):
            if x.__class__ in (Exists, Shortest) or (isinstance(x, Call) and x.name in ("out_degree", "in_degree", "degree", "full_text_search", "bm25_score", "hybrid_search")):
                if x in self._marks and self._marks[x] in df.columns:
                    continue
                name = f"_m{next(self.fresh)}"
                df = self._mark(Rows(df, rows.vars, rows.labels), x, name)
                self._marks[x] = name
        return Rows(df, rows.vars, rows.labels)

    def marks(self, rows: Rows) -> dict:
        return {x: col(n) for x, n in getattr(self, "_marks", {}).items() if n in rows.df.columns}

    @staticmethod
    def unmarked(rows: Rows) -> Rows:
        return Rows(rows.df.drop(*[c for c in rows.df.columns if c.startswith("_m") and c[2:].isdigit()]), rows.vars, rows.labels)

    def _mark(self, rows: Rows, x: Any, name: str) -> DataFrame:
        df = rows.df
        if isinstance(x, Exists):
            found, conditions = self.patterns.all(x.paths, rows, self.params)
            tests = conditions + conjuncts(x.where)
            shared = [v for v in found.vars if v in rows.vars]
            if tests or not shared:
                key = f"{name}k"  # by row: a test may need any column
                keyed = df.withColumn(key, F.monotonically_increasing_id())
                from loomgraph.sources.storage import kept

                keyed = kept(keyed)
                hit = self.exists(Rows(keyed, rows.vars, rows.labels), x, "left_semi").df.select(key, F.lit(True).alias(name))
                return keyed.join(hit, key, "left").drop(key).withColumn(name, F.coalesce(name, F.lit(False)))
            ids = [f"{v}._id" for v in shared]
            hit = found.df.select(*[col(i).alias(f"_k.{i}") for i in ids]).distinct().withColumn(name, F.lit(True))
            test = col(ids[0]) == col(f"_k.{ids[0]}")
            for i in ids[1:]:
                test = test & (col(i) == col(f"_k.{i}"))
            return df.join(hit, test, "left").drop(*[f"_k.{i}" for i in ids]).withColumn(name, F.coalesce(name, F.lit(False)))
        if isinstance(x, Shortest):
            a, rel, b = x.path.parts
            every = frozenset(self.graph.nodes)
            e, _, _ = self.patterns.edge_table("_e", Rel(None, rel.types, (), rel.direction), every, every)
            high = rel.hops[1] if rel.hops and rel.hops[1] is not None else MOST_HOPS if rel.hops else 1
            ends = []
            for p in (a, b):
                if p.var in rows.vars:
                    ends.append(col(f"{p.var}._id"))
                    continue
                n = Node(p.var or f"_s{next(self.fresh)}", p.labels, p.props)  # the first node that has the properties
                from loomgraph.plans.ast import Path

                conditions: list = []
                own = self.patterns.path(Path((n,)), Rows(df.limit(0)), self.params, conditions)
                first = own.df.agg(F.min(col(f"{n.var}._id")).alias(f"{name}_{n.var}"))
                df = df.crossJoin(first)
                ends.append(F.col(f"{name}_{n.var}"))
            df = df.withColumn(f"{name}s", ends[0]).withColumn(f"{name}t", ends[1])
            found = shortest(df.select(F.col(f"{name}s").alias("_s"), F.col(f"{name}t").alias("_t")), e.select("_from", "_to").distinct(), high)
            found = found.select(F.col("_s").alias(f"{name}s"), F.col("_t").alias(f"{name}t"), F.col("_hops").alias(name))
            return df.join(found, [f"{name}s", f"{name}t"], "left").drop(f"{name}s", f"{name}t")
        if x.name in ("out_degree", "in_degree", "degree"):
            var = x.args[0].name
            found = union([degrees(self.graph, label, x.name) for label in rows.labels.get(var, self.graph.nodes)])
            found = found.select(F.col("_id").alias("_k"), F.col("degree").alias(name))
            return df.join(found, col(f"{var}._id") == F.col("_k"), "left").drop("_k").withColumn(name, F.coalesce(name, F.lit(0)))
        from loomgraph.plans.procedures import search_mark

        return search_mark(self, rows, x, name)

    # UNWIND

    def unwind(self, u: Unwind, rows: Rows) -> Rows:
        rows = self.marked(rows, u.items)
        e = Expressions(rows.df, rows.vars, self.params, self.marks(rows))
        value = e.value(u.items)
        kind = e.type_of(value)
        if isinstance(kind, T.NullType):
            return Rows(rows.df.where(F.lit(False)).withColumn(u.var, F.lit(None).cast("string")), {**rows.vars, u.var: "value"}, rows.labels)
        if not isinstance(kind, T.ArrayType):
            value = F.array(value)
        return Rows(rows.df.withColumn(u.var, F.explode(value)), {**rows.vars, u.var: "value"}, rows.labels)

    # WITH and RETURN

    def project(self, p: Projection, rows: Rows, keys: tuple = ()) -> Rows:
        items = p.items
        if p.star:
            items = tuple(Item(Var(v), v, v) for v in rows.vars) + items
        rows = self.marked(rows, tuple(i.expr for i in items) + tuple(o[0] for o in p.order))
        aggregated = any(is_aggregate(i.expr) for i in items)
        order = p.order
        # A sort key that is a returned expression is that column.
        named = {i.expr: Var(i.name) for i in items if not isinstance(i.expr, Lit)}
        own = tuple((rewritten(e, named), down) for e, down in order)
        out = self.grouped(items, rows, keys) if aggregated else self.renamed(items, rows, keys, () if p.distinct else own)
        if p.distinct:
            out.df = self.distinct(out)
        if order:
            e = Expressions(out.df, out.vars, self.params, self.marks(out))
            sort = []
            for k, (expr, down) in enumerate(own):
                value = col(f"_o{k}") if f"_o{k}" in out.df.columns else e.comparable(expr)
                sort.append(value.desc_nulls_last() if down else value.asc_nulls_first())
            out.df = out.df.orderBy(*sort)
        if keys and (p.skip is not None or p.limit is not None):  # for each outer row
            first = self.number(p.skip) if p.skip is not None else 0
            last = first + self.number(p.limit) if p.limit is not None else None
            window = Window.partitionBy(*map(col, keys)).orderBy(*(sort if order else [F.lit(1)]))
            numbered = out.df.withColumn("_n", F.row_number().over(window)).where(F.col("_n") > first)
            out.df = (numbered if last is None else numbered.where(F.col("_n") <= last)).drop("_n")
        else:
            if p.skip is not None:
                out.df = out.df.offset(self.number(p.skip))
            if p.limit is not None:
                out.df = out.df.limit(self.number(p.limit))
        out.df = out.df.drop(*[c for c in out.df.columns if c.startswith("_o") and c[2:].isdigit()])
        out = self.unmarked(out)
        return self.filtered(out, conjuncts(p.where))

    def number(self, e: Any) -> int:
        value = e.value if isinstance(e, Lit) else self.params.get(e.name)
        if not isinstance(value, int) or value < 0:
            raise ValueError("SKIP and LIMIT take a number from 0 on")
        return value

    def distinct(self, rows: Rows) -> DataFrame:
        """Nodes are alike if their ids are; their other columns need no compare."""
        ids = [c for v, k in rows.vars.items() for c in ([f"{v}._id"] if k == "node" else [f"{v}._src", f"{v}._dst", f"{v}._type"] if k == "rel" else [v])]
        rest = [c for c in rows.df.columns if c not in ids]
        if not rest:
            return rows.df.distinct()
        kinds = dict(rows.df.dtypes)
        if any(kinds[c].startswith("map") for c in ids):
            return rows.df.distinct()
        return rows.df.groupBy(*map(col, ids)).agg(*[F.first(col(c)).alias(c) for c in rest]).select(*map(col, rows.df.columns))

    def renamed(self, items: tuple, rows: Rows, keys: tuple, order: tuple) -> Rows:
        e = Expressions(rows.df, rows.vars, self.params, self.marks(rows))
        columns, vars, labels = [], {}, {}
        for i in items:
            columns += self.columns_of(i, e, rows)
            kind = rows.vars.get(i.expr.name, "value") if isinstance(i.expr, Var) else "value"
            vars[i.name] = kind
            if kind == "node":
                labels[i.name] = rows.labels.get(i.expr.name, frozenset(self.graph.nodes))
        # Sort keys that aren't returned are computed here and dropped later.
        outer = Expressions(rows.df, {**rows.vars}, self.params, self.marks(rows))
        for k, (expr, _) in enumerate(order):
            shadowed = any(isinstance(x, Prop) and isinstance(x.of, Var) and rows.vars.get(x.of.name) in ("node", "rel") and vars.get(x.of.name) == "value" for x in walk(expr))
            if shadowed or not ({x.name for x in walk(expr) if isinstance(x, Var)} <= set(vars)):
                columns.append(outer.comparable(expr).alias(f"_o{k}"))
        columns += [col(k) for k in keys]
        columns += [col(c) for c in rows.df.columns if c.startswith("_m") and c[2:].isdigit() and any(self._marks.get(x) == c for o, _ in order for x in walk(o))]
        return Rows(rows.df.select(*columns), vars, labels)

    @staticmethod
    def columns_of(i: Item, e: Expressions, rows: Rows) -> list:
        if isinstance(i.expr, Var) and rows.vars.get(i.expr.name) in ("node", "rel"):
            own = i.expr.name
            return [col(c).alias(f"{i.name}.{c[len(own) + 1 :]}") for c in rows.df.columns if c.startswith(f"{own}.")]
        return [e.value(i.expr).alias(i.name)]

    def grouped(self, items: tuple, rows: Rows, keys: tuple) -> Rows:
        e = Expressions(rows.df, rows.vars, self.params, self.marks(rows))
        by, carried, vars, labels = [], [], {}, {}
        swap: dict = {}
        for i in items:
            if is_aggregate(i.expr):
                continue
            columns = self.columns_of(i, e, rows)
            kind = rows.vars.get(i.expr.name, "value") if isinstance(i.expr, Var) else "value"
            vars[i.name] = kind
            swap[i.expr] = Var(i.name)
            if kind in ("node", "rel"):
                # An id stands for its node: the rest comes along.
                own = i.expr.name
                ids = ("_id",) if kind == "node" else ("_src", "_dst", "_type")
                names = [c[len(own) + 1 :] for c in rows.df.columns if c.startswith(f"{own}.")]
                by += [col(f"{own}.{x}").alias(f"{i.name}.{x}") for x in ids]
                carried += [F.first(col(f"{own}.{x}")).alias(f"{i.name}.{x}") for x in names if x not in ids]
                labels[i.name] = rows.labels.get(own, frozenset(self.graph.nodes))
            else:
                by += columns
        by += [col(k) for k in keys]
        aggs, finals = [], []
        for i in items:
            if not is_aggregate(i.expr):
                continue
            expr = i.expr
            for x in [x for x in walk(expr) if isinstance(x, Call) and x.name in AGGREGATES]:
                if x not in swap:
                    name = f"_a{next(self.fresh)}"
                    aggs.append(e.aggregate(x).alias(name))
                    swap[x] = Var(name)
            finals.append((i.name, rewritten(expr, swap)))
        df = (rows.df.groupBy(*by) if by else rows.df).agg(*aggs, *carried)
        inner = {**vars, **{v.name: "value" for v in swap.values()}}
        for x in swap.values():  # values inside expressions of nodes' properties
            inner.setdefault(x.name, "value")
        after = Expressions(df, inner, self.params)
        columns = [col(c) for c in df.columns if not (c.startswith("_a") and c[2:].isdigit())]
        for name, expr in finals:
            columns.append(after.value(expr).alias(name))
            vars[name] = "value"
        vars = {i.name: vars[i.name] for i in items}
        return Rows(df.select(*columns), vars, labels)

    # CALL { }

    def subquery(self, s: Subquery, rows: Rows | None) -> Rows:
        if not s.imports:
            inner = self.statement(s.query)
            return inner if rows is None else Rows(rows.df.crossJoin(inner.df), {**rows.vars, **inner.vars}, rows.labels)
        if rows is None:
            raise Unknown(f"unknown variable {s.imports[0]}")
        if any(v not in rows.vars for v in s.imports):
            raise Unknown(f"only what is bound can be imported: {', '.join(s.imports)}")

        def identity(v: str) -> Column:
            """What tells values apart; of a relationship all columns, as parallel ones
            differ in their properties alone."""
            if rows.vars[v] == "rel":
                return F.struct(*[col(c) for c in rows.df.columns if c.startswith(f"{v}.")])
            return col(f"{v}._id" if rows.vars[v] == "node" else v)

        keys = {v: f"_k:{v}" for v in s.imports}
        own = [c for c in rows.df.columns if c in s.imports or c.split(".")[0] in s.imports]
        imported = Rows(rows.df.select(*map(col, own)), {v: rows.vars[v] for v in s.imports})
        distinct = imported.df.distinct() if "rel" in imported.vars.values() else self.distinct(imported)
        seed = distinct.select("*", *[identity(v).alias(k) for v, k in keys.items()])
        inner = self.statement(s.query, Rows(seed, {v: rows.vars[v] for v in s.imports}, {v: rows.labels[v] for v in s.imports if v in rows.labels}), tuple(keys.values()))
        columns = [c for c in inner.df.columns if c not in keys.values()]
        df, last = inner.df, s.query.clauses[-1] if isinstance(s.query, Query) else None
        test = F.lit(True)
        for v, k in keys.items():
            test = test & identity(v).eqNullSafe(col(k))
        # Without keys of its own, an aggregate has a row for every outer row.
        total = isinstance(last, Return) and all(is_aggregate(i.expr) for i in last.body.items) and last.body.limit is None
        out = rows.df.join(df, test, "left" if total else "inner").drop(*keys.values())
        if total:
            for i in last.body.items:
                if isinstance(i.expr, Call) and i.expr.name in ("count", "sum"):
                    out = out.withColumn(i.name, F.coalesce(col(i.name), F.lit(0)))
                elif isinstance(i.expr, Call) and i.expr.name == "collect":
                    out = out.withColumn(i.name, F.coalesce(col(i.name), F.array().cast(out.schema[i.name].dataType)))
        return Rows(out, {**rows.vars, **{c: "value" for c in columns}}, rows.labels)


__all__ = ["KEY_BITS", "Compiler", "literal", "run"]
