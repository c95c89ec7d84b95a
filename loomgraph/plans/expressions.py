"""From expression trees to Spark columns.

Conditions are two-valued: what isn't true is false, `=` is null-safe, and `<>` is
its negation. Values are three-valued but for `=`, `<>`, IN and IS NULL."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph.functions.scalar import FLOATS, FUNCTIONS, WHOLE, is_number, is_text, size
from loomgraph.plans.ast import Call, Case, Comprehension, Exists, ListOf, Lit, MapOf, Op, Param, Prop, Quantified, Shortest, Var

AGGREGATES = {"count", "sum", "avg", "min", "max", "collect"}
#: The column that says how many rows a folded one stands for.
TIMES = "_times"
ORDERS = {"<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b}
TEXTS = {"CONTAINS": F.contains, "STARTS WITH": F.startswith, "ENDS WITH": F.endswith}


class Unknown(ValueError):
    """A name or function that isn't there."""


def col(name: str) -> Column:
    return F.col(f"`{name}`")


class Expressions:
    """Compiles against a table of bindings. vars: kind of each variable; local:
    columns of variables inside list expressions; marks: columns that stand for
    whole subtrees (aggregates, patterns) computed before."""

    def __init__(self, df: DataFrame, vars: dict[str, str], params: dict, marks: dict | None = None, local: dict | None = None) -> None:
        self.df, self.vars, self.params, self.marks, self.local = df, vars, params, marks or {}, local or {}
        self.columns = set(df.columns)
        self.log: list | None = None
        self.replayed = False

    def inside(self, var: str, column: Column, log: list, replayed: bool) -> Expressions:
        out = Expressions(self.df, self.vars, self.params, self.marks, {**self.local, var: column})
        out.log, out.replayed = log, replayed
        return out

    def over(self, var: str, items: Column, build: Callable[[Expressions], Column]) -> Callable[[Column], Column]:
        """The function of a list's elements that build gives. An element has no
        type before its list is resolved, so the body is built twice: once with a
        null of the right type, writing down all types asked for, and once with
        the element, reading them."""
        kind = self.type_of(items)
        stand_in = F.lit(None).cast(kind.elementType) if isinstance(kind, T.ArrayType) else F.lit(None)
        if self.log is not None:
            return lambda x: build(self.inside(var, x if self.replayed else stand_in, self.log, self.replayed))
        log: list = []
        build(self.inside(var, stand_in, log, False))
        return lambda x: build(self.inside(var, x, log, True))

    def type_of(self, column: Column) -> T.DataType:
        if self.replayed:
            return self.log.pop(0)
        kind = self.df.select(column).schema[0].dataType
        if self.log is not None:
            self.log.append(kind)
        return kind

    # Conditions

    def condition(self, e: Any, strict: bool = False) -> Column:
        """Where null counts as false anyhow, as in a filter, it may be null: a
        bare comparison can be pushed into the scan. Strict ones never are null."""
        if isinstance(e, Op):
            if e.name == "AND":
                return self.condition(e.args[0], strict) & self.condition(e.args[1], strict)
            if e.name == "OR":
                return self.condition(e.args[0], strict) | self.condition(e.args[1], strict)
            if e.name == "NOT":
                inner = e.args[0]
                if isinstance(inner, Op) and inner.name == "IS NULL" and inner not in self.marks:
                    return ~self.value(inner)
                return ~self.condition(inner, True)
        if not strict and isinstance(e, Op) and e.name == "=" and e not in self.marks and any(isinstance(x, Lit) and x.value is not None for x in e.args):
            # With a constant a plain comparison finds the same rows.
            a, b = (self.comparable(x) for x in e.args)
            kinds = self.type_of(a), self.type_of(b)
            if all(map(is_number, kinds)) or all(map(is_text, kinds)):
                return a == b
        value = self.value(e)
        kind = self.type_of(value)
        if isinstance(kind, T.NullType) and not self.local:
            return F.lit(False)
        if is_number(kind):
            value = value != 0
        elif is_text(kind):
            return F.lit(False)
        return F.coalesce(value, F.lit(False)) if strict else value

    # Values

    def value(self, e: Any) -> Column:
        if e in self.marks:
            return self.marks[e]
        return getattr(self, f"_{type(e).__name__.lower()}")(e)

    def _lit(self, e: Lit) -> Column:
        return literal(e.value)

    def _param(self, e: Param) -> Column:
        return literal(self.params.get(e.name))

    def _var(self, e: Var) -> Column:
        if e.name in self.local:
            return self.local[e.name]
        kind = self.vars.get(e.name)
        if kind is None:
            raise Unknown(f"unknown variable {e.name}")
        if kind in ("node", "rel"):
            own = [c for c in self.df.columns if c.startswith(f"{e.name}.")]
            body = F.struct(*[col(c).alias(c[len(e.name) + 1 :]) for c in own])
            return F.when(col(f"{e.name}.{'_id' if kind == 'node' else '_src'}").isNotNull(), body)
        return col(e.name)

    def _prop(self, e: Prop) -> Column:
        if isinstance(e.of, Var) and e.of.name not in self.local and self.vars.get(e.of.name) in ("node", "rel"):
            name = f"{e.of.name}.{e.name}"
            return col(name) if name in self.columns else F.lit(None)
        return self.value(e.of)[e.name]

    def _listof(self, e: ListOf) -> Column:
        return F.array(*[self.value(x) for x in e.items])

    def _mapof(self, e: MapOf) -> Column:
        return F.struct(*[self.value(v).alias(k) for k, v in e.items])

    def _case(self, e: Case) -> Column:
        out = self.value(e.default)
        for test, then in reversed(e.branches):
            when = self.condition(test if e.subject is None else Op("=", (e.subject, test)))
            out = F.when(when, self.value(then)).otherwise(out)
        return out

    def _quantified(self, e: Quantified) -> Column:
        items = self.value(e.items)
        test = self.over(e.var, items, lambda x: F.lit(True) if e.where is None else x.condition(e.where, True))
        if e.kind == "SINGLE":
            return F.size(F.filter(items, test)) == 1
        if e.kind == "ALL":
            return F.forall(items, test)
        found = F.exists(items, test)
        return ~found if e.kind == "NONE" else found

    def _comprehension(self, e: Comprehension) -> Column:
        items = self.value(e.items)
        if e.where is not None:
            items = F.filter(items, self.over(e.var, items, lambda x: x.condition(e.where)))
        return items if e.value == Var(e.var) else F.transform(items, self.over(e.var, items, lambda x: x.value(e.value)))

    def _exists(self, e: Exists) -> Column:
        raise Unknown("a pattern cannot stand here")

    _shortest = _exists

    def _op(self, e: Op) -> Column:
        name = e.name
        if name in ("AND", "OR"):
            a, b = (self.value(x) for x in e.args)
            return a & b if name == "AND" else a | b
        if name == "XOR":
            a, b = (self.value(x) for x in e.args)
            return a != b
        if name == "NOT":
            return ~self.value(e.args[0])
        if name == "IS NULL":
            if isinstance(e.args[0], Var) and self.vars.get(e.args[0].name) in ("node", "rel"):
                own = e.args[0].name
                return col(f"{own}.{'_id' if self.vars[own] == 'node' else '_src'}").isNull()
            return self.value(e.args[0]).isNull()
        if name == "NEG":
            return -self.value(e.args[0])
        if name in ("=", "<>"):
            same = self.equal(*[self.comparable(x) for x in e.args])
            return same if name == "=" else ~same
        a, b = (self.value(x) for x in e.args)
        if name in ORDERS:
            kinds = self.type_of(a), self.type_of(b)
            if is_text(kinds[0]) != is_text(kinds[1]) and not any(isinstance(k, T.NullType) for k in kinds) and not self._times(*kinds):
                return F.lit(None).cast("boolean")
            return ORDERS[name](a, b)
        if name in TEXTS:
            return TEXTS[name](a, b)
        if name == "IN":
            kind = self.type_of(b)
            if isinstance(kind, T.NullType):
                return F.lit(False)
            if not isinstance(kind, T.ArrayType):
                b = F.array(b)
            return F.coalesce(F.exists(b, lambda x: x.eqNullSafe(a)), F.lit(False))
        if name == "INDEX":
            kind = self.type_of(a)
            if isinstance(kind, T.ArrayType):
                return F.get(a, F.when(b < 0, F.size(a) + b).otherwise(b).cast("int"))
            return a[b]
        return self.arithmetic(name, a, b)

    @staticmethod
    def _times(*kinds: T.DataType) -> bool:
        """Whether one is a time, which a text may be compared with."""
        return any(isinstance(k, T.TimestampType | T.DateType | T.TimestampNTZType) for k in kinds)

    def comparable(self, e: Any) -> Column:
        """A node or relationship is compared by its id."""
        if isinstance(e, Var) and e.name not in self.local and self.vars.get(e.name) == "node":
            return col(f"{e.name}._id")
        return self.value(e)

    def equal(self, a: Column, b: Column) -> Column:
        kinds = self.type_of(a), self.type_of(b)
        if any(isinstance(k, T.BooleanType) for k in kinds) and any(is_number(k) for k in kinds):
            a, b = (x.cast("int") if isinstance(k, T.BooleanType) else x for x, k in zip((a, b), kinds, strict=True))
        elif is_text(kinds[0]) != is_text(kinds[1]) and not any(isinstance(k, T.NullType) for k in kinds) and not self._times(*kinds):
            return F.lit(False) & a.isNull()
        return a.eqNullSafe(b)

    def arithmetic(self, name: str, a: Column, b: Column) -> Column:
        kinds = self.type_of(a), self.type_of(b)
        whole = all(isinstance(k, WHOLE) for k in kinds)
        if name == "+":
            if any(isinstance(k, T.ArrayType) for k in kinds):
                return F.concat(*[x if isinstance(k, T.ArrayType) else F.array(x) for x, k in zip((a, b), kinds, strict=True)])
            if all(is_text(k) or isinstance(k, T.NullType) for k in kinds) and any(map(is_text, kinds)):
                return F.concat(a, b)
            if any(map(is_text, kinds)):
                return F.lit(None).cast("string")
            return a + b
        if any(map(is_text, kinds)):
            return F.lit(None).cast("double")
        if name == "-":
            return a - b
        if name == "*":
            return a * b
        if name == "/":
            if whole:
                return F.call_function("div", a.cast("bigint"), F.nullif(b.cast("bigint"), F.lit(0).cast("bigint")))
            zero = F.when(a > 0, F.lit(float("inf"))).when(a < 0, F.lit(float("-inf"))).when(a.isNotNull(), F.lit(float("nan")))
            return F.when(b == 0, zero).otherwise(F.try_divide(a.cast("double"), b.cast("double")))
        if name == "%":
            return F.try_mod(a, b)
        if name == "^":
            return F.pow(a, b)
        raise Unknown(f"unknown operator {name}")

    def _call(self, e: Call) -> Column:
        name = e.name
        if name in AGGREGATES:
            raise Unknown(f"{name}() cannot stand here")
        if e.args and isinstance(e.args[0], Var) and e.args[0].name not in self.local and self.vars.get(e.args[0].name) in ("node", "rel"):
            var, kind = e.args[0].name, self.vars[e.args[0].name]
            own = {c[len(var) + 1 :] for c in self.df.columns if c.startswith(f"{var}.")}
            props = sorted(c for c in own if c[0] != "_")
            if name == "id":
                return col(f"{var}._id") if kind == "node" else F.xxhash64(col(f"{var}._src"), col(f"{var}._type"), col(f"{var}._dst"))
            if name == "type" and kind == "rel":
                return col(f"{var}._type")
            if name == "labels" and kind == "node":
                return col(f"{var}._labels")
            if name == "keys":
                named = F.array(*[F.when(col(f"{var}.{p}").isNotNull(), F.lit(p)) for p in props]) if props else F.array().cast("array<string>")
                return F.array_compact(named)
            if name == "properties":
                return F.struct(*[col(f"{var}.{p}").alias(p) for p in props]) if props else F.lit(None)
            if name in ("out_degree", "in_degree", "degree"):
                return col(f"{var}.__{name}")
        if name == "nodes" and e.args and isinstance(e.args[0], Var) and self.vars.get(e.args[0].name) == "path":
            return col(e.args[0].name)
        if name == "length" and e.args and isinstance(e.args[0], Var) and self.vars.get(e.args[0].name) == "path":
            return (F.size(col(e.args[0].name)) - 1).cast("long")
        if name == "exists":
            return self.value(e.args[0]).isNotNull()
        if name == "keys" and len(e.args) == 1:
            kind = self.type_of(self.value(e.args[0]))
            return F.array(*[F.lit(n) for n in kind.fieldNames()]) if isinstance(kind, T.StructType) else F.map_keys(self.value(e.args[0]))
        if name not in FUNCTIONS:
            raise Unknown(f"unknown function {name}")
        least, most, build, typed = FUNCTIONS[name]
        if len(e.args) < least or (most is not None and len(e.args) > most):
            raise Unknown(f"{name}() takes other arguments")
        args = [self.value(x) for x in e.args]
        if name == "reverse" and isinstance(self.type_of(args[0]), WHOLE + FLOATS):
            return args[0]
        return build(*args, self.type_of) if typed else build(*args)

    # Aggregates

    def aggregate(self, e: Call) -> Column:
        if TIMES in self.columns and not e.distinct and e.name in ("count", "sum", "avg"):
            return self.folded(e)
        if e.name == "count" and (e.star or not e.args):
            return F.count(F.lit(1))
        x = self.comparable(e.args[0]) if e.name == "count" else self.value(e.args[0])
        if e.name == "count" and isinstance(e.args[0], Var) and self.vars.get(e.args[0].name) == "rel":
            x = col(f"{e.args[0].name}._src")
            if e.distinct:
                x = F.struct(x, col(f"{e.args[0].name}._type"), col(f"{e.args[0].name}._dst"))
        if e.name == "count":
            return F.count_distinct(x) if e.distinct else F.count(x)
        if e.name == "sum":
            x = x if is_number(self.type_of(x)) else x.try_cast("double")
            return F.coalesce(F.sum_distinct(x) if e.distinct else F.sum(x), F.lit(0))
        if e.name == "avg":
            return F.avg(x)
        if e.name == "collect":
            return F.collect_set(x) if e.distinct else F.collect_list(x)
        return {"min": F.min, "max": F.max}[e.name](x)

    def folded(self, e: Call) -> Column:
        """An aggregate over rows that stand for many."""
        times = F.col(TIMES)
        if e.name == "count" and (e.star or not e.args):
            return F.coalesce(F.sum(times), F.lit(0))
        if e.name == "count" and isinstance(e.args[0], Var) and self.vars.get(e.args[0].name) == "rel":
            x = col(f"{e.args[0].name}._src")
        else:
            x = self.comparable(e.args[0]) if e.name == "count" else self.value(e.args[0])
        there = F.sum(F.when(x.isNotNull(), times))
        if e.name == "count":
            return F.coalesce(there, F.lit(0))
        if e.name == "avg":
            return F.sum(x.cast("double") * times) / there
        kind = self.type_of(x)
        x = x.cast("long" if isinstance(kind, T.IntegralType) else "double") if is_number(kind) else x.try_cast("double")
        return F.coalesce(F.sum(x * times), F.lit(0))


def literal(value: Any) -> Column:
    if isinstance(value, list | tuple):
        return F.array(*[literal(v) for v in value])
    if isinstance(value, dict):
        return F.struct(*[literal(v).alias(k) for k, v in value.items()])
    if isinstance(value, int) and not isinstance(value, bool):
        return F.lit(value).cast("bigint")
    return F.lit(value)


__all__ = ["AGGREGATES", "TIMES", "Expressions", "Unknown", "col", "literal", "size"]
