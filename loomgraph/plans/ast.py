"""Syntax trees of the query language."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any


@dataclass(frozen=True)
class Lit:
    value: Any


@dataclass(frozen=True)
class Param:
    name: str


@dataclass(frozen=True)
class Var:
    name: str


@dataclass(frozen=True)
class Prop:
    of: Any
    name: str


@dataclass(frozen=True)
class Op:
    """A unary or binary operator, by its upper-case name."""

    name: str
    args: tuple


@dataclass(frozen=True)
class Call:
    name: str
    args: tuple
    distinct: bool = False
    star: bool = False


@dataclass(frozen=True)
class Case:
    subject: Any
    branches: tuple
    default: Any


@dataclass(frozen=True)
class ListOf:
    items: tuple


@dataclass(frozen=True)
class MapOf:
    items: tuple


@dataclass(frozen=True)
class Quantified:
    """ANY, ALL, NONE, SINGLE over a list."""

    kind: str
    var: str
    items: Any
    where: Any


@dataclass(frozen=True)
class Comprehension:
    var: str
    items: Any
    where: Any
    value: Any


@dataclass(frozen=True)
class Node:
    var: str | None
    labels: tuple = ()
    props: tuple = ()


@dataclass(frozen=True)
class Rel:
    var: str | None
    types: tuple = ()
    props: tuple = ()
    direction: str = "out"
    hops: tuple | None = None


@dataclass(frozen=True)
class Path:
    """Nodes and relationships in turn."""

    parts: tuple
    var: str | None = None


@dataclass(frozen=True)
class Exists:
    paths: tuple
    where: Any = None


@dataclass(frozen=True)
class Shortest:
    path: Path


@dataclass(frozen=True)
class Item:
    expr: Any
    alias: str | None
    text: str

    @property
    def name(self) -> str:
        return self.alias or self.text


@dataclass(frozen=True)
class Projection:
    items: tuple
    distinct: bool = False
    order: tuple = ()
    skip: Any = None
    limit: Any = None
    where: Any = None
    star: bool = False


@dataclass(frozen=True)
class Match:
    paths: tuple
    where: Any = None
    optional: bool = False


@dataclass(frozen=True)
class With:
    body: Projection


@dataclass(frozen=True)
class Return:
    body: Projection


@dataclass(frozen=True)
class Unwind:
    items: Any
    var: str


@dataclass(frozen=True)
class Subquery:
    query: Any
    imports: tuple = ()


@dataclass(frozen=True)
class Procedure:
    name: str
    args: tuple
    yields: tuple = ()


@dataclass(frozen=True)
class Create:
    paths: tuple


@dataclass(frozen=True)
class Merge:
    path: Path
    on_create: tuple = ()
    on_match: tuple = ()


@dataclass(frozen=True)
class SetProps:
    items: tuple  # of (var, prop, expr)


@dataclass(frozen=True)
class Delete:
    names: tuple
    detach: bool = False


@dataclass(frozen=True)
class Query:
    clauses: tuple


@dataclass(frozen=True)
class Union:
    left: Any
    right: Any
    all: bool


@dataclass(frozen=True)
class Schema:
    """A statement about indexes, constraints or storage."""

    kind: str
    args: dict = field(default_factory=dict, hash=False)


def walk(tree: Any):
    """The tree and everything below it."""
    yield tree
    if isinstance(tree, tuple | list):
        for x in tree:
            yield from walk(x)
    elif hasattr(tree, "__dataclass_fields__"):
        for name in tree.__dataclass_fields__:
            yield from walk(getattr(tree, name))
