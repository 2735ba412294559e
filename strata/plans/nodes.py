"""Syntax trees. All nodes are frozen, so equal expressions compare equal."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, fields


@dataclass(frozen=True)
class Expr:
    pass


@dataclass(frozen=True)
class Lit(Expr):
    value: object  # str, int, float, bool or None
    digits: str | None = None  # a number as written


@dataclass(frozen=True)
class Col(Expr):
    table: str | None
    name: str


@dataclass(frozen=True)
class Binary(Expr):
    op: str  # AND OR = != < <= > >= + - * / || ->>
    left: Expr
    right: Expr


@dataclass(frozen=True)
class Not(Expr):
    of: Expr


@dataclass(frozen=True)
class In(Expr):
    of: Expr
    options: tuple[Expr, ...] | Select
    negated: bool


@dataclass(frozen=True)
class Between(Expr):
    of: Expr
    low: Expr
    high: Expr
    negated: bool


@dataclass(frozen=True)
class Like(Expr):
    of: Expr
    pattern: Expr
    negated: bool


@dataclass(frozen=True)
class IsNull(Expr):
    of: Expr
    negated: bool


@dataclass(frozen=True)
class Case(Expr):
    whens: tuple[tuple[Expr, Expr], ...]
    otherwise: Expr | None


@dataclass(frozen=True)
class Cast(Expr):
    of: Expr
    to: str


@dataclass(frozen=True)
class Call(Expr):
    name: str
    args: tuple[Expr, ...]


@dataclass(frozen=True)
class Agg(Expr):
    name: str
    arg: Expr | None  # None: COUNT(*)
    distinct: bool = False
    separator: Expr | None = None


@dataclass(frozen=True)
class Subquery(Expr):
    select: Select


@dataclass(frozen=True)
class Item:
    expr: Expr
    alias: str | None

    @property
    def name(self) -> str:
        return self.alias or (self.expr.name if isinstance(self.expr, Col) else label(self.expr))


@dataclass(frozen=True)
class Source:
    table: str
    alias: str


@dataclass(frozen=True)
class Join:
    source: Source
    kind: str  # inner, left
    left: Col
    right: Col


@dataclass(frozen=True)
class Order:
    key: Col
    descending: bool


@dataclass(frozen=True)
class Select:
    items: tuple[Item, ...] | None  # None: *
    source: Source
    joins: tuple[Join, ...] = ()
    where: Expr | None = None
    group: tuple[Expr, ...] = ()
    having: Expr | None = None
    order: tuple[Order, ...] = ()
    limit: Expr | None = None
    offset: Expr | None = None
    distinct: bool = False


@dataclass(frozen=True)
class Conflict:
    target: tuple[str, ...]  # empty: the primary key
    updates: tuple[tuple[str, Expr], ...] | None  # None: do nothing


@dataclass(frozen=True)
class Insert:
    table: str
    columns: tuple[str, ...]
    rows: tuple[tuple[Expr, ...], ...]
    conflict: Conflict | None
    returning: tuple[Item, ...] | str | None


@dataclass(frozen=True)
class Update:
    table: str
    sets: tuple[tuple[str, Expr], ...]
    where: Expr | None
    returning: tuple[Item, ...] | str | None


@dataclass(frozen=True)
class Delete:
    table: str
    where: Expr | None
    returning: tuple[Item, ...] | str | None


@dataclass(frozen=True)
class ColumnDef:
    name: str
    type: str
    args: tuple[int, ...] = ()
    primary: bool = False
    unique: bool = False
    references: str | None = None


@dataclass(frozen=True)
class CreateTable:
    table: str
    columns: tuple[ColumnDef, ...]


@dataclass(frozen=True)
class DropTable:
    table: str


@dataclass(frozen=True)
class AddColumn:
    table: str
    column: ColumnDef


@dataclass(frozen=True)
class CreateIndex:
    table: str
    column: str
    if_not_exists: bool


@dataclass(frozen=True)
class DropIndex:
    table: str
    column: str


def children(node: Expr) -> Iterator[Expr]:
    """Direct sub-expressions; a subquery is a leaf."""
    for f in fields(node):
        value = getattr(node, f.name)
        stack = [value]
        while stack:
            v = stack.pop(0)
            if isinstance(v, Expr):
                yield v
            elif isinstance(v, tuple):
                stack = [*v, *stack]


def walk(node: Expr) -> Iterator[Expr]:
    yield node
    for child in children(node):
        yield from walk(child)


def has_aggregate(node: Expr) -> bool:
    return any(isinstance(n, Agg) for n in walk(node))


def label(e: Expr) -> str:
    """Name of an output column that has no alias."""
    match e:
        case Lit(value, digits):
            return digits or ("NULL" if value is None else str(value))
        case Col(table, name):
            return f"{table}.{name}" if table else name
        case Binary(op, left, right):
            return f"{label(left)} {op} {label(right)}"
        case Agg(name, arg, distinct, _):
            return f"{name}({'DISTINCT ' if distinct else ''}{'*' if arg is None else label(arg)})"
        case Call(name, args):
            return f"{name}({', '.join(map(label, args))})"
        case Cast(of, to):
            return f"CAST({label(of)} AS {to})"
    return type(e).__name__.lower()
