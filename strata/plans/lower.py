"""Lowering: a syntax tree and a catalog give a lazy DataFrame.

Names are resolved here, case-sensitively, before Spark sees them: every table's columns
get names of their own. Comparisons with NULL are false. In a filter a bare comparison
says the same, and it can be pushed into the scan; only where a NULL could show (under
NOT, or as a value) is it closed with coalesce(…, false).
"""

from __future__ import annotations

from dataclasses import dataclass, field
from decimal import Decimal
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.errors import StrataError, unsupported
from strata.functions import scalar
from strata.plans import nodes as n
from strata.plans.types import BOOLEAN, DATE, INTEGER, NULL, REAL, TEXT, TIMESTAMP, Kind, common, kind_of, mixed

SETTINGS = {"spark.sql.decimalOperations.allowPrecisionLoss": "false"}


class Catalog(Protocol):
    def frame(self, table: str, hints: list[Hint]) -> DataFrame:
        """Rows of a table; hints let it leave out files that cannot match."""


@dataclass(frozen=True)
class Hint:
    column: str
    op: str  # = < <= > >=, in
    values: tuple


def bind(c: Column, name: str) -> Column:
    return c.alias(name)


@dataclass
class Scope:
    tables: dict[str, dict[str, Kind]] = field(default_factory=dict)
    outer: Scope | None = None

    def find(self, col: n.Col) -> tuple[str, Kind]:
        if col.table is not None:
            if col.table not in self.tables:
                known = self.outer
                while known is not None:
                    if col.table in known.tables:
                        raise StrataError("UNKNOWN_TABLE", f"{col.table} belongs to the outer query; correlation is not supported", "join instead")
                    known = known.outer
                raise StrataError("UNKNOWN_TABLE", f"no table {col.table} in this query")
            if col.name not in self.tables[col.table]:
                raise StrataError("UNKNOWN_COLUMN", f"{col.table} has no column {col.name}")
            return f"{col.table}.{col.name}", self.tables[col.table][col.name]
        found = [t for t, columns in self.tables.items() if col.name in columns]
        if not found:
            known = self.outer
            while known is not None:
                if any(col.name in c for c in known.tables.values()):
                    raise StrataError("UNKNOWN_COLUMN", f"{col.name} belongs to the outer query; correlation is not supported", "join instead")
                known = known.outer
            raise StrataError("UNKNOWN_COLUMN", f"no column {col.name}")
        if len(found) > 1:
            raise StrataError("UNKNOWN_COLUMN", f"{col.name} is in {' and '.join(found)}", "qualify it with a table")
        return f"{found[0]}.{col.name}", self.tables[found[0]][col.name]

    def has(self, col: n.Col) -> bool:
        try:
            self.find(col)
        except StrataError:
            return False
        return True


def field_of(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


class Lower:
    """Expressions over one scope. `bound` gives nodes that are columns already."""

    def __init__(self, catalog: Catalog, scope: Scope):
        self.catalog, self.scope = catalog, scope
        self.bound: dict[n.Expr, tuple[Column, Kind]] = {}

    # Values

    def value(self, e: n.Expr) -> tuple[Column, Kind]:
        if e in self.bound:
            return self.bound[e]
        match e:
            case n.Lit(None, _):
                return F.lit(None), NULL
            case n.Lit(value, digits):
                kind = BOOLEAN if isinstance(value, bool) else INTEGER if isinstance(value, int) else REAL if isinstance(value, float) else TEXT
                return F.lit(value), kind
            case n.Col():
                return self.column(e)
            case n.Binary("+" | "-" | "*" | "/", _, _):
                return self.arithmetic(e)
            case n.Binary("||", left, right):
                return F.concat(*[scalar.text_of(*self.value(x)) for x in (left, right)]), TEXT
            case n.Binary("->>", left, right):
                return scalar.arrow(self.value(left)[0], right)
            case n.Case(whens, otherwise):
                made = [self.value(v) for _, v in whens] + ([self.value(otherwise)] if otherwise else [])
                kind = common([k for _, k in made])
                out = None
                for (test, _), (c, _) in zip(whens, made):
                    t = self.test(test)
                    out = F.when(t, c) if out is None else out.when(t, c)
                return (out.otherwise(made[-1][0]) if otherwise else out), kind
            case n.Cast(of, to):
                return scalar.cast(*self.value(of), to)
            case n.Call(name, args):
                made = [self.value(a) for a in args]
                return scalar.BUILDERS[name]([c for c, _ in made], [k for _, k in made], args)
            case n.Subquery(select):
                return self.scalar_subquery(select)
            case n.Agg():
                raise StrataError("AGGREGATE_MISPLACED", f"{n.label(e)} cannot stand here")
        return self.test(e, closed=True), BOOLEAN

    def column(self, e: n.Col) -> tuple[Column, Kind]:
        name, kind = self.scope.find(e)
        return field_of(name), kind

    def pair(self, op: str, left: n.Expr, right: n.Expr) -> tuple[Column, Kind, Column, Kind]:
        """Two operands brought to kinds that can meet."""
        a, ka = self.value(left)
        b, kb = self.value(right)
        if ka.name == "decimal" and isinstance(right, n.Lit) and kb.numeric:
            b, kb = _exact(right)
        if kb.name == "decimal" and isinstance(left, n.Lit) and ka.numeric:
            a, ka = _exact(left)
        mixed(op, ka, kb)
        return a, ka, b, kb

    def arithmetic(self, e: n.Binary) -> tuple[Column, Kind]:
        a, ka, b, kb = self.pair(e.op, e.left, e.right)
        a, ka = scalar.number_of(a, ka)
        b, kb = scalar.number_of(b, kb)
        if NULL in (ka, kb):
            return F.lit(None).cast("double"), REAL
        exact = "decimal" in (ka.name, kb.name)
        if e.op == "/":
            if exact:
                scale = (ka.scale if ka.name == "decimal" else 0) + 4
                return F.round(F.try_divide(a, b), scale), Kind("decimal", scale)
            return F.try_divide(a.cast("double"), b.cast("double")), REAL
        out = a + b if e.op == "+" else a - b if e.op == "-" else a * b
        if exact:
            return out, Kind("decimal", ka.scale + kb.scale if e.op == "*" else max(ka.scale, kb.scale))
        if INTEGER == ka == kb:
            big = a.cast("bigint"), b.cast("bigint")
            return (big[0] + big[1] if e.op == "+" else big[0] - big[1] if e.op == "-" else big[0] * big[1]), INTEGER
        return out, REAL

    def scalar_subquery(self, select: n.Select) -> tuple[Column, Kind]:
        value, kind, spark_type = _single(self.catalog, select, self.scope)
        return F.lit(value).cast(spark_type), kind

    # Conditions

    def test(self, e: n.Expr, closed: bool = False) -> Column:
        """A condition. Where closed, it is never NULL."""
        if e in self.bound:
            c = self.bound[e][0]
            return F.coalesce(c, F.lit(False)) if closed else c
        match e:
            case n.Binary("AND", left, right):
                return self.test(left, closed) & self.test(right, closed)
            case n.Binary("OR", left, right):
                return self.test(left, closed) | self.test(right, closed)
            case n.Not(of):
                return ~self.test(of, closed=True)
            case n.IsNull(of, negated):
                c, _ = self.value(of)
                return c.isNotNull() if negated else c.isNull()
            case n.Binary("=" | "!=" | "<" | "<=" | ">" | ">=", left, right):
                c = self.compare(e.op, left, right)
            case n.In(of, tuple(options), negated):
                c = self.in_list(of, options, negated)
            case n.In():
                raise unsupported("IN (SELECT ...) at this place", "use it in WHERE or HAVING")
            case n.Between(of, low, high, negated):
                inside = self.compare(">=", of, low) & self.compare("<=", of, high)
                known = [self.value(x)[0].isNotNull() for x in (of, low, high) if not isinstance(x, n.Lit)]
                c = ~inside if negated else inside
                if negated:
                    for k in known:
                        c = k & c
            case n.Like(of, pattern, negated):
                text = scalar.text_of(*self.value(of))
                form = F.replace(scalar.text_of(*self.value(pattern)), F.lit("\\"), F.lit("\\\\"))
                if isinstance(pattern, n.Lit) and isinstance(pattern.value, str):
                    like = text.like(pattern.value.replace("\\", "\\\\"))
                else:
                    like = F.like(text, form)
                c = ~like if negated else like
            case _:
                c, kind = self.value(e)
                if kind not in (BOOLEAN, NULL):
                    raise StrataError("TYPE_MISMATCH", f"{n.label(e)} is {kind.name}, not a condition")
                c = c.cast("boolean")
        return F.coalesce(c, F.lit(False)) if closed else c

    def compare(self, op: str, left: n.Expr, right: n.Expr) -> Column:
        a, ka, b, kb = self.pair(op, left, right)
        a, b = _meet(a, ka, left, b, kb, right)
        return {"=": a == b, "!=": a != b, "<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[op]

    def in_list(self, of: n.Expr, options: tuple, negated: bool) -> Column:
        options = tuple(o for o in options if not (isinstance(o, n.Lit) and o.value is None))
        c, kind = self.value(of)
        if not options:
            return F.lit(negated) & c.isNotNull()
        if all(isinstance(o, n.Lit) and type(o.value) is type(options[0].value) for o in options) and (
            (kind == TEXT and isinstance(options[0].value, str)) or (kind == INTEGER and isinstance(options[0].value, int))
        ):
            hit = c.isin(*[o.value for o in options])
            return ~hit if negated else hit
        hit = None
        for o in options:
            one = self.compare("=", of, o)
            if not isinstance(o, n.Lit):
                one = F.coalesce(one, F.lit(False))
            hit = one if hit is None else hit | one
        return (~F.coalesce(hit, F.lit(False)) & c.isNotNull()) if negated else hit


def _exact(e: n.Lit) -> tuple[Column, Kind]:
    """A number as written, as a decimal."""
    if "e" in (e.digits or "").lower():
        raise StrataError("TYPE_MISMATCH", f"{e.digits} beside a decimal", "write it without an exponent")
    value = Decimal(e.digits)
    scale = max(0, -value.as_tuple().exponent)
    return F.lit(value).cast(f"decimal({max(len(value.as_tuple().digits), scale + 1, 1)},{scale})"), Kind("decimal", scale)


def _meet(a: Column, ka: Kind, left: n.Expr, b: Column, kb: Kind, right: n.Expr) -> tuple[Column, Column]:
    """Operands of a comparison."""
    for x, kx, y, ky, swap in ((a, ka, b, kb, False), (b, kb, a, ka, True)):
        if kx in (TIMESTAMP, DATE) and ky == TEXT:
            y = y.try_cast("timestamp_ntz") if kx == TIMESTAMP else y.try_cast("date")
            return (y, x) if swap else (x, y)
        if kx.numeric and ky.textual:
            y = y.try_cast("double")
            x = x.cast("double") if kx.name == "decimal" else x
            return (y, x) if swap else (x, y)
    if {ka, kb} & {NULL} or ka == kb or (ka.numeric and kb.numeric) or (ka.textual and kb.textual) or {ka, kb} <= {TIMESTAMP, DATE}:
        return a, b
    raise StrataError("TYPE_MISMATCH", f"{ka.name} cannot be compared with {kb.name}", "CAST one of them")


def _single(catalog: Catalog, select: n.Select, scope: Scope):
    """The value of a scalar subquery, its kind and its Spark type; run once for a statement, at most two rows are fetched."""
    known = catalog.__dict__.setdefault("_scalars", {})
    if id(select) not in known:
        known[id(select)] = (select, *_run_single(catalog, select, scope))
    return known[id(select)][1:]


def _run_single(catalog: Catalog, select: n.Select, scope: Scope):
    df = lower_select(catalog, select, scope)
    if len(df.columns) != 1:
        raise StrataError("SUBQUERY_SHAPE", f"a scalar subquery gives one column, not {len(df.columns)}")
    rows = df.limit(2).collect()
    if len(rows) > 1:
        raise StrataError("SUBQUERY_MULTIPLE_ROWS", "a scalar subquery gave more than one row", "use IN, or an aggregate")
    return (rows[0][0] if rows else None), kind_of(df.schema[0].dataType), df.schema[0].dataType


def conjuncts(e: n.Expr | None) -> list[n.Expr]:
    if e is None:
        return []
    if isinstance(e, n.Binary) and e.op == "AND":
        return conjuncts(e.left) + conjuncts(e.right)
    return [e]


def hints_for(where: n.Expr | None, alias: str, only: bool, catalog: Catalog | None = None) -> list[Hint]:
    """What the condition says of raw columns of one table; `only`: names need no qualifier. Scalar subqueries that ran for the catalog count as values."""
    out, turned = [], {"<": ">", ">": "<", "<=": ">=", ">=": "<="}
    known = getattr(catalog, "_scalars", {})

    def mine(e) -> bool:
        return isinstance(e, n.Col) and (e.table == alias or (e.table is None and only))

    for c in conjuncts(where):
        if isinstance(c, n.Binary) and isinstance(c.right, n.Subquery) and id(c.right.select) in known:
            c = n.Binary(c.op, c.left, n.Lit(known[id(c.right.select)][1], ""))
        match c:
            case n.Binary("=" | "<" | "<=" | ">" | ">=" as op, left, n.Lit(v, _)) if mine(left) and v is not None:
                out.append(Hint(left.name, op, (v,)))
            case n.Binary("=" | "<" | "<=" | ">" | ">=" as op, n.Lit(v, _), right) if mine(right) and v is not None:
                out.append(Hint(right.name, turned.get(op, op), (v,)))
            case n.Between(of, n.Lit(low, _), n.Lit(high, _), False) if mine(of) and None not in (low, high):
                out += [Hint(of.name, ">=", (low,)), Hint(of.name, "<=", (high,))]
            case n.In(of, tuple(options), False) if mine(of) and all(isinstance(o, n.Lit) for o in options):
                out.append(Hint(of.name, "in", tuple(o.value for o in options if o.value is not None)))
    return out


def _fold_scalars(catalog: Catalog, e: n.Expr | None, scope: Scope) -> n.Expr | None:
    """WHERE with top-level comparisons to scalar subqueries made literal, so that they prune and push down."""
    if e is None:
        return None
    parts = []
    for c in conjuncts(e):
        if isinstance(c, n.Binary) and c.op in ("=", "<", "<=", ">", ">=", "!=") and isinstance(c.right, n.Subquery):
            value, kind = _single(catalog, c.right.select, scope)[:2]
            if kind in (INTEGER, TEXT) and value is not None:
                c = n.Binary(c.op, c.left, n.Lit(value, str(value)))
        parts.append(c)
    out = parts[0]
    for p in parts[1:]:
        out = n.Binary("AND", out, p)
    return out


class Scan:
    """FROM, JOIN and WHERE of a statement as a frame with a scope."""

    def __init__(self, catalog: Catalog, source: n.Source, joins: tuple[n.Join, ...], where: n.Expr | None, outer: Scope | None):
        self.catalog, self.scope = catalog, Scope(outer=outer)
        only = not joins
        self.df = self._read(source, where, only)
        for j in joins:
            right = self._read(j.source, where, only)
            a, b = j.left, j.right
            if a.table == j.source.alias and b.table != j.source.alias:
                a, b = b, a
            new = {b.table} if b.table else {t for t in self.scope.tables if b.name in self.scope.tables[t]}
            if a.table == j.source.alias or j.source.alias not in new or not self.scope.has(a) or not self.scope.has(b):
                self.scope.find(a)
                self.scope.find(b)
                raise StrataError("INVALID_JOIN_CONDITION", f"ON must compare {j.source.alias} with a table before it")
            (left, ka), (rgt, kb) = self.scope.find(a), self.scope.find(b)
            if ka.name == kb.name == "decimal" and ka.scale != kb.scale:
                raise StrataError("TYPE_MISMATCH", f"joining decimals of scale {ka.scale} and {kb.scale}")
            mixed("a join", ka, kb)
            self.df = self.df.join(right, field_of(left) == field_of(rgt), j.kind)
        self.lower = Lower(catalog, self.scope)
        if where is not None:
            self._filter(where)

    def _read(self, source: n.Source, where, only: bool) -> DataFrame:
        df = self.catalog.frame(source.table, hints_for(where, source.alias, only, self.catalog))
        self.scope.tables[source.alias] = {f.name: kind_of(f.dataType) for f in df.schema}
        return df.select(*[bind(field_of(c), f"{source.alias}.{c}") for c in df.columns])

    def _filter(self, where: n.Expr) -> None:
        rest = None
        for c in conjuncts(where):
            if isinstance(c, n.In) and isinstance(c.options, n.Select):
                self.df = self._semi(c)
            else:
                rest = c if rest is None else n.Binary("AND", rest, c)
        if rest is not None:
            self.df = with_flags(self.lower, self.df, [rest])
            self.df = self.df.filter(self.lower.test(rest))

    def _semi(self, c: n.In) -> DataFrame:
        keys, (key, _) = in_keys(self.lower, c)
        df = self.df.filter(key.isNotNull()) if c.negated else self.df
        return df.join(keys, key == field_of("__key"), "left_anti" if c.negated else "left_semi")


def in_keys(lower: Lower, c: n.In) -> tuple[DataFrame, tuple[Column, Kind]]:
    inner = lower_select(lower.catalog, c.options, lower.scope)
    if len(inner.columns) != 1:
        raise StrataError("SUBQUERY_SHAPE", f"IN takes one column, not {len(inner.columns)}")
    key, kind = lower.value(c.of)
    keys = inner.toDF("__key").dropna()
    other = kind_of(inner.schema[0].dataType)
    if kind != other and not (kind.numeric and other.numeric):
        a, b = _meet(key, kind, c.of, field_of("__key"), other, n.Lit(None))
        return keys.select(b.alias("__key")), (a, kind)
    return keys, (key, kind)


def with_flags(lower: Lower, df: DataFrame, exprs: list[n.Expr]) -> DataFrame:
    """df with a flag for each IN (SELECT ...) inside the expressions, by a join with distinct keys."""
    for e in exprs:
        for node in n.walk(e):
            if isinstance(node, n.In) and isinstance(node.options, n.Select) and node not in lower.bound:
                keys, (key, _) = in_keys(lower, node)
                name = f"__in{len(lower.bound)}"
                keys = keys.distinct().withColumnRenamed("__key", f"{name}k").withColumn(name, F.lit(True))
                df = df.join(keys, key == F.col(f"{name}k"), "left").drop(f"{name}k")
                hit = F.coalesce(F.col(name), F.lit(False))
                lower.bound[node] = ((~hit & key.isNotNull()) if node.negated else hit, BOOLEAN)
    return df


def lower_select(catalog: Catalog, s: n.Select, outer: Scope | None = None) -> DataFrame:
    names = Scope({x.alias: {} for x in (s.source, *(j.source for j in s.joins))}, outer)
    where = _fold_scalars(catalog, s.where, names)
    scan = Scan(catalog, s.source, s.joins, where, outer)
    lower, df = scan.lower, scan.df
    items = s.items if s.items is not None else _star(scan.scope)
    seen: set[str] = set()
    for i in items:
        if i.name in seen:
            raise StrataError("DUPLICATE_COLUMN", f"two output columns are named {i.name}", "give one an alias with AS")
        seen.add(i.name)
    aliases = {i.alias: i.expr for i in items if i.alias}

    grouped = bool(s.group) or s.having is not None or any(n.has_aggregate(i.expr) for i in items)
    having = _substitute(s.having, aliases, scan.scope) if s.having is not None else None
    orders = []
    for o in s.order:
        by_alias = o.key.table is None and o.key.name in aliases
        orders.append((aliases[o.key.name] if by_alias else o.key, o.descending))
    if grouped:
        if s.items is None:
            raise StrataError("NOT_GROUPED", "SELECT * cannot be grouped", "name the columns")
        keys = tuple(aliases[g.name] if isinstance(g, n.Col) and g.table is None and g.name in aliases and not scan.scope.has(g) else g for g in s.group)
        if any(map(n.has_aggregate, keys)):
            raise StrataError("AGGREGATE_MISPLACED", "an aggregate cannot be grouped by")
        needed = [i.expr for i in items] + ([having] if having is not None else []) + [e for e, _ in orders]
        df, lower = _group(lower, df, keys, needed)
        if having is not None:
            df = with_flags(lower, df, [having])
            df = df.filter(lower.test(having))
    else:
        df = with_flags(lower, df, [i.expr for i in items])

    made = [lower.value(i.expr)[0].alias(i.name) for i in items]
    if s.distinct:
        out = df.select(*made).distinct()
        by = []
        for e, down in orders:
            at = next((i.name for i in items if i.expr == e or _same(lower, i.expr, e)), None)
            if at is None:
                raise unsupported("ORDER BY of a column that SELECT DISTINCT does not give", "select it too")
            by.append(field_of(at).desc() if down else field_of(at).asc())
        df = out.orderBy(*by) if by else out
    elif orders:
        keys = [lower.value(e)[0].alias(f"__order{k}") for k, (e, _) in enumerate(orders)]
        df = df.select(*made, *keys).orderBy(*[F.col(f"__order{k}").desc() if down else F.col(f"__order{k}").asc() for k, (_, down) in enumerate(orders)])
    else:
        df = df.select(*made)
    if s.offset is not None:
        df = df.offset(_count(s.offset, "OFFSET"))
    if s.limit is not None:
        df = df.limit(_count(s.limit, "LIMIT"))
    return df.select(*[field_of(i.name) for i in items]) if orders and not s.distinct else df


def _same(lower: Lower, a: n.Expr, b: n.Expr) -> bool:
    return isinstance(a, n.Col) and isinstance(b, n.Col) and lower.scope.has(a) and lower.scope.has(b) and lower.scope.find(a) == lower.scope.find(b)


def _count(e: n.Expr, what: str) -> int:
    if not isinstance(e, n.Lit) or isinstance(e.value, bool) or not isinstance(e.value, int) or e.value < 0:
        raise StrataError("PARSE_ERROR", f"{what} takes a whole number")
    return e.value


def _star(scope: Scope) -> tuple[n.Item, ...]:
    out, seen = [], {}
    for table, columns in scope.tables.items():
        for c in columns:
            if c in seen:
                raise StrataError("DUPLICATE_COLUMN", f"{c} is in {seen[c]} and {table}", "name the columns instead of *")
            seen[c] = table
            out.append(n.Item(n.Col(table, c), c))
    return tuple(out)


def _substitute(e: n.Expr, aliases: dict[str, n.Expr], scope: Scope) -> n.Expr:
    """Aliases replaced by what they stand for; a real column of that name wins."""
    if isinstance(e, n.Col):
        return aliases[e.name] if e.table is None and e.name in aliases and not scope.has(e) else e
    changed = {}
    for name in e.__dataclass_fields__:
        value = getattr(e, name)
        changed[name] = _deep(value, lambda x: _substitute(x, aliases, scope))
    return type(e)(**changed)


def _deep(value, f):
    if isinstance(value, n.Expr):
        return f(value)
    return tuple(_deep(v, f) for v in value) if isinstance(value, tuple) else value


def _group(lower: Lower, df: DataFrame, keys: tuple[n.Expr, ...], needed: list[n.Expr]) -> tuple[DataFrame, Lower]:
    """Group df by keys; the returned lowering knows keys and aggregates as columns."""
    df = with_flags(lower, df, [*keys, *[a for e in needed for a in n.walk(e) if isinstance(a, n.Agg)]])
    after = _Grouped(lower, keys)
    by = [lower.value(k) for k in keys]
    aggs: dict[n.Agg, tuple[Column, Kind]] = {}
    for e in needed:
        for node in n.walk(e):
            if isinstance(node, n.Agg) and node not in aggs:
                c, kind = lower.value(node.arg) if node.arg is not None else (None, NULL)
                separator = ","
                if node.separator is not None:
                    if not isinstance(node.separator, n.Lit) or not isinstance(node.separator.value, str):
                        raise StrataError("TYPE_MISMATCH", "GROUP_CONCAT takes its separator as literal text")
                    separator = node.separator.value
                aggs[node] = scalar.aggregate(node.name, c, kind, node.distinct, separator)
    made = [c.alias(f"__agg{k}") for k, (c, _) in enumerate(aggs.values())]
    if keys:
        df = df.groupBy(*[c.alias(f"__key{k}") for k, (c, _) in enumerate(by)])
        df = df.agg(*made) if made else df.agg(F.lit(1).alias("__one"))
    else:
        df = df.agg(*(made or [F.lit(1).alias("__one")]))
    for k, (e, (_, kind)) in enumerate(zip(keys, by)):
        after.bound[e] = (F.col(f"__key{k}"), kind)
    for k, (e, (_, kind)) in enumerate(aggs.items()):
        after.bound[e] = (F.col(f"__agg{k}"), kind)
    return df, after


class _Grouped(Lower):
    """Expressions above a grouping: keys, aggregates and what is made of them."""

    def __init__(self, before: Lower, keys: tuple[n.Expr, ...]):
        super().__init__(before.catalog, before.scope)
        self.keys = keys

    def column(self, e: n.Col) -> tuple[Column, Kind]:
        found = self.scope.find(e)
        for k in self.keys:
            if isinstance(k, n.Col) and self.scope.find(k) == found:
                return self.bound[k]
        raise StrataError("NOT_GROUPED", f"{n.label(e)} is neither grouped by nor inside an aggregate")
