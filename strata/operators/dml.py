"""INSERT, UPDATE, DELETE and table definitions as copy-on-write over a state.

Each function takes the store's parts and a state and returns the next state with the
affected rows (a DataFrame over immutable files, or None) and their number.
"""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strata.errors import StrataError, unsupported
from strata.plans import nodes as n
from strata.plans.lower import Hint, Lower, Scope, bind, field_of, hints_for, with_flags
from strata.plans.parser import TYPES
from strata.plans.types import INTEGER, NULL, REAL, Kind, kind_of
from strata.schema import PRECISION, Column as Declared, Table, check_row, decimal, exact, table as make_table
from strata.sources.chunks import Chunks, View
from strata.sources.log import TOP_FORMAT, State

CELLS = 2000  # computed cells of VALUES in one job


@dataclass
class Outcome:
    state: State
    affected: DataFrame | None
    count: int


class Writer:
    """Writes against one state. claim(table, column, n) gives n fresh sequence numbers."""

    def __init__(self, chunks: Chunks, claim):
        self.chunks, self.claim, self.spark = chunks, claim, chunks.spark

    def run(self, state: State, s, allow_full_table: bool = False) -> Outcome:
        match s:
            case n.Insert():
                return self.insert(state, s)
            case n.Update() | n.Delete():
                if s.where is None and not allow_full_table:
                    raise StrataError("MISSING_WHERE", "this would change every row", "add WHERE, or allow the full table")
                return self.update(state, s) if isinstance(s, n.Update) else self.delete(state, s)
        return Outcome(self.define(state, s), None, 0)

    # Definitions

    def define(self, state: State, s) -> State:
        new = state.copy()
        match s:
            case n.CreateTable(name, columns):
                if name in new.schema:
                    raise StrataError("UNKNOWN_TABLE", f"a table {name} exists already")
                made: dict[str, Declared] = {}
                for c in columns:
                    if c.name in made:
                        raise StrataError("DUPLICATE_COLUMN", f"{name} has two columns {c.name}")
                    made[c.name] = declared(c)
                needs_format(state, made)
                new.schema[name] = make_table(name, made)
                new.chunks[name] = []
            case n.DropTable(name):
                View(self.chunks, state).table(name)
                del new.schema[name]
                new.chunks.pop(name, None)
                new.indexes.pop(name, None)
            case n.AddColumn(name, c):
                t = View(self.chunks, state).table(name)
                if c.name in t.columns:
                    raise StrataError("DUPLICATE_COLUMN", f"{name} has a column {c.name} already")
                made = {c.name: declared(c)}
                needs_format(state, made)
                new.schema[name] = Table({**t.columns, **made}, t.uniques)
            case n.CreateIndex(name, column, quiet):
                t = View(self.chunks, state).table(name)
                if column not in t.columns:
                    raise StrataError("UNKNOWN_COLUMN", f"{name} has no column {column}")
                if column in state.indexes.get(name, {}):
                    if quiet:
                        return state
                    raise StrataError("INDEX_EXISTS", f"{name}({column}) is indexed already")
                new.indexes.setdefault(name, {})[column] = self.chunks.index(name, t, column, state.chunks.get(name, []))
            case n.DropIndex(name, column):
                View(self.chunks, state).table(name)
                if column not in state.indexes.get(name, {}):
                    raise StrataError("INDEX_NOT_FOUND", f"{name}({column}) is not indexed")
                del new.indexes[name][column]
            case _:
                raise unsupported(type(s).__name__)
        return new

    def replace(self, state: State, name: str, gone: set[str], added: list) -> State:
        """State with files taken out and put in, and indexes that follow."""
        new = state.copy()
        new.chunks[name] = [c for c in state.chunks.get(name, []) if c.path not in gone] + added
        for column, sides in new.indexes.get(name, {}).items():
            for p in gone:
                sides.pop(p, None)
            sides.update(self.chunks.index(name, new.schema[name], column, added))
        return new

    # INSERT

    def insert(self, state: State, s: n.Insert) -> Outcome:
        view = View(self.chunks, state)
        t = view.table(s.table)
        rows = self.prepare(state, s)
        conflict = s.conflict
        target = self.target(t, conflict)
        keys = t.keys()
        existing = {key: self.matching(view, s.table, key, rows) for key in keys}
        current: dict[object, dict] = {}  # rows as they will be, by primary key
        written: set = set()
        by_key: dict[tuple, dict[tuple, object]] = {key: {} for key in keys}
        for key, found in existing.items():
            for row in found:
                current.setdefault(row[t.key], row)
        for pk, row in current.items():
            for key in keys:
                if (v := _key(row, key)) is not None:
                    by_key[key][v] = pk
        affected, replaced = {}, set()
        stored = set(current)
        ready: dict[int, tuple[dict, dict]] = {}
        for k, row in enumerate(rows):
            if target is not None and conflict.updates is not None and k not in ready:
                ready |= self.merge_ahead(state, s, t, target, current, by_key[target], rows, k)
            hit = next(((key, by_key[key][v]) for key in keys if (v := _key(row, key)) is not None and v in by_key[key]), None)
            at_target = target is not None and (v := _key(row, target)) is not None and v in by_key[target]
            if conflict is not None and at_target:
                if conflict.updates is None:
                    continue
                pk = by_key[target][_key(row, target)]
                old, new = ready.get(k, (None, None))
                if old is not current[pk]:  # changed by a row of this statement since
                    new = self.merged(state, s, t, [(current[pk], row)])[0]
                others = [key for key in keys if (v := _key(new, key)) is not None and by_key[key].get(v, pk) != pk]
                if others:
                    raise _conflict(t, s.table, others[0], new)
                for key in keys:
                    if (v := _key(current[pk], key)) is not None:
                        by_key[key].pop(v, None)
                del current[pk]
                if pk in stored:
                    replaced.add(pk)
                written.discard(pk)
                row = new
            elif hit is not None:
                raise _conflict(t, s.table, hit[0], row)
            current[row[t.key]] = row
            written.add(row[t.key])
            for key in keys:
                if (v := _key(row, key)) is not None:
                    by_key[key][v] = row[t.key]
            affected.pop(row[t.key], None)
            affected[row[t.key]] = row
        out = [current[pk] for pk in written]
        if not out:
            return Outcome(state, self.returning(state, s, self.chunks.empty(t)), 0)
        gone, kept = self.without(view, s.table, replaced)
        fresh = self.spark.createDataFrame([tuple(r[c] for c in t.columns) for r in out], t.struct)
        added = self.chunks.stage(s.table, t, kept.unionByName(fresh) if kept is not None else fresh, single=kept is None)
        shown = self.spark.createDataFrame([tuple(r[c] for c in t.columns) for r in affected.values()], t.struct)
        return Outcome(self.replace(state, s.table, gone, added), self.returning(state, s, shown), len(affected))

    def prepare(self, state: State, s: n.Insert) -> list[dict]:
        """The rows of VALUES in stored form."""
        t = View(self.chunks, state).table(s.table)
        for c in s.columns:
            if c not in t.columns:
                raise StrataError("UNKNOWN_COLUMN", f"{s.table} has no column {c}")
        if len(set(s.columns)) < len(s.columns):
            raise StrataError("DUPLICATE_COLUMN", "a column is given twice")
        lower, rows, computed = Lower(View(self.chunks, state), Scope()), [], []
        for values in s.rows:
            row = {}
            for c, e in zip(s.columns, values):
                if isinstance(e, n.Lit):
                    row[c] = e.digits if e.digits is not None and t.columns[c].kind == "decimal" else e.value
                else:
                    computed.append((row, c, lower.value(e)[0]))
            rows.append(row)
        for at in range(0, len(computed), CELLS):  # all cells of a statement in one job, up to CELLS
            some = computed[at : at + CELLS]
            got = self.spark.range(1).select(*[x.alias(f"v{k}") for k, (_, _, x) in enumerate(some)]).first()
            for (row, c, _), v in zip(some, got):
                row[c] = v
        for c, x in t.columns.items():
            if x.sequence:
                open_rows = [r for r in rows if r.get(c) is None]
                for r, number in zip(open_rows, self.claim(s.table, c, len(open_rows))):
                    r[c] = number
        return [check_row(s.table, t, r) for r in rows]

    def target(self, t: Table, conflict: n.Conflict | None) -> tuple | None:
        if conflict is None:
            return None
        if not conflict.target:
            return (t.key,)
        for key in t.keys():
            if set(key) == set(conflict.target):
                return key
        raise StrataError("INVALID_CONFLICT_TARGET", f"({', '.join(conflict.target)}) is not unique", "name the primary key or a unique")

    def matching(self, view: View, name: str, key: tuple[str, ...], rows: list[dict]) -> list[dict]:
        """Stored rows that share a key with the given ones; as many as these at most."""
        t = view.table(name)
        values = {v for r in rows if (v := _key(r, key)) is not None}
        if not values:
            return []
        hints = [Hint(c, "in", tuple({v[i] for v in values})) for i, c in enumerate(key)]
        df = view.frame(name, hints)
        schema = ", ".join(f"`{c}` {t.columns[c].spark_type.simpleString()}" for c in key)
        wanted = self.spark.createDataFrame(list(values), schema)
        return [r.asDict() for r in df.join(F.broadcast(wanted), list(key), "left_semi").select(*t.columns).collect()]

    def merge_ahead(self, state: State, s: n.Insert, t: Table, target: tuple, current: dict, stored: dict, rows: list[dict], first: int) -> dict[int, tuple[dict, dict]]:
        """DO UPDATE of the rows from `first` on, up to the first that repeats a key, in one job: index -> (row it starts from, result)."""
        pairs, seen = {}, set()
        for k in range(first, len(rows)):
            v = _key(rows[k], target)
            if v in seen and v is not None:
                break
            seen.add(v)
            if v is not None and v in stored:
                pairs[k] = (current[stored[v]], rows[k])
        made = self.merged(state, s, t, list(pairs.values())) if pairs else []
        out = {k: (old, new) for (k, (old, _)), new in zip(pairs.items(), made)}
        return {k: (None, None) for k in range(first, first + len(seen))} | out

    def merged(self, state: State, s: n.Insert, t: Table, pairs: list[tuple[dict, dict]]) -> list[dict]:
        """DO UPDATE SET over pairs of a stored and an incoming row, all in one job."""
        columns = {c: kind_of(x.spark_type) for c, x in t.columns.items()}
        scope = _Excluded({s.table: columns, "excluded": columns})
        lower = Lower(View(self.chunks, state), scope)
        for c, _ in s.conflict.updates:
            if c not in t.columns:
                raise StrataError("UNKNOWN_COLUMN", f"{s.table} has no column {c}")
        struct = T.StructType([T.StructField(f"{side}.{c}", x.spark_type) for side in (s.table, "excluded") for c, x in t.columns.items()])
        df = self.spark.createDataFrame([(*(old[c] for c in t.columns), *(new[c] for c in t.columns), k) for k, (old, new) in enumerate(pairs)], struct.add("__k", T.IntegerType()))
        made = df.select("__k", *[lower.value(e)[0].alias(c) for c, e in s.conflict.updates]).collect()  # a row for each row of the statement
        out = {r["__k"]: {c: r[c] for c, _ in s.conflict.updates} for r in made}
        return [check_row(s.table, t, {**old, **{c: _back(v, t.columns[c]) for c, v in out[k].items()}}) for k, (old, _) in enumerate(pairs)]

    def without(self, view: View, name: str, pks: set) -> tuple[set[str], DataFrame | None]:
        """Files that hold some keys, and the other rows of these files."""
        if not pks:
            return set(), None
        t = view.table(name)
        files = self.chunks.prune(name, view.state, [Hint(t.key, "in", tuple(pks))])
        df = self.chunks.read(t, files)
        # As many keys as the statement has rows.
        keys = F.broadcast(self.spark.createDataFrame([(p,) for p in pks], f"`{t.key}` {t.columns[t.key].spark_type.simpleString()}"))
        found = self._paths(df.withColumn("__f", F.col("_metadata.file_path")).join(keys, t.key, "left_semi"), files)
        return found, self.chunks.read(t, [c for c in files if c.path in found]).join(keys, t.key, "left_anti")

    @staticmethod
    def _paths(df: DataFrame, files: list) -> set[str]:
        got = [r[0] for r in df.select("__f").distinct().collect()]  # one for each touched file
        return {c.path for c in files if any(g.endswith(c.path) for g in got)}

    # UPDATE and DELETE

    def _matched(self, state: State, name: str, where: n.Expr | None):
        """Files that may match, their rows under scoped names, and the condition for each row."""
        view = View(self.chunks, state)
        t = view.table(name)
        files = self.chunks.prune(name, state, hints_for(where, name, True))
        df = self.chunks.read(t, files)
        scope = Scope({name: {c: kind_of(x.spark_type) for c, x in t.columns.items()}})
        lower = Lower(view, scope)
        file = F.col("_metadata.file_path") if files else F.lit(None).cast("string")
        df = df.select(*[bind(field_of(c), f"{name}.{c}") for c in t.columns], file.alias("__f"))
        if where is not None:
            df = with_flags(lower, df, [where])
            hit = lower.test(where, closed=True)
        else:
            hit = F.lit(True)
        counts = {r["__f"]: r["count"] for r in df.filter(hit).groupBy("__f").count().collect()} if files else {}  # one for each touched file
        touched = {c.path for c in files if any(g.endswith(c.path) for g in counts)}
        return t, lower, df, hit, [c for c in files if c.path in touched], touched, sum(counts.values())

    def update(self, state: State, s: n.Update) -> Outcome:
        t, lower, df, hit, files, touched, count = self._matched(state, s.table, s.where)
        for c, _ in s.sets:
            if c not in t.columns:
                raise StrataError("UNKNOWN_COLUMN", f"{s.table} has no column {c}")
        made = {c: self.assigned(lower, s.table, c, t.columns[c], e) for c, e in s.sets}
        if not touched:
            return Outcome(state, self.returning(state, s, self.chunks.empty(t)), 0)
        df = df.filter(_in_files(files))
        self.check_exact(df.filter(hit), lower, s, t)
        changed = df.select(*[(F.when(hit, made[c]).otherwise(field_of(f"{s.table}.{c}")) if c in made else field_of(f"{s.table}.{c}")).alias(c) for c in t.columns], hit.alias("__hit"))
        added = self.chunks.stage(s.table, t, changed.drop("__hit"))
        new = self.replace(state, s.table, touched, added)
        for key in t.keys():
            if any(c in made for c in key):
                self.check_unique(new, s.table, t, key, added)
        return Outcome(new, self.returning(state, s, changed.filter("__hit").drop("__hit")), count)

    def assigned(self, lower: Lower, name: str, c: str, x: Declared, e: n.Expr) -> Column:
        value, kind = lower.value(e)
        if x.kind == "decimal" and isinstance(e, n.Lit) and e.digits is not None:
            return F.lit(exact(e.digits, c, x.scale)).cast(x.spark_type)
        want = kind_of(x.spark_type)
        fine = kind == NULL or kind == want or (want.textual and kind.textual) or (want == REAL and kind == INTEGER) or (want.name == "decimal" and kind.name in ("decimal", "integer"))
        if not fine:
            raise StrataError("TYPE_MISMATCH", f"{name}.{c} takes {x.kind}, not {kind.name}", "CAST the value")
        if kind == NULL and x.primary:
            raise StrataError("TYPE_MISMATCH", f"{name}.{c} is the primary key and cannot be NULL")
        return value.cast(x.spark_type)

    def check_exact(self, df: DataFrame, lower: Lower, s: n.Update, t: Table) -> None:
        """No value with finer digits than its column is rounded away."""
        for c, e in s.sets:
            value, kind = lower.value(e)
            x = t.columns[c]
            if x.kind == "decimal" and kind.name == "decimal" and kind.scale > x.scale and not df.filter(value.cast(x.spark_type) != value).isEmpty():
                raise StrataError("TYPE_MISMATCH", f"{c} keeps {x.scale} fraction digits", "ROUND the value")

    def check_unique(self, state: State, name: str, t: Table, key: tuple[str, ...], added: list) -> None:
        """No key of the files added stands twice in them or in another file."""
        fresh = {c.path for c in added}
        mine = self.chunks.read(t, added).select(*key).dropna()
        others = self.chunks.read(t, [c for c in state.chunks[name] if c.path not in fresh]).select(*key)
        twice = mine.groupBy(*key).count().filter("count > 1").limit(1).collect() or others.join(mine, list(key), "left_semi").limit(1).collect()
        if twice:
            raise _conflict(t, name, key, twice[0].asDict())

    def delete(self, state: State, s: n.Delete) -> Outcome:
        t, lower, df, hit, files, touched, count = self._matched(state, s.table, s.where)
        if not touched:
            return Outcome(state, self.returning(state, s, self.chunks.empty(t)), 0)
        df = df.filter(_in_files(files))
        plain = [field_of(f"{s.table}.{c}").alias(c) for c in t.columns]
        gone = df.filter(hit).select(*plain)
        kept = df.filter(~hit).select(*plain)
        added = [] if count == sum(c.rows for c in files) else self.chunks.stage(s.table, t, kept)
        return Outcome(self.replace(state, s.table, touched, added), self.returning(state, s, gone), count)

    def returning(self, state: State, s, rows: DataFrame) -> DataFrame | None:
        if s.returning is None:
            return None
        if s.returning == "*":
            return rows
        scope = Scope({s.table: {f.name: kind_of(f.dataType) for f in rows.schema}})
        lower = Lower(View(self.chunks, state), scope)
        df = rows.select(*[bind(field_of(c), f"{s.table}.{c}") for c in rows.columns])
        return df.select(*[lower.value(i.expr)[0].alias(i.name) for i in s.returning])

    # Whole frames

    def append(self, state: State, name: str, df: DataFrame, skip_existing: bool = False) -> Outcome:
        """Rows of a DataFrame that carries the key, checked by joins; for loads of any size."""
        t = View(self.chunks, state).table(name)
        for c in df.columns:
            if c not in t.columns:
                raise StrataError("UNKNOWN_COLUMN", f"{name} has no column {c}")
        if t.key not in df.columns:
            raise StrataError("SEQUENCE_UNASSIGNED", f"a frame for {name} must carry {t.key}")
        df = df.select(*[(F.col(f"`{c}`") if c in df.columns else F.lit(None)).cast(x.spark_type).alias(c) for c, x in t.columns.items()])
        old = self.chunks.read(t, state.chunks.get(name, []))
        if skip_existing:
            df = df.dropDuplicates([t.key]).join(old.select(t.key), t.key, "left_anti").select(*t.columns)
        if not df.filter(F.col(f"`{t.key}`").isNull()).isEmpty():
            raise StrataError("TYPE_MISMATCH", f"{name}.{t.key} is the primary key and cannot be NULL")
        added = self.chunks.stage(name, t, df)
        count = sum(c.rows for c in added)
        fresh = self.chunks.read(t, added)
        for key in t.keys():
            twice = fresh.select(*key).dropna().groupBy(*key).count().filter("count > 1").limit(1).collect()
            twice = twice or fresh.select(*key).dropna().join(old.select(*key), list(key), "left_semi").limit(1).collect()
            if twice:
                raise _conflict(t, name, key, twice[0].asDict())
        return Outcome(self.replace(state, name, set(), added) if count else state, None, count)


def needs_format(state: State, columns: dict[str, Declared]) -> None:
    """Decimals and ordered statements need the top format; older readers must not meet them unawares."""
    if state.format < TOP_FORMAT and any(x.kind == "decimal" for x in columns.values()):
        raise StrataError("FORMAT_REQUIRED", f"decimal columns need format {TOP_FORMAT}, the store has {state.format}", "run upgrade() once")


class _Excluded(Scope):
    """In DO UPDATE a bare name is the stored row's."""

    def find(self, col: n.Col) -> tuple[str, Kind]:
        return super().find(n.Col(next(iter(self.tables)), col.name) if col.table is None else col)


def _key(row: dict, key: tuple[str, ...]) -> tuple | None:
    v = tuple(row[c] for c in key)
    return None if None in v else v


def _conflict(t: Table, name: str, key: tuple[str, ...], row: dict) -> StrataError:
    code = "PRIMARY_KEY_CONFLICT" if key == (t.key,) else "UNIQUE_CONFLICT"
    return StrataError(code, f"{name} has a row with {', '.join(f'{c} = {row[c]!r}' for c in key)} already")


def _back(v, x: Declared):
    """A computed value in a form that row checks accept."""
    if x.kind == "decimal" and v is not None:
        return v if isinstance(v, Decimal) else str(v)
    return v


def _in_files(files: list) -> Column:
    hit = F.lit(False)
    names = [c.path.rsplit("/", 1)[1] for c in files]
    return F.element_at(F.split("__f", "/"), -1).isin(*names) if names else hit


def declared(c: n.ColumnDef) -> Declared:
    """A column of CREATE TABLE or ALTER TABLE."""
    if c.type in ("decimal", "numeric"):
        x = decimal(c.args[-1] if len(c.args) > 1 else c.args[0], c.args[0] if len(c.args) > 1 else PRECISION)
    elif c.type in ("timestamp", "datetime"):
        x = Declared("timestamp")
    elif c.type in TYPES:
        x = Declared(TYPES[c.type])
    else:
        raise StrataError("UNKNOWN_TYPE", f"there is no type {c.type}", ", ".join(sorted({*TYPES, "decimal"})))
    if c.primary:
        x = x.primary_key()
    if c.unique:
        x = x.unique_key()
    return x.refers_to(c.references) if c.references else x
