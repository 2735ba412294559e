"""Table schemas: declaration, validation of rows, comparison with what is stored."""

from __future__ import annotations

import os
import re
import threading
import time
from dataclasses import asdict, dataclass, field, replace
from decimal import Decimal

from pyspark.sql import types as T

from strata.errors import StrataError

KINDS = ("text", "integer", "real", "boolean", "timestamp", "decimal")
PRECISION = 18
_DECIMAL = re.compile(r"[+-]?\d+(\.\d*)?|[+-]?\.\d+")
_CROCKFORD = "0123456789ABCDEFGHJKMNPQRSTVWXYZ"


@dataclass(frozen=True)
class Column:
    kind: str
    primary: bool = False
    unique: bool = False
    partition: bool = False
    indexed: bool = False
    sequence: bool = False
    uuid: bool = False
    scale: int | None = None
    precision: int = PRECISION
    references: str | None = None

    def primary_key(self) -> Column:
        if self.kind == "decimal":
            raise StrataError("INVALID_PRIMARY_KEY", "a decimal cannot be a primary key", "use text or integer")
        return replace(self, primary=True)

    def unique_key(self) -> Column:
        return replace(self, unique=True)

    def partition_by(self) -> Column:
        return replace(self, partition=True)

    def index(self) -> Column:
        return replace(self, indexed=True)

    def refers_to(self, target: str) -> Column:
        return replace(self, references=target)

    @property
    def spark_type(self) -> T.DataType:
        if self.kind == "decimal":
            return T.DecimalType(self.precision, self.scale)
        return {"integer": T.LongType(), "real": T.DoubleType(), "boolean": T.BooleanType()}.get(self.kind, T.StringType())


def text() -> Column:
    return Column("text")


def integer() -> Column:
    return Column("integer")


def real() -> Column:
    return Column("real")


def boolean() -> Column:
    return Column("boolean")


def timestamp() -> Column:
    """ISO-8601 text, compared as text."""
    return Column("timestamp")


def decimal(scale: int, precision: int = PRECISION) -> Column:
    if isinstance(scale, bool) or not isinstance(scale, int) or not 0 <= scale <= 12:
        raise StrataError("INVALID_SCALE", f"a decimal has 0 to 12 fraction digits, not {scale!r}")
    if not scale <= precision <= 38:
        raise StrataError("INVALID_SCALE", f"precision {precision} does not hold scale {scale}")
    return Column("decimal", scale=scale, precision=precision)


def sequence() -> Column:
    """An integer that is filled from ranges no two writers share."""
    return Column("integer", sequence=True)


def uuid() -> Column:
    """Text that is filled with a time-ordered id."""
    return Column("text", uuid=True)


def json() -> Column:
    raise StrataError("UNSUPPORTED_COLUMN_TYPE", "there is no json column", "keep JSON in text and read it with JSON_EXTRACT")


@dataclass(frozen=True)
class Table:
    columns: dict[str, Column]
    uniques: tuple[tuple[str, ...], ...] = field(default=())

    @property
    def key(self) -> str:
        return next(c for c, x in self.columns.items() if x.primary)

    @property
    def zone(self) -> list[str]:
        """Columns whose least and greatest value is kept for each chunk."""
        return [c for c, x in self.columns.items() if x.primary or x.partition]

    @property
    def struct(self) -> T.StructType:
        return T.StructType([T.StructField(c, x.spark_type, True) for c, x in self.columns.items()])

    def keys(self) -> list[tuple[str, ...]]:
        """Everything that must be unique, the primary key first."""
        return [(self.key,), *((c,) for c, x in self.columns.items() if x.unique), *self.uniques]

    def to_json(self) -> dict:
        return {"columns": {c: asdict(x) for c, x in self.columns.items()}, "uniques": [list(u) for u in self.uniques]}

    @staticmethod
    def from_json(data: dict) -> Table:
        return Table({c: Column(**x) for c, x in data["columns"].items()}, tuple(tuple(u) for u in data["uniques"]))


def table(name: str, columns: dict[str, Column], uniques: tuple[tuple[str, ...], ...] = ()) -> Table:
    primaries = [c for c, x in columns.items() if x.primary]
    if len(primaries) > 1:
        raise StrataError("MULTIPLE_PRIMARY_KEYS", f"{name} has primary keys {', '.join(primaries)}", "declare a composite unique")
    if not primaries:
        if "id" in columns:
            raise StrataError("AMBIGUOUS_ID_COLUMN", f"{name}.id is not the primary key, and the key that is made would be called id", "mark id as primary key")
        columns = {"id": Column("text", primary=True), **columns}
    if sum(x.partition for x in columns.values()) > 1:
        raise StrataError("MULTIPLE_PARTITION_COLUMNS", f"{name} has more than one partition column")
    if columns[next(c for c, x in columns.items() if x.primary)].kind == "decimal":
        raise StrataError("INVALID_PRIMARY_KEY", f"the key of {name} is a decimal")
    for u in uniques:
        if len(u) < 2 or len(set(u)) != len(u):
            raise StrataError("INVALID_COMPOSITE_UNIQUE", f"{u} needs two or more different columns")
        for c in u:
            if c not in columns:
                raise StrataError("UNKNOWN_COLUMN", f"{name} has no column {c}")
    return Table(dict(columns), tuple(map(tuple, uniques)))


def define(tables: dict[str, dict[str, Column]], uniques: dict[str, list[tuple[str, ...]]] | None = None) -> dict[str, Table]:
    """Tables by name; uniques lists composite uniques by table."""
    for t in uniques or {}:
        if t not in tables:
            raise StrataError("UNKNOWN_TABLE", f"uniques name a table {t} that is not defined")
    return {t: table(t, columns, tuple((uniques or {}).get(t, ()))) for t, columns in tables.items()}


def exact(value: object, column: str, scale: int) -> Decimal:
    """A value as a decimal that has no finer digits than the column."""
    written = value if isinstance(value, str) else format(value, "f") if isinstance(value, Decimal) else repr(value)
    if isinstance(value, bool) or not _DECIMAL.fullmatch(written):
        raise StrataError("TYPE_MISMATCH", f"{column} takes a decimal, not {value!r}", "plain digits, no exponent")
    d = Decimal(written)
    if d != d.quantize(Decimal(1).scaleb(-scale)):
        raise StrataError("TYPE_MISMATCH", f"{column} keeps {scale} fraction digits; {written} has more", "ROUND it first")
    return d.quantize(Decimal(1).scaleb(-scale))


def check_row(name: str, t: Table, row: dict[str, object]) -> dict[str, object]:
    """A row in stored form, with keys and ids filled in."""
    for c in row:
        if c not in t.columns:
            raise StrataError("UNKNOWN_COLUMN", f"{name} has no column {c}")
    out = {}
    for c, x in t.columns.items():
        v = row.get(c)
        if v is None:
            if x.uuid:
                v = uuid7()
            elif x.primary and x.kind == "text":
                v = ulid()
            elif x.sequence:
                raise StrataError("SEQUENCE_UNASSIGNED", f"{name}.{c} has no number yet")
            elif x.primary:
                raise StrataError("TYPE_MISMATCH", f"{name}.{c} is the primary key and cannot be NULL")
        elif x.kind == "decimal":
            v = exact(v, c, x.scale)
        else:
            good = {"integer": isinstance(v, int) and not isinstance(v, bool) or isinstance(v, float) and v.is_integer(), "real": isinstance(v, (int, float)) and not isinstance(v, bool), "boolean": isinstance(v, bool)}
            if not good.get(x.kind, isinstance(v, str)):
                raise StrataError("TYPE_MISMATCH", f"{name}.{c} takes {x.kind}, not {v!r}")
            v = int(v) if x.kind == "integer" else float(v) if x.kind == "real" else v
        out[c] = v
    return out


def drift(code: dict[str, Table], stored: dict[str, Table]) -> tuple[list[str], dict[str, dict[str, Column]]]:
    """Differences that need a person, and plain new columns that do not. Missing tables are no drift."""
    found, new = [], {}
    for name, t in code.items():
        if name not in stored:
            continue
        old = stored[name]
        for c, x in t.columns.items():
            y = old.columns.get(c)
            if y is None:
                if x.primary or x.unique or x.sequence or x.uuid or x.partition:
                    found.append(f"{name}.{c} is not stored and is more than a plain column")
                else:
                    new.setdefault(name, {})[c] = x
                continue
            for what in ("kind", "scale", "primary", "partition", "unique", "sequence", "uuid"):
                if getattr(x, what) != getattr(y, what):
                    found.append(f"{name}.{c}: {what} is {getattr(y, what)!r} in the store and {getattr(x, what)!r} in code")
        if {frozenset(u) for u in t.uniques} != {frozenset(u) for u in old.uniques}:
            found.append(f"{name}: composite uniques differ")
    return found, new


_lock = threading.Lock()
_last = [0, 0]


def _tick() -> tuple[int, int]:
    """Milliseconds, and a counter within one of them; never the same twice, never back."""
    with _lock:
        now = max(time.time_ns() // 1_000_000, _last[0])
        _last[1] = _last[1] + 1 if now == _last[0] else int.from_bytes(os.urandom(1)) & 0x7F
        if _last[1] > 0xFFF:
            now, _last[1] = now + 1, 0
        _last[0] = now
        return now, _last[1]


def uuid7() -> str:
    ms, n = _tick()
    value = ms << 80 | 0x7 << 76 | n << 64 | 0b10 << 62 | int.from_bytes(os.urandom(8)) >> 2
    h = f"{value:032x}"
    return "-".join((h[:8], h[8:12], h[12:16], h[16:20], h[20:]))


def ulid() -> str:
    ms, n = _tick()
    value = ms << 80 | n << 68 | int.from_bytes(os.urandom(9)) >> 4
    return "".join(_CROCKFORD[value >> s & 31] for s in range(125, -1, -5))
