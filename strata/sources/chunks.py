"""Table rows in immutable parquet files: writing, zone maps, side indexes, pruned reading."""

from __future__ import annotations

from collections import OrderedDict
from dataclasses import dataclass, field
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.errors import StrataError
from strata.plans.lower import Hint
from strata.schema import Table, ulid
from strata.sources.log import Chunk, Files, State

def _plain(v):
    return str(v) if isinstance(v, Decimal) else v


@dataclass
class Stats:
    chunks_total: int = 0
    chunks_fetched: int = 0


class Chunks:
    """Files of tables. What is read may be kept in the executors' memory, by path: files never change, so it is never stale."""

    def __init__(self, spark: SparkSession, files: Files, cache_rows: int = 0):
        self.spark, self.files, self.cache_rows = spark, files, cache_rows
        self._kept: OrderedDict[tuple, tuple[int, DataFrame]] = OrderedDict()

    def cached(self, t: Table, chunks: list[Chunk]) -> DataFrame:
        """read(), kept for as long as there is room for cache_rows rows in all."""
        rows = sum(c.rows for c in chunks)
        if not chunks or rows > self.cache_rows:
            return self.read(t, chunks)
        key = (t.struct.json(), *(c.path for c in chunks))
        if key not in self._kept:
            self._kept[key] = (rows, self.read(t, chunks).persist())
        self._kept.move_to_end(key)
        while sum(n for n, _ in self._kept.values()) > self.cache_rows:
            self._kept.popitem(last=False)[1][1].unpersist()
        return self._kept[key][1]

    def paths(self, chunks: list[Chunk]) -> list[str]:
        return [f"{self.files.uri}/{c.path}" for c in chunks]

    def empty(self, t: Table) -> DataFrame:
        return self.spark.createDataFrame([], t.struct)

    def read(self, t: Table, chunks: list[Chunk]) -> DataFrame:
        """Rows of some files. A column a file does not have reads as NULL."""
        return self.spark.read.schema(t.struct).parquet(*self.paths(chunks)) if chunks else self.empty(t)

    def stage(self, name: str, t: Table, df: DataFrame, single: bool = False) -> list[Chunk]:
        """Write rows to new files, sorted by key, and describe them."""
        folder = f"data/{name}/{ulid()}"
        df = df.select(*[F.col(f"`{c}`").cast(x.spark_type).alias(c) for c, x in t.columns.items()])
        df = df.coalesce(1).sortWithinPartitions(t.key) if single else df.repartitionByRange(t.key).sortWithinPartitions(t.key)
        df.write.parquet(f"{self.files.uri}/{folder}")
        return self.describe(t, folder)

    def describe(self, t: Table, folder: str) -> list[Chunk]:
        zones = t.zone
        rows = self.spark.read.schema(t.struct).parquet(f"{self.files.uri}/{folder}").groupBy(F.col("_metadata.file_name").alias("f"))
        found = rows.agg(F.count(F.lit(1)).alias("n"), *[x for c in zones for x in (F.min(f"`{c}`").alias(f"lo_{c}"), F.max(f"`{c}`").alias(f"hi_{c}"))])
        return [Chunk(f"{folder}/{r.f}", r.n, {c: (_plain(r[f"lo_{c}"]), _plain(r[f"hi_{c}"])) for c in zones}) for r in sorted(found.collect(), key=lambda r: r.f)]

    # Side indexes

    def index(self, name: str, t: Table, column: str, chunks: list[Chunk]) -> dict[str, str]:
        """Write the different values of each file to a side table (file, v), sorted by value; returns file -> side folder."""
        if not chunks:
            return {}
        folder = f"index/{name}/{column}/{ulid()}"
        rows = self.read(t, chunks).select(F.col("_metadata.file_name").alias("file"), F.col(f"`{column}`").alias("v")).filter("v IS NOT NULL").distinct()
        rows.sortWithinPartitions("v").write.parquet(f"{self.files.uri}/{folder}")
        return {c.path: folder for c in chunks}

    def holding(self, t: Table, h: Hint, sides: dict[str, str]) -> set[str] | None:
        """File names of indexed files that hold a value a hint admits, found by Spark in the side tables; None if the hint says nothing."""
        x = t.columns[h.column]
        try:
            for v in h.values:
                _compare_as(x.kind, v)
        except (TypeError, ValueError, ArithmeticError):
            return None
        if x.kind == "boolean" or any(isinstance(v, bool) for v in h.values) or not sides:
            return None
        wide = "string" if x.kind not in ("integer", "decimal", "real") else "double"
        v, values = F.col("v"), [F.lit(str(v)).try_cast(wide) if wide == "double" else F.lit(v) for v in h.values]
        whole = x.kind == "integer" and all(isinstance(k, int) for k in h.values)
        values = [F.lit(k) for k in h.values] if whole else values
        v = v if whole else v.cast(wide)
        exact = whole or wide == "string"  # as doubles, neighbours may be equal
        first = values[0] if values else F.lit(None)
        below, above = (v < first, v > first) if exact else (v <= first, v >= first)
        hit = {"=": v == first, "<": below, "<=": v <= first, ">": above, ">=": v >= first, "in": v.isin(*values)}[h.op]
        rows = self.spark.read.schema(f"file string, v {x.spark_type.simpleString()}").parquet(*sorted({f"{self.files.uri}/{p}" for p in sides.values()}))
        return {r.file for r in rows.filter(hit).select("file").distinct().collect()}  # one name for each file at most

    # Pruning

    def prune(self, name: str, state: State, hints: list[Hint]) -> list[Chunk]:
        """Files that may hold rows the hints admit: zone maps first, then side indexes over what is left."""
        t, indexes = state.schema[name], state.indexes.get(name, {})
        out = [c for c in state.chunks.get(name, []) if all(self._may(t, c, h) for h in hints)]
        for h in hints:
            sides = {c.path: p for c in out if (p := indexes.get(h.column, {}).get(c.path))} if h.column in t.columns and len(out) > 1 else {}
            have = self.holding(t, h, sides) if sides else None
            if have is not None:
                out = [c for c in out if c.path not in sides or c.path.rsplit("/", 1)[1] in have]
        return out

    @staticmethod
    def _may(t: Table, c: Chunk, h: Hint) -> bool:
        if h.column not in t.columns or h.column not in c.zones:
            return True
        kind = t.columns[h.column].kind
        try:
            values = [_compare_as(kind, v) for v in h.values]
            low, high = (None if v is None else _compare_as(kind, v) for v in c.zones[h.column])
        except (TypeError, ValueError, ArithmeticError):
            return True
        if low is None:
            return False
        try:
            return _overlaps(h.op, values, low, high)
        except ArithmeticError:  # NaN has no place in the order of Decimals
            return True


def _compare_as(kind: str, v):
    if isinstance(v, bool) or (kind == "boolean"):
        return str(v).lower()
    if kind in ("integer", "decimal", "real"):
        if isinstance(v, str) and kind == "integer":
            return Decimal(v)
        return Decimal(str(v))
    if not isinstance(v, str):
        raise TypeError(v)
    return v


def _overlaps(op: str, values: list, low, high) -> bool:
    match op:
        case "=" | "in":
            return any(low <= v <= high for v in values)
        case "<":
            return low < values[0]
        case "<=":
            return low <= values[0]
        case ">":
            return high > values[0]
    return high >= values[0]


@dataclass
class View:
    """A catalog over one state; what it leaves out never changes an answer."""

    chunks: Chunks
    state: State
    overlay: dict[str, DataFrame] = field(default_factory=dict)
    stats: Stats = field(default_factory=Stats)

    def table(self, name: str) -> Table:
        if name not in self.state.schema:
            raise StrataError("UNKNOWN_TABLE", f"no table {name}")
        return self.state.schema[name]

    def frame(self, name: str, hints: list[Hint]) -> DataFrame:
        t = self.table(name)
        kept = self.chunks.prune(name, self.state, hints)
        self.stats.chunks_total += len(self.state.chunks.get(name, []))
        self.stats.chunks_fetched += len(kept)
        df = self.chunks.cached(t, kept)
        if name in self.overlay:
            pending = self.overlay[name].select(*df.columns).dropDuplicates([t.key])
            span = pending.agg(F.min(t.key), F.max(t.key)).first()
            near = [] if span[0] is None else [Hint(t.key, ">=", (span[0],)), Hint(t.key, "<=", (span[1],))]
            keys = self.chunks.read(t, self.chunks.prune(name, self.state, near)).select(t.key)  # only files whose keys reach into the landed ones
            df = df.unionByName(pending.join(keys, t.key, "left_anti"))
        return df
