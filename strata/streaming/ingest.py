"""The append tier: an INSERT is acknowledged after one durable file write and folded later.

Landed rows lie as JSON files below queue/<table>. The fold is a file stream that takes
what is there and ends; each micro-batch appends the rows whose key is not stored yet, so
a batch that runs again, or ids that two batches repeat, change nothing. Lines that do
not parse go to quarantine/<table> as they are, and rows without the key as JSON, before their file goes.
A fold holds a lease, so that two do not do the same work; were it lost, both would be right.
"""

from __future__ import annotations

import json
import time
from decimal import Decimal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strata.plans import nodes as n
from strata.schema import ulid
from strata.sources.log import Lease, State

FOLD_TTL_S = 60.0


def eligible(db, s) -> bool:
    """An INSERT that can neither conflict nor read."""
    if not isinstance(s, n.Insert) or s.conflict is not None or s.table not in db.schema:
        return False
    t = db.log.state().schema.get(s.table)
    if t is None or t.uniques or any(x.unique for x in t.columns.values()) or t.key in s.columns:
        return False
    plain = all(not isinstance(x, n.Subquery) for row in s.rows for e in row for x in n.walk(e))
    return plain and set(s.columns) <= set(db.schema[s.table].columns)


def land(db, s: n.Insert) -> DataFrame | int:
    """Write the rows to the queue; their keys are final."""
    state = db.log.state()
    t = state.schema[s.table]
    rows = db.writer.prepare(state, s)
    body = "\n".join(json.dumps({c: str(v) if isinstance(v, Decimal) else v for c, v in r.items()}) for r in rows)
    if not db.files.create(f"queue/{s.table}/{ulid()}.json", body.encode()):
        raise RuntimeError("a fresh id was taken")
    if s.returning is None:
        return len(rows)
    return db.writer.returning(state, s, db.spark.createDataFrame([tuple(r[c] for c in t.columns) for r in rows], t.struct))


def pending(db, state: State) -> dict[str, DataFrame]:
    """Landed rows by table, folded or not; a scan leaves out keys that are stored."""
    out = {}
    for name in db.files.list("queue"):
        if name in state.schema and any(x.endswith(".json") for x in db.files.list(f"queue/{name}")):
            out[name] = db.spark.read.schema(state.schema[name].struct).option("mode", "DROPMALFORMED").json(f"{db.files.uri}/queue/{name}/*.json")
    return out


def fold(db, wait_s: float = 30.0) -> int:
    """Move landed rows into the tables; returns how many were new."""
    if not any(db.files.list(f"queue/{name}") for name in db.files.list("queue")):
        return 0
    lease, until = Lease(db.files, "fold", FOLD_TTL_S), time.monotonic() + wait_s
    while not lease.take() and time.monotonic() < until:
        time.sleep(0.05)
    try:
        total = 0
        for name in db.files.list("queue"):
            names = [x for x in db.files.list(f"queue/{name}") if x.endswith(".json")]
            if not names or name not in db.log.state().schema:
                continue
            total += _fold_table(db, name)
            for x in names:
                db.files.delete(f"queue/{name}/{x}")
        return total
    finally:
        lease.release()


def _fold_table(db, name: str) -> int:
    t, added, run = db.log.state().schema[name], [], ulid()
    while (corrupt := f"_line{len(added)}") in t.columns:
        added.append(0)
    added.clear()

    def batch(df: DataFrame, k: int) -> None:
        df = df.persist()
        bad = F.col(corrupt).isNotNull() | F.col(f"`{t.key}`").isNull()
        rows = df.filter(~bad).select(*[f"`{c}`" for c in t.columns])

        def plan(state: State) -> State | None:
            made = db.writer.append(state, name, rows, skip_existing=True)
            added.append(made.count)
            return made.state if made.count else None

        try:
            lost = df.filter(bad)
            if not lost.isEmpty():
                text = F.coalesce(F.col(corrupt), F.to_json(F.struct(*[f"`{c}`" for c in t.columns])))
                lost.select(text.alias("value")).write.mode("overwrite").text(f"{db.files.uri}/quarantine/{name}/{run}-{k}")
            db._commit(plan)
        finally:
            df.unpersist()

    stream = db.spark.readStream.schema(T.StructType([*t.struct.fields, T.StructField(corrupt, T.StringType())])).option("columnNameOfCorruptRecord", corrupt).json(f"{db.files.uri}/queue/{name}")
    query = stream.writeStream.foreachBatch(batch).option("checkpointLocation", f"{db.files.uri}/_fold/{name}-{run}").trigger(availableNow=True).start()
    query.awaitTermination()
    db.files.delete(f"_fold/{name}-{run}")
    return sum(added)
