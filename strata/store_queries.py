"""Registered queries that write: each builds a small versioned store and returns its end state."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import time
import uuid
from concurrent.futures import ThreadPoolExecutor
from datetime import UTC, datetime
from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata import schema as S
from strata.errors import StrataError
from strata.session import Database


@cache
def _temporary() -> str:
    """A folder of this process, gone with it."""
    made = tempfile.mkdtemp(prefix="strata-")
    atexit.register(shutil.rmtree, made, True)
    return made


def fresh(spark: SparkSession, schema: dict[str, S.Table], **options) -> Database:
    """A new database in the folder that all machines share, or a temporary one without it."""
    base = spark.conf.get("spark.checkpoint.dir", None) or _temporary()
    return Database(spark, f"{base.rstrip('/')}/store-{uuid.uuid4().hex[:12]}", schema, **options)


def customers() -> dict[str, S.Table]:
    return S.define({"customers": {"id": S.integer().primary_key(), "name": S.text(), "segment": S.text().index(), "balance": S.real(), "nation": S.integer().partition_by()}})


def loaded(spark: SparkSession, sf_dir: str, **options) -> Database:
    db = fresh(spark, customers(), **options)
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet")
    db.load("customers", rows.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"), F.col("c_acctbal").alias("balance"), F.col("c_nationkey").alias("nation")))
    return db


ALL = "SELECT id, name, segment, balance, nation FROM customers"


def dml_insert_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = loaded(spark, sf_dir)
    db.query("INSERT INTO customers (id, name, nation) VALUES (1, 'one', 99), (-1, 'new', 98), (-1, 'newer', 97) ON CONFLICT (id) DO UPDATE SET name = customers.name || '+' || excluded.name, nation = excluded.nation")
    return db.query(ALL)


def dml_update_where(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = loaded(spark, sf_dir)
    db.query("UPDATE customers SET balance = 0, name = UPPER(name) WHERE segment = 'BUILDING' AND nation < 10")
    return db.query(ALL)


def dml_delete_where(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = loaded(spark, sf_dir)
    db.query("DELETE FROM customers WHERE nation BETWEEN 5 AND 9")
    return db.query(ALL)


def upsert_do_nothing(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = loaded(spark, sf_dir)
    db.query("INSERT INTO customers (id, name) VALUES (1, 'kept out'), (-5, 'let in') ON CONFLICT DO NOTHING")
    return db.query(ALL)


def time_travel_before_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = loaded(spark, sf_dir)
    before = db.current_version()
    db.query("DELETE FROM customers WHERE nation >= 0")
    return db.as_of(before).query(ALL)


def rollback_restores(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = loaded(spark, sf_dir)
    before = db.current_version()
    db.query("UPDATE customers SET name = 'x' WHERE id > 0")
    db.rollback_to(before)
    return db.query(ALL)


def alter_add_column_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = loaded(spark, sf_dir)
    db.query("ALTER TABLE customers ADD COLUMN note text")
    db.query("UPDATE customers SET note = 'first' WHERE id = 1")
    return db.query("SELECT id, note FROM customers")


def txn_atomic(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = loaded(spark, sf_dir)

    def good(tx):
        tx.query("DELETE FROM customers WHERE nation = 1")
        tx.query("UPDATE customers SET segment = 'NONE' WHERE nation = 2")

    def bad(tx):
        tx.query("DELETE FROM customers WHERE nation > 0")
        raise KeyError

    db.transaction(good)
    try:
        db.transaction(bad)
    except KeyError:
        pass
    return db.query(ALL)


def in_parts(spark: SparkSession, sf_dir: str, column: str, parts: list) -> Database:
    """The customers, loaded part by part by the values of a column, so that files lie apart in it."""
    db = fresh(spark, customers())
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet").selectExpr("c_custkey AS id", "c_name AS name", "c_mktsegment AS segment", "c_acctbal AS balance", "c_nationkey AS nation")
    for part in parts:
        db.load("customers", rows.filter(F.col(column).isin(part) if isinstance(part, list) else part))
    return db


def pruned(db: Database, sql: str) -> DataFrame:
    """A query that must read some files and leave some out."""
    out, stats = db.query(sql), db.last_query_stats
    if not 0 < stats.chunks_fetched < stats.chunks_total:
        raise AssertionError(f"{stats.chunks_fetched} of {stats.chunks_total} files read")
    return out


def zone_pruned_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = in_parts(spark, sf_dir, "nation", [[k, k + 1, k + 2, k + 3, k + 4] for k in range(0, 25, 5)])
    return pruned(db, ALL + " WHERE nation BETWEEN 6 AND 12")


def index_pruned_equality(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = in_parts(spark, sf_dir, "segment", [["AUTOMOBILE", "BUILDING"], ["FURNITURE", "HOUSEHOLD"], ["MACHINERY"], ~F.col("segment").isin("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")])
    return pruned(db, ALL + " WHERE segment = 'MACHINERY'")


def subquery_pruned(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = in_parts(spark, sf_dir, "nation", [[k, k + 1, k + 2, k + 3, k + 4] for k in range(0, 25, 5)])
    return pruned(db, ALL + " WHERE nation = (SELECT MAX(nation) FROM customers)")


def queued_events(spark: SparkSession, sf_dir: str) -> Database:
    """The events, landed in the append tier by tasks, a third of them twice."""
    schema = S.define({"events": {"id": S.text().primary_key(), "kind": S.text(), "value": S.real()}})
    db = fresh(spark, schema, append_tier=True)
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr("CAST(event_id AS STRING) AS id", "event_type AS kind", "value", "event_id % 3 AS third")
    for k, part in enumerate((rows, rows.filter("third = 0"))):
        part.drop("third").write.mode("append").json(f"{db.files.uri}/queue/events")
    return db


def fold_idempotent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events folded twice, with others landed again in between: each counts once."""
    from strata.streaming import ingest

    db = queued_events(spark, sf_dir)
    ingest.fold(db)
    spark.read.parquet(f"{sf_dir}/events.parquet").filter("event_id % 7 = 0").selectExpr("CAST(event_id AS STRING) AS id", "event_type AS kind", "value").write.mode("append").json(f"{db.files.uri}/queue/events")
    ingest.fold(db)
    ingest.fold(db)
    return db.query("SELECT kind, COUNT(*) AS n, MIN(value) AS low, MAX(value) AS top FROM events GROUP BY kind")


def overlay_before_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Landed rows are read before any fold."""
    return queued_events(spark, sf_dir).query("SELECT kind, COUNT(*) AS n, MIN(value) AS low, MAX(value) AS top FROM events GROUP BY kind")


def barrier_folds_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An ordered write comes after all that landed before it."""
    db = queued_events(spark, sf_dir)
    db.query("DELETE FROM events WHERE kind = 'error'")
    return db.query("SELECT kind, COUNT(*) AS n FROM events GROUP BY kind")


def returning_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    return loaded(spark, sf_dir).query("UPDATE customers SET balance = balance + 1, name = LOWER(name) WHERE nation = 3 RETURNING id, name, balance")


def returning_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    return loaded(spark, sf_dir).query("DELETE FROM customers WHERE nation > 20 RETURNING *")


def returning_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return loaded(spark, sf_dir).query("INSERT INTO customers (id, name, nation) VALUES (-1, UPPER('new') || '!', 1 + 2), (1, 'one', 9) ON CONFLICT (id) DO UPDATE SET nation = customers.nation + excluded.nation RETURNING id, name, nation")


def subquery_in_dml(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = loaded(spark, sf_dir)
    db.query("UPDATE customers SET balance = (SELECT MAX(balance) FROM customers) WHERE id IN (SELECT id FROM customers WHERE nation = 4)")
    db.query("INSERT INTO customers (id, balance) VALUES (-1, (SELECT MIN(balance) FROM customers))")
    return db.query("SELECT id, balance FROM customers")


def as_of_a_moment(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = loaded(spark, sf_dir)
    moment = datetime.fromtimestamp(db.log.state().at + 0.0005, UTC)
    time.sleep(0.002)
    db.query("DELETE FROM customers WHERE nation >= 0")
    return db.as_of(moment).query(ALL)


def vacuum_keeps_the_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = loaded(spark, sf_dir)
    db.query("UPDATE customers SET segment = 'ONE' WHERE nation = 1")
    db.query("DELETE FROM customers WHERE nation = 2")
    db.vacuum(keep_days=0, keep_versions=1, grace_s=0)
    return db.query(ALL)


def schemaless_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = fresh(spark, {})
    db.create_from("nations", spark.read.parquet(f"{sf_dir}/nation.parquet"), "n_nationkey")
    return db.query("SELECT n_nationkey, n_name, n_regionkey FROM nations")


def increments(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = loaded(spark, sf_dir)
    for by in (1, 10, -100):
        db.increment("customers", 1, "nation", by)
    return db.query(ALL)


def index_follows_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index made, used, kept up by UPDATE and INSERT, and dropped gives the same rows throughout."""
    db = loaded(spark, sf_dir)
    db.query("CREATE INDEX ON customers(name)")
    db.query("UPDATE customers SET name = 'moved' WHERE nation = 7")
    db.query("INSERT INTO customers (id, name, nation) VALUES (-7, 'moved', 7)")
    with_index = db.query("SELECT id, nation FROM customers WHERE name = 'moved'").collect()
    db.query("DROP INDEX ON customers(name)")
    out = db.query("SELECT id, nation FROM customers WHERE name = 'moved'")
    if sorted(with_index) != sorted(out.collect()):
        raise AssertionError("the index changed an answer")
    return out


def sequence_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = S.define({"invoices": {"number": S.sequence().primary_key(), "customer": S.text()}})
    db = fresh(spark, schema)
    other = Database(spark, db.files.uri, schema)
    for k, one in enumerate((db, other, db)):
        one.query("INSERT INTO invoices (customer) VALUES " + ", ".join(f"('c{k}')" for _ in range(20)))
    return db.query("SELECT customer, COUNT(DISTINCT number) AS n, MIN(number) > 0 AS from_one FROM invoices GROUP BY customer")


def ordered_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statements of two instances, queued and settled in order."""
    db = loaded(spark, sf_dir)
    other = Database(spark, db.files.uri, customers())
    for k in range(4):
        (db, other)[k % 2].ordered("UPDATE customers SET nation = nation * 2 + ? WHERE id = 1", k)
    return db.query(ALL)


def grouped_commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statements of several threads that wait for one commit land with it."""
    db = loaded(spark, sf_dir)
    with ThreadPoolExecutor(6) as pool:
        list(pool.map(lambda k: db.query("UPDATE customers SET nation = nation + 100 WHERE id = ?", k), range(1, 7)))
    return db.query(ALL)


def upgraded_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Data and history survive the step to the top format, which decimals need."""
    db = loaded(spark, sf_dir, commit_log=False)
    db.upgrade()
    db.query("ALTER TABLE customers ADD COLUMN price decimal(2)")
    db.query("UPDATE customers SET price = 1.25 WHERE nation = 1")
    return db.query("SELECT id, price FROM customers")


def exported_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = loaded(spark, sf_dir)
    folder = db.export("csv", f"{db.files.uri}/out")
    return spark.read.option("header", True).schema("id long, name string, segment string, balance double, nation long").csv(f"{folder}/customers")


def exported_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = loaded(spark, sf_dir)
    folder = db.export("json", f"{db.files.uri}/out")
    return spark.read.schema("id long, name string, segment string, balance double, nation long").json(f"{folder}/customers")


def null_keys_never_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = loaded(spark, sf_dir)
    db.query("UPDATE customers SET nation = NULL WHERE nation < 5")
    db.create_from("nations", spark.read.parquet(f"{sf_dir}/nation.parquet"), "n_nationkey")
    db.query("INSERT INTO nations (n_nationkey, n_name) VALUES (-1, NULL)")
    return db.query("SELECT c.id, n.n_name FROM customers c LEFT JOIN nations n ON c.nation = n.n_nationkey")


def parameters_bound(spark: SparkSession, sf_dir: str) -> DataFrame:
    return loaded(spark, sf_dir).query("SELECT id, name FROM customers WHERE nation IN (?, ?) AND segment = ? AND balance > ?", 3, 5, "BUILDING", 100.5)


def inspected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What inspect() and current_version() say of a store after three versions."""
    db = loaded(spark, sf_dir)
    db.query("DELETE FROM customers WHERE nation = 3")
    found = db.inspect()
    rows = [(t, x["rows"], len(x["columns"]), ",".join(x["indexes"]), found["version"] == db.current_version()) for t, x in found["tables"].items()]
    return spark.createDataFrame(rows, "name string, n_rows long, n_columns long, indexes string, latest boolean")


def generated_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys that the store gives: different, of the declared form, in the order of the rows."""
    db = fresh(spark, S.define({"notes": {"id": S.uuid().primary_key(), "n": S.integer()}}))
    db.query("INSERT INTO notes (n) VALUES " + ", ".join(f"({k})" for k in range(50)))
    return db.query("SELECT COUNT(DISTINCT id) AS ids, MIN(LENGTH(id)) AS low, MAX(LENGTH(id)) AS top, COUNT(DISTINCT SUBSTR(id, 15, 1)) AS kinds FROM notes")


def definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table made, extended, filled and read; another made and dropped."""
    db = loaded(spark, sf_dir)
    db.query("CREATE TABLE rates (k integer PRIMARY KEY, rate decimal(10, 2), note text UNIQUE)")
    db.query("ALTER TABLE rates ADD COLUMN extra real")
    db.query("INSERT INTO rates (k, rate, note) VALUES (3, 1.5, 'three'), (4, 2, NULL), (5, NULL, NULL)")
    db.query("CREATE TABLE gone (k integer PRIMARY KEY)")
    db.query("DROP TABLE gone")
    return db.query("SELECT c.id, r.rate, r.note, r.extra FROM customers c JOIN rates r ON c.nation = r.k")


def unique_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A column and a pair of columns that are unique; NULL never conflicts."""
    db = fresh(spark, {})
    db.query("CREATE TABLE people (id integer PRIMARY KEY, email text UNIQUE)")
    out = []
    for k, sql in enumerate((
        "INSERT INTO people (id, email) VALUES (1, 'a'), (2, NULL), (3, NULL)",
        "INSERT INTO people (id, email) VALUES (4, 'a')",
        "INSERT INTO people (id, email) VALUES (1, 'b')",
        "UPDATE people SET email = 'a' WHERE id = 2",
        "INSERT INTO people (id, email) VALUES (9, 'a') ON CONFLICT (email) DO UPDATE SET id = people.id + 10",
        "UPDATE people SET email = 'c' WHERE id > 1 AND email IS NULL",
    )):
        try:
            out.append((k, str(db.query(sql))))
        except StrataError as e:
            out.append((k, e.code))
    return spark.createDataFrame(out, "step int, outcome string")


# Statements the dialect refuses, and their codes.
REFUSED = {
    "SELECT n_name FROM nation RIGHT JOIN region ON nation.n_regionkey = region.r_regionkey": "UNSUPPORTED_FEATURE",
    "SELECT n_name FROM nation FULL JOIN region ON nation.n_regionkey = region.r_regionkey": "UNSUPPORTED_FEATURE",
    "SELECT n_name FROM nation CROSS JOIN region": "UNSUPPORTED_FEATURE",
    "SELECT n_name FROM nation NATURAL JOIN region": "UNSUPPORTED_FEATURE",
    "SELECT n_name FROM nation JOIN region USING (r_regionkey)": "UNSUPPORTED_FEATURE",
    "SELECT n_name FROM nation, region": "UNSUPPORTED_FEATURE",
    "SELECT n_name FROM nation JOIN region ON nation.n_regionkey < region.r_regionkey": "PARSE_ERROR",
    "SELECT n_name FROM nation UNION SELECT r_name FROM region": "UNSUPPORTED_FEATURE",
    "SELECT n_name FROM nation INTERSECT SELECT r_name FROM region": "MULTIPLE_STATEMENTS",
    "SELECT n_name FROM nation EXCEPT SELECT r_name FROM region": "MULTIPLE_STATEMENTS",
    "SELECT RANK() OVER (ORDER BY n_name) AS r FROM nation": "UNKNOWN_FUNCTION",
    "SELECT SUM(n_nationkey) OVER (PARTITION BY n_regionkey) AS s FROM nation": "UNSUPPORTED_FEATURE",
    "SELECT n_regionkey, COUNT(*) AS n FROM nation GROUP BY ROLLUP(n_regionkey)": "UNKNOWN_FUNCTION",
    "SELECT n_name FROM nation WHERE EXISTS (SELECT r_name FROM region)": "UNKNOWN_FUNCTION",
    "SELECT x.n_name FROM (SELECT n_name FROM nation) x": "UNSUPPORTED_FEATURE",
    "WITH x AS (SELECT n_name FROM nation) SELECT n_name FROM x": "PARSE_ERROR",
    "VALUES (1)": "PARSE_ERROR",
    "CREATE VIEW v AS SELECT n_name FROM nation": "UNSUPPORTED_FEATURE",
    "CREATE TRIGGER t AFTER INSERT ON nation": "UNSUPPORTED_FEATURE",
    "CREATE UNIQUE INDEX ON nation(n_name)": "UNSUPPORTED_FEATURE",
    "SELECT n_name, COUNT(*) AS n FROM nation GROUP BY n_regionkey": "NOT_GROUPED",
    "SELECT n_name FROM nowhere": "UNKNOWN_TABLE",
    "SELECT nothing FROM nation": "UNKNOWN_COLUMN",
    "SELECT n_name FROM nation WHERE n_regionkey = (SELECT r_regionkey FROM region)": "SUBQUERY_MULTIPLE_ROWS",
    "SELECT n_name FROM nation WHERE n_regionkey = (SELECT r_regionkey, r_name FROM region)": "SUBQUERY_SHAPE",
    "UPDATE nation SET n_name = 'x'": "MISSING_WHERE",
    "DELETE FROM nation": "MISSING_WHERE",
    "INSERT INTO nation (n_nationkey, n_nationkey) VALUES (1, 2)": "DUPLICATE_COLUMN",
    "INSERT INTO nation (n_nationkey, n_name) VALUES (0, 'again')": "PRIMARY_KEY_CONFLICT",
    "INSERT INTO nation (n_nationkey) VALUES (99) ON CONFLICT (n_name) DO NOTHING": "INVALID_CONFLICT_TARGET",
    "UPDATE nation SET n_regionkey = 'x' WHERE n_nationkey = 1": "TYPE_MISMATCH",
    "UPDATE nation SET n_nationkey = 0 WHERE n_nationkey = 1": "PRIMARY_KEY_CONFLICT",
    "CREATE TABLE u (a geometry)": "UNKNOWN_TYPE",
    "DROP INDEX ON nation(n_name)": "INDEX_NOT_FOUND",
    "ALTER TABLE nation ADD COLUMN n_name text": "DUPLICATE_COLUMN",
    "SELECT n.n_name FROM nation n JOIN region r ON n.n_regionkey = n.n_regionkey": "INVALID_JOIN_CONDITION",
    "SELECT p.n_name FROM nation p WHERE p.n_regionkey IN (SELECT r.r_regionkey FROM region r WHERE r.r_regionkey = p.n_regionkey)": "UNKNOWN_TABLE",
    "SELECT m.id FROM money m JOIN money k ON m.a = k.b": "TYPE_MISMATCH",
    "SELECT a + r AS x FROM money": "TYPE_MISMATCH",
    "SELECT a * 1.5e2 AS x FROM money": "TYPE_MISMATCH",
    "INSERT INTO money (id, a) VALUES (1, 1.005)": "TYPE_MISMATCH",
    "SELECT COUNT(MAX(n_name)) AS n FROM nation": "AGGREGATE_MISPLACED",
    "SELECT COUNT(*) AS n FROM nation GROUP BY COUNT(*)": "AGGREGATE_MISPLACED",
    "INSERT INTO nation (n_nationkey, n_name) VALUES (77)": "VALUE_COUNT_MISMATCH",
    "INSERT INTO nation (n_nationkey) VALUES (1) ON CONFLICT (n_nationkey) DO UPDATE SET n_name = 'x' WHERE n_regionkey = 1": "UNSUPPORTED_FEATURE",
    "ALTER TABLE nation DROP COLUMN n_name": "UNSUPPORTED_FEATURE",
    "CREATE INDEX ON nation(n_name, n_regionkey)": "UNSUPPORTED_FEATURE",
    "SELECT n_name FROM nation; SELECT r_name FROM region": "MULTIPLE_STATEMENTS",
}


def refused_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The code that each refused statement gives, and that none changes anything."""
    db = fresh(spark, {})
    for name, key in (("nation", "n_nationkey"), ("region", "r_regionkey")):
        db.create_from(name, spark.read.parquet(f"{sf_dir}/{name}.parquet"), key)
    db.query("CREATE TABLE money (id integer PRIMARY KEY, a decimal(10, 2), b decimal(10, 4), r real)")
    version, out = db.current_version(), []
    for sql in REFUSED:
        try:
            made = db.query(sql)
            out.append((sql, f"accepted: {made}"))
        except StrataError as e:
            out.append((sql, e.code))
    if db.current_version() != version:
        raise AssertionError("a refused statement left a version")
    return spark.createDataFrame(out, "statement string, code string")


QUERIES = {f.__name__: f for f in (dml_insert_upsert, dml_update_where, dml_delete_where, upsert_do_nothing, time_travel_before_delete, rollback_restores, alter_add_column_nulls, txn_atomic, zone_pruned_range, index_pruned_equality, subquery_pruned,
    fold_idempotent, overlay_before_fold, barrier_folds_first, returning_update, returning_delete, returning_insert, subquery_in_dml, as_of_a_moment,
    vacuum_keeps_the_latest, schemaless_table, increments, index_follows_changes, sequence_fill, ordered_statements, grouped_commits, upgraded_store,
    exported_csv, exported_json, null_keys_never_join, parameters_bound, inspected, generated_ids, definitions, unique_conflicts,
    refused_statements)}

_C = "c_custkey AS id, c_name AS name, c_mktsegment AS segment, c_acctbal AS balance, CAST(c_nationkey AS BIGINT) AS nation FROM customer"
_ALL = f"SELECT {_C}"
ORACLE_SQL = {
    "dml_insert_upsert": """SELECT c_custkey AS id, CASE WHEN c_custkey = 1 THEN c_name || '+one' ELSE c_name END AS name, c_mktsegment AS segment, c_acctbal AS balance,
        CASE WHEN c_custkey = 1 THEN 99 ELSE CAST(c_nationkey AS BIGINT) END AS nation FROM customer UNION ALL SELECT -1, 'new+newer', NULL, NULL, 97""",
    "dml_update_where": """SELECT c_custkey AS id, CASE WHEN c_mktsegment = 'BUILDING' AND c_nationkey < 10 THEN upper(c_name) ELSE c_name END AS name, c_mktsegment AS segment,
        CASE WHEN c_mktsegment = 'BUILDING' AND c_nationkey < 10 THEN 0 ELSE c_acctbal END AS balance, CAST(c_nationkey AS BIGINT) AS nation FROM customer""",
    "dml_delete_where": f"{_ALL} WHERE c_nationkey NOT BETWEEN 5 AND 9",
    "upsert_do_nothing": f"{_ALL} UNION ALL SELECT -5, 'let in', NULL, NULL, NULL",
    "time_travel_before_delete": _ALL,
    "rollback_restores": _ALL,
    "alter_add_column_nulls": "SELECT c_custkey AS id, CASE WHEN c_custkey = 1 THEN 'first' END AS note FROM customer",
    "txn_atomic": """SELECT c_custkey AS id, c_name AS name, CASE WHEN c_nationkey = 2 THEN 'NONE' ELSE c_mktsegment END AS segment, c_acctbal AS balance,
        CAST(c_nationkey AS BIGINT) AS nation FROM customer WHERE c_nationkey <> 1""",
    "zone_pruned_range": f"{_ALL} WHERE c_nationkey BETWEEN 6 AND 12",
    "index_pruned_equality": f"{_ALL} WHERE c_mktsegment = 'MACHINERY'",
    "subquery_pruned": f"{_ALL} WHERE c_nationkey = (SELECT max(c_nationkey) FROM customer)",
    "fold_idempotent": "SELECT event_type AS kind, count(*) AS n, min(value) AS low, max(value) AS top FROM events GROUP BY 1",
    "overlay_before_fold": "SELECT event_type AS kind, count(*) AS n, min(value) AS low, max(value) AS top FROM events GROUP BY 1",
    "barrier_folds_first": "SELECT event_type AS kind, count(*) AS n FROM events WHERE event_type <> 'error' GROUP BY 1",
    "returning_update": "SELECT c_custkey AS id, lower(c_name) AS name, c_acctbal + 1 AS balance FROM customer WHERE c_nationkey = 3",
    "returning_delete": f"{_ALL} WHERE c_nationkey > 20",
    "returning_insert": "SELECT -1::BIGINT AS id, 'NEW!' AS name, 3::BIGINT AS nation UNION ALL SELECT c_custkey, c_name, c_nationkey + 9 FROM customer WHERE c_custkey = 1",
    "subquery_in_dml": """SELECT c_custkey AS id, CASE WHEN c_nationkey = 4 THEN (SELECT max(c_acctbal) FROM customer) ELSE c_acctbal END AS balance FROM customer
        UNION ALL SELECT -1, (SELECT min(CASE WHEN c_nationkey = 4 THEN (SELECT max(c_acctbal) FROM customer) ELSE c_acctbal END) FROM customer)""",
    "as_of_a_moment": _ALL,
    "vacuum_keeps_the_latest": """SELECT c_custkey AS id, c_name AS name, CASE WHEN c_nationkey = 1 THEN 'ONE' ELSE c_mktsegment END AS segment, c_acctbal AS balance,
        CAST(c_nationkey AS BIGINT) AS nation FROM customer WHERE c_nationkey <> 2""",
    "schemaless_table": "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name, CAST(n_regionkey AS BIGINT) AS n_regionkey FROM nation",
    "increments": """SELECT c_custkey AS id, c_name AS name, c_mktsegment AS segment, c_acctbal AS balance,
        CAST(c_nationkey AS BIGINT) + CASE WHEN c_custkey = 1 THEN -89 ELSE 0 END AS nation FROM customer""",
    "index_follows_changes": "SELECT c_custkey AS id, CAST(c_nationkey AS BIGINT) AS nation FROM customer WHERE c_nationkey = 7 UNION ALL SELECT -7, 7",
    "sequence_fill": "SELECT * FROM (VALUES ('c0', 20::BIGINT, TRUE), ('c1', 20, TRUE), ('c2', 20, TRUE)) t(customer, n, from_one)",
    "ordered_statements": """SELECT c_custkey AS id, c_name AS name, c_mktsegment AS segment, c_acctbal AS balance,
        CASE WHEN c_custkey = 1 THEN CAST(c_nationkey AS BIGINT) * 16 + 11 ELSE CAST(c_nationkey AS BIGINT) END AS nation FROM customer""",
    "grouped_commits": """SELECT c_custkey AS id, c_name AS name, c_mktsegment AS segment, c_acctbal AS balance,
        CAST(c_nationkey AS BIGINT) + CASE WHEN c_custkey BETWEEN 1 AND 6 THEN 100 ELSE 0 END AS nation FROM customer""",
    "upgraded_store": "SELECT c_custkey AS id, CASE WHEN c_nationkey = 1 THEN CAST(1.25 AS DECIMAL(18,2)) END AS price FROM customer",
    "exported_csv": _ALL,
    "exported_json": _ALL,
    "null_keys_never_join": "SELECT c_custkey AS id, n_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey AND c_nationkey >= 5",
    "parameters_bound": "SELECT c_custkey AS id, c_name AS name FROM customer WHERE c_nationkey IN (3, 5) AND c_mktsegment = 'BUILDING' AND c_acctbal > 100.5",
    "inspected": "SELECT 'customers' AS name, count(*) AS n_rows, 5::BIGINT AS n_columns, 'segment' AS indexes, TRUE AS latest FROM customer WHERE c_nationkey <> 3",
    "generated_ids": "SELECT 50::BIGINT AS ids, 36::BIGINT AS low, 36::BIGINT AS top, 1::BIGINT AS kinds",
    "definitions": """SELECT c_custkey AS id, rate, note, CAST(NULL AS DOUBLE) AS extra FROM customer
        JOIN (VALUES (3, CAST(1.5 AS DECIMAL(10,2)), 'three'), (4, 2, NULL), (5, NULL, NULL)) r(k, rate, note) ON c_nationkey = k""",
    "unique_conflicts": "SELECT * FROM (VALUES (0, '3'), (1, 'UNIQUE_CONFLICT'), (2, 'PRIMARY_KEY_CONFLICT'), (3, 'UNIQUE_CONFLICT'), (4, '1'), (5, 'UNIQUE_CONFLICT')) t(step, outcome)",
    "refused_statements": "SELECT * FROM (VALUES " + ", ".join("('{}', '{}')".format(q.replace("'", "''"), code) for q, code in REFUSED.items()) + ") t(statement, code)",
}
