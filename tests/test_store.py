import json
import threading
import time
import uuid
from datetime import UTC, datetime, timedelta
from decimal import Decimal

import pytest

from strata import schema as S
from strata.cli import main
from strata.errors import FormatError, StrataError
from strata.session import Database
from strata.sources.log import Files, Lease
from strata.streaming import ingest, ordered


def notes():
    return S.define(
        {
            "notes": {"id": S.text().primary_key(), "body": S.text(), "score": S.integer(), "at": S.timestamp().partition_by(), "tag": S.text().index()},
            "grants": {"id": S.text().primary_key(), "who": S.text(), "what": S.text(), "level": S.integer()},
            "invoices": {"number": S.sequence().primary_key(), "customer": S.text().refers_to("notes.id"), "total": S.decimal(2)},
        },
        {"grants": [("who", "what")]},
    )


@pytest.fixture
def db(spark, tmp_path):
    return Database(spark, str(tmp_path / "db"), notes())


def code(f, *a, **k):
    with pytest.raises(StrataError) as e:
        out = f(*a, **k)
        if hasattr(out, "collect"):
            out.collect()
    return e.value.code


def test_insert_upsert_and_unique(db):
    assert db.query("INSERT INTO notes (id, body, score) VALUES ('a', 'x', 1), ('b', NULL, 2)") == 2
    assert code(db.query, "INSERT INTO notes (id) VALUES ('a')") == "PRIMARY_KEY_CONFLICT"
    assert code(db.query, "INSERT INTO notes (id) VALUES ('q'), ('q')") == "PRIMARY_KEY_CONFLICT"
    got = db.query("INSERT INTO notes (id, score) VALUES ('a', 5), ('a', 6), ('c', 1) ON CONFLICT (id) DO UPDATE SET score = score + excluded.score RETURNING id, score").collect()
    assert sorted(map(tuple, got)) == [("a", 12), ("c", 1)]
    assert db.query("INSERT INTO notes (id) VALUES ('a'), ('d') ON CONFLICT DO NOTHING") == 1
    db.query("INSERT INTO grants (id, who, what) VALUES ('1', 'u', 'f'), ('2', 'u', NULL), ('3', 'u', NULL)")
    assert code(db.query, "INSERT INTO grants (id, who, what) VALUES ('4', 'u', 'f')") == "UNIQUE_CONFLICT"
    assert code(db.query, "INSERT INTO grants (id, who, what) VALUES ('1', 'v', 'f') ON CONFLICT (who, what) DO NOTHING") == "PRIMARY_KEY_CONFLICT"
    assert code(db.query, "INSERT INTO grants (id) VALUES ('9') ON CONFLICT (level) DO NOTHING") == "INVALID_CONFLICT_TARGET"
    assert code(db.query, "UPDATE grants SET what = 'f' WHERE id = '2'") == "UNIQUE_CONFLICT"


def test_update_delete_keep_null_rows(db):
    db.query("INSERT INTO notes (id, body, score) VALUES ('a', 'x', 1), ('b', NULL, 2), ('c', 'y', NULL)")
    assert code(db.query, "DELETE FROM notes") == "MISSING_WHERE"
    assert db.query("DELETE FROM notes WHERE body = 'x'") == 1
    assert sorted(r.id for r in db.query("SELECT id FROM notes").collect()) == ["b", "c"]
    assert db.query("UPDATE notes SET score = score + 1, body = 'z' WHERE score > 0 RETURNING id, score").collect() == [("b", 3)]
    assert code(db.query, "UPDATE notes SET score = 'x' WHERE id = 'b'") == "TYPE_MISMATCH"
    assert db.query("UPDATE notes SET body = 'all'", allow_full_table=True) == 2
    assert db.query("DELETE FROM notes WHERE id IN (SELECT id FROM notes WHERE score = 3)") == 1


def test_sequences_and_decimals(db, spark):
    db.query("INSERT INTO invoices (customer, total) VALUES ('a', '0.10'), ('b', 0.20)")
    other = Database(spark, db.files.root, notes())
    other.query("INSERT INTO invoices (customer, total) VALUES ('c', 9.5)")
    got = {r.number: r.total for r in db.query("SELECT number, total FROM invoices").collect()}
    assert len(got) == 3 and sum(got.values()) == Decimal("9.80")
    assert code(db.query, "INSERT INTO invoices (total) VALUES (1.005)") == "TYPE_MISMATCH"
    assert code(db.query, "UPDATE invoices SET total = total * 1.001 WHERE number = 1") == "TYPE_MISMATCH"


def test_versions(db):
    db.query("INSERT INTO notes (id) VALUES ('a')")
    v = db.current_version()
    db.query("DELETE FROM notes WHERE id = 'a'")
    old = db.as_of(v)
    assert old.query("SELECT COUNT(*) AS n FROM notes").first().n == 1
    assert code(old.query, "DELETE FROM notes WHERE id = 'a'") == "READ_ONLY"
    assert code(db.as_of, 99) == "VERSION_NOT_FOUND"
    assert code(db.as_of, datetime.now(UTC) - timedelta(days=9)) == "VERSION_NOT_FOUND"
    assert db.as_of(datetime.now(UTC)).query("SELECT COUNT(*) AS n FROM notes").first().n == 0
    assert db.rollback_to(v) == v + 2
    assert db.inspect()["tables"]["notes"]["rows"] == 1
    done = db.vacuum(keep_days=0, keep_versions=1, grace_s=0)
    assert done["kept_from"] == v + 2 and db.query("SELECT id FROM notes").first().id == "a"
    assert code(Database(db.spark, db.files.root, notes()).log.state, 1) == "VERSION_NOT_FOUND"


def test_transactions(db):
    v = db.current_version()

    def both(tx):
        tx.query("INSERT INTO notes (id, score) VALUES ('a', 1)")
        tx.query("UPDATE notes SET score = score + 1 WHERE id = 'a'")
        return tx.query("SELECT score FROM notes").first().score

    assert db.transaction(both) == 2 and db.current_version() == v + 1
    with pytest.raises(ZeroDivisionError):
        db.transaction(lambda tx: (tx.query("DELETE FROM notes WHERE id = 'a'"), 1 // 0))
    assert db.transaction(lambda tx: tx.query("SELECT COUNT(*) AS n FROM notes").first().n) == 1
    assert db.current_version() == v + 1


def test_create_from_a_frame_and_increment(db, spark):
    frame = spark.createDataFrame([(1, 2.5, "x"), (2, None, "y")], "k long, v double, t string")
    assert db.create_from("frames", frame, "k") == 2
    assert db.increment("frames", 1, "v", 2) == 4.5
    assert code(db.increment, "frames", 9, "v") == "ROW_NOT_FOUND"
    assert code(db.create_from, "frames", frame, "k") == "UNKNOWN_TABLE"


def test_definitions(db):
    db.query("CREATE TABLE t (k integer PRIMARY KEY, v decimal(10, 2), w text UNIQUE)")
    db.query("INSERT INTO t (k, v) VALUES (1, 2.5)")
    db.query("ALTER TABLE t ADD COLUMN extra real")
    assert db.query("SELECT k, v, extra FROM t").collect() == [(1, Decimal("2.50"), None)]
    assert code(db.query, "ALTER TABLE t ADD extra text") == "DUPLICATE_COLUMN"
    assert code(db.query, "CREATE TABLE u (a geometry)") == "UNKNOWN_TYPE"
    assert code(db.query, "DROP INDEX ON t(k)") == "INDEX_NOT_FOUND"
    db.query("CREATE INDEX ON t(v)")
    assert code(db.query, "CREATE INDEX ON t(v)") == "INDEX_EXISTS"
    db.query("CREATE INDEX IF NOT EXISTS ON t(v)")
    db.query("DROP INDEX ON t(v)")
    db.query("DROP TABLE t")
    assert code(db.query, "SELECT k FROM t") == "UNKNOWN_TABLE"


def test_pruned_scan_equals_full_scan(db):
    for m in range(4):
        db.query("INSERT INTO notes (id, at, tag, score) VALUES (?, ?, ?, 1), (?, ?, ?, 2)", f"m{m}a", f"2026-0{m + 1}-05T00:00:00Z", "x" if m % 2 else "￿", f"m{m}b", f"2026-0{m + 1}-20T00:00:00Z", "y")
    for where, chunks in (("at BETWEEN '2026-02-01' AND '2026-02-28'", 1), ("id = 'm3b'", 1), ("tag = 'x'", 2), ("tag > 'y'", 2), ("tag IN ('x', 'q')", 2), ("score = 1", 4), ("UPPER(id) = 'M1A'", 4), ("tag = 'none'", 0)):
        got = db.query(f"SELECT id FROM notes WHERE {where}")
        assert db.last_query_stats.chunks_fetched == chunks, where
        full = db.query(f"SELECT id FROM notes WHERE ({where}) OR id = 'no such'")
        assert sorted(got.collect()) == sorted(full.collect())
    db.query("UPDATE notes SET tag = 'x' WHERE id = 'm0a'")
    assert db.query("SELECT COUNT(*) AS n FROM notes WHERE tag = 'x'").first().n == 3


def test_one_winner_for_a_slot(spark, tmp_path):
    files = Files(spark, str(tmp_path))
    for k in range(20):
        won = []
        threads = [threading.Thread(target=lambda i=i: won.append(files.create(f"slot/{k}", b"%d" % i))) for i in range(8)]
        [t.start() for t in threads]
        [t.join() for t in threads]
        assert sum(won) == 1


def test_writers_of_one_store_lose_nothing(spark, tmp_path):
    root = str(tmp_path / "c")
    first = Database(spark, root, S.define({"hits": {"id": S.text().primary_key(), "n": S.integer()}}))
    first.query("INSERT INTO hits (id, n) VALUES ('x', 0)")

    def work():
        db = Database(spark, root)
        for _ in range(2):
            db.query("UPDATE hits SET n = n + 1 WHERE id = 'x'", attempts=60)

    threads = [threading.Thread(target=work) for _ in range(3)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert first.query("SELECT n FROM hits").first().n == 6


def test_append_tier(spark, tmp_path):
    schema = S.define({"events": {"id": S.uuid().primary_key(), "kind": S.text()}, "tickets": {"num": S.sequence().primary_key(), "note": S.text()}})
    db = Database(spark, str(tmp_path / "q"), schema, append_tier=True)
    v = db.current_version()
    assert db.query("INSERT INTO events (kind) VALUES ('a'), ('b') RETURNING id").count() == 2
    assert db.query("INSERT INTO tickets (note) VALUES ('n')") == 1
    assert db.current_version() == v and db.query("SELECT COUNT(*) AS n FROM events").first().n == 2
    assert ingest.fold(db) == 3 and ingest.fold(db) == 0
    assert db.query("SELECT COUNT(*) AS n FROM events").first().n == 2
    db.query("INSERT INTO events (kind) VALUES ('c')")
    assert db.query("UPDATE events SET kind = 'z' WHERE kind = 'c'") == 1


def test_fold_again_after_a_lost_delete(spark, tmp_path):
    db = Database(spark, str(tmp_path / "r"), S.define({"items": {"id": S.uuid().primary_key(), "label": S.text()}}), append_tier=True)
    db.query("INSERT INTO items (label) VALUES ('a')")
    name = db.files.list("queue/items")[0]
    data = db.files.read(f"queue/items/{name}")
    ingest.fold(db)
    db.files.create(f"queue/items/{uuid.uuid4().hex}.json", data)
    assert db.query("SELECT COUNT(*) AS n FROM items").first().n == 1
    assert ingest.fold(db) == 0 and db.query("SELECT COUNT(*) AS n FROM items").first().n == 1


def test_drift(spark, tmp_path):
    root = str(tmp_path / "d")
    Database(spark, root, S.define({"t": {"id": S.text().primary_key(), "a": S.integer()}}))
    db = Database(spark, root, S.define({"t": {"id": S.text().primary_key(), "a": S.integer(), "b": S.text()}, "u": {"x": S.text()}}))
    assert list(db.log.state().schema["t"].columns) == ["id", "a", "b"] and db.log.state().schema["u"].key == "id"
    assert code(Database, spark, root, S.define({"t": {"id": S.text().primary_key(), "a": S.real()}})) == "SCHEMA_DRIFT"


@pytest.mark.parametrize(
    "make,expected",
    [
        (lambda: S.define({"t": {"a": S.text().primary_key(), "b": S.text().primary_key()}}), "MULTIPLE_PRIMARY_KEYS"),
        (lambda: S.define({"t": {"id": S.text()}}), "AMBIGUOUS_ID_COLUMN"),
        (lambda: S.define({"t": {"a": S.text().partition_by(), "b": S.text().partition_by()}}), "MULTIPLE_PARTITION_COLUMNS"),
        (lambda: S.decimal(2).primary_key(), "INVALID_PRIMARY_KEY"),
        (lambda: S.decimal(13), "INVALID_SCALE"),
        (lambda: S.json(), "UNSUPPORTED_COLUMN_TYPE"),
        (lambda: S.define({"t": {"a": S.text()}}, {"t": [("a",)]}), "INVALID_COMPOSITE_UNIQUE"),
        (lambda: S.define({"t": {"a": S.text()}}, {"t": [("a", "z")]}), "UNKNOWN_COLUMN"),
        (lambda: S.define({"t": {"a": S.text()}}, {"u": [("a", "z")]}), "UNKNOWN_TABLE"),
    ],
)
def test_schema_rules(make, expected):
    assert code(make) == expected


def test_ids_are_ordered():
    u = [S.uuid7() for _ in range(3000)]
    assert u == sorted(set(u)) and u[0][14] == "7"
    x = [S.ulid() for _ in range(3000)]
    assert x == sorted(set(x)) and len(x[0]) == 26


def test_newer_format_is_refused(db):
    v = db.current_version()
    db.files.create(f"_log/{v + 1:012d}.json", json.dumps({"format": 99, "version": v + 1, "commit": "x", "at": 0, "tables": {}}).encode())
    with pytest.raises(FormatError):
        db.query("SELECT id FROM notes")


def test_exports(db, tmp_path):
    db.query("INSERT INTO notes (id, body, score) VALUES ('a', ?, 1), ('b', NULL, NULL)", 'tab\tline\n"quote", back\\')
    db.query("INSERT INTO invoices (customer, total) VALUES ('a', 1.5)")
    assert db.export("csv")["notes"].startswith("id,body,score,at,tag\na,\"tab\tline\n\"\"quote\"\", back\\\",1,,\nb,,,,")
    assert db.export("json")["invoices"] == [{"number": 1, "customer": "a", "total": "1.50"}]
    script = db.export("postgres")
    assert 'a\ttab\\tline\\n"quote", back\\\\\t1\t\\N\t\\N' in script and script.index("FOREIGN KEY") > script.rindex("COPY") and script.endswith("COMMIT;\n")
    import sqlite3

    with sqlite3.connect(db.export("sqlite", str(tmp_path / "x.sqlite"))) as c:
        assert c.execute("SELECT total FROM invoices").fetchall() == [("1.50",)]
    assert code(db.export, "xml") == "EXPORT_UNAVAILABLE"


def test_cli(spark, tmp_path, capsys):
    root = str(tmp_path / "cli")
    Database(spark, root, notes())
    assert main([root, "sql", "INSERT INTO notes (id) VALUES ('a')"], spark) == 0
    assert main([root, "sql", "SELECT id FROM notes"], spark) == 0
    assert "1/1 chunks" in capsys.readouterr().out
    assert main([root, "sql", "SELECT FROM"], spark) == 1
    assert main([root, "export", "csv", "--out", str(tmp_path / "o.csv")], spark) == 0
    assert main([root, "version"], spark) == 0


def jobs_of(db, run):
    """Spark jobs that a call starts."""
    tracker, group = db.spark.sparkContext.statusTracker(), uuid.uuid4().hex
    db.spark.sparkContext.setJobGroup(group, "count")
    try:
        run()
        return len(tracker.getJobIdsForGroup(group))
    finally:
        db.spark.sparkContext.setJobGroup("", "")


def test_an_upsert_takes_the_same_jobs_whatever_its_rows(db):
    db.query("INSERT INTO notes (id, score) VALUES " + ", ".join(f"('k{k}', {k})" for k in range(40)))

    def upsert(n):
        values = ", ".join(f"('k{k}', 1 + {k}, UPPER('a{k}'))" for k in range(n))
        return lambda: db.query(f"INSERT INTO notes (id, score, body) VALUES {values} ON CONFLICT (id) DO UPDATE SET score = notes.score + excluded.score, body = excluded.body")

    assert jobs_of(db, upsert(30)) <= jobs_of(db, upsert(1)) + 2
    got = {r.id: (r.score, r.body) for r in db.query("SELECT id, score, body FROM notes").collect()}
    assert got["k0"] == (2, "A0") and got["k29"] == (59, "A29") and got["k30"] == (30, None)


def test_an_upsert_that_repeats_keys_and_moves_them(db):
    db.query("INSERT INTO notes (id, score) VALUES ('a', 1), ('b', 2)")
    n = db.query("INSERT INTO notes (id, score) VALUES ('a', 10), ('c', 5), ('a', 100), ('c', 50), ('b', 0) ON CONFLICT (id) DO UPDATE SET score = notes.score + excluded.score")
    assert n == 3 and sorted(db.query("SELECT id, score FROM notes").collect()) == [("a", 111), ("b", 2), ("c", 55)]


def test_a_scalar_subquery_runs_once_and_prunes(db):
    for m in range(3):
        db.query("INSERT INTO notes (id, at, score) VALUES (?, ?, ?)", f"m{m}", f"2026-0{m + 1}-05T00:00:00Z", m)
    run = lambda sql: (lambda: db.query(sql).collect())
    assert jobs_of(db, run("SELECT id FROM notes WHERE score > (SELECT AVG(score) FROM notes)")) <= jobs_of(db, run("SELECT id FROM notes WHERE score > 1.0")) + jobs_of(db, run("SELECT AVG(score) AS x FROM notes")) + 1
    assert db.query("SELECT id FROM notes WHERE at = (SELECT MAX(at) FROM notes)").collect() == [("m2",)]
    assert db.last_query_stats.chunks_fetched == 3 + 1


def test_nan_in_a_zone_column_keeps_the_file(spark, tmp_path):
    db = Database(spark, str(tmp_path / "nan"), S.define({"t": {"k": S.integer().primary_key(), "v": S.real().partition_by()}}))
    db.load("t", spark.createDataFrame([(1, float("nan")), (2, 1.0)], "k long, v double"))
    db.load("t", spark.createDataFrame([(3, 5.0)], "k long, v double"))
    assert [r.k for r in db.query("SELECT k FROM t WHERE v < 2.0").collect()] == [2]


def test_an_index_of_many_values_and_kinds(spark, tmp_path):
    db = Database(spark, str(tmp_path / "ix"), S.define({"t": {"k": S.integer().primary_key(), "n": S.integer().index(), "d": S.decimal(2).index(), "x": S.real().index(), "s": S.text().index()}}))
    for part in range(3):
        rows = spark.range(part * 20000, part * 20000 + 20000).selectExpr("id AS k", "id AS n", "CAST(id AS DECIMAL(18,2)) / 4 AS d", "id / 8 AS x", "concat('s', id % 100 + 100 * %d) AS s".replace("%d", str(part)))
        db.load("t", rows.selectExpr("k", "n", "CAST(d AS DECIMAL(18,2)) AS d", "x", "s"))
    for where, n in (("n = 25000", 1), ("n IN (1, 45000)", 2), ("n > 39999", 20000), ("d = 5000.25", 1), ("x >= 5000", 20000), ("s = 's150'", 200), ("n = 25000.0", 1), ("s < 's1'", 200)):
        total = db.query(f"SELECT COUNT(*) AS c FROM t WHERE {where}").first().c
        stats = db.last_query_stats
        assert total == n and 0 < stats.chunks_fetched < stats.chunks_total, where
    entry = json.loads(db.files.read(f"_log/{db.current_version():012d}.json"))
    assert "indexes" not in entry and all(len(x["add"]) < db.last_query_stats.chunks_total for x in entry["index_changes"]["t"].values())


def test_commits_that_wait_are_published_together(db):
    db.query("INSERT INTO notes (id, score) VALUES ('n', 0)")
    before, gate = db.current_version(), threading.Event()
    errors = []

    def add(k):
        gate.wait()
        try:
            db.query("INSERT INTO notes (id) VALUES ('n')" if k == 5 else "UPDATE notes SET score = score + 1 WHERE id = 'n'")
        except StrataError as e:
            errors.append(e.code)

    threads = [threading.Thread(target=add, args=(k,)) for k in range(10)]
    for t in threads:
        t.start()
    gate.set()
    for t in threads:
        t.join()
    assert errors == ["PRIMARY_KEY_CONFLICT"] and db.query("SELECT score FROM notes").first().score == 9
    assert before < db.current_version() < before + 9


def test_ordered_statements_of_several_instances(db, spark):
    db.query("INSERT INTO notes (id, score) VALUES ('n', 0)")
    others = [Database(spark, db.files.root, notes()) for _ in range(3)]
    before, out = db.current_version(), []

    def send(o, k):
        try:
            out.append(o.ordered("UPDATE notes SET score = score + ? WHERE id = 'n'" if k else "UPDATE notes SET nothing = ? WHERE id = 'n'", 1))
        except StrataError as e:
            out.append(e.code)

    threads = [threading.Thread(target=send, args=(o, k)) for k in range(4) for o in others]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert sorted(map(str, out)) == ["1"] * 9 + ["UNKNOWN_COLUMN"] * 3
    assert db.query("SELECT score FROM notes").first().score == 9 and db.current_version() - before < 12
    assert code(db.ordered, "SELECT id FROM notes") == "UNSUPPORTED_FEATURE"
    Lease(db.files, "ordered", 60).take()
    assert code(lambda: db.ordered("DELETE FROM notes WHERE id = 'n'", timeout_s=0.2)) == "VERDICT_TIMEOUT" and db.files.list("ordered") == []


def test_a_settled_statement_is_not_run_again(db):
    db.query("INSERT INTO notes (id, score) VALUES ('n', 0)")
    v = db.current_version()
    db.ordered("UPDATE notes SET score = score + 1 WHERE id = 'n'")
    name = next(iter(json.loads(db.files.read(f"_log/{v + 1:012d}.json"))["verdicts"]))
    db.files.create(f"ordered/{name}.json", json.dumps({"sql": "UPDATE notes SET score = score + 1 WHERE id = 'n'", "params": [], "after": v}).encode())
    assert ordered.lead(db) == 1 and db.query("SELECT score FROM notes").first().score == 1 and db.files.list("ordered") == []


def test_leases(db):
    a, b = Lease(db.files, "x", 0.3), Lease(db.files, "x", 0.3)
    assert a.take() and a.take() and not b.take()
    a.release()
    assert b.take() and not a.take()
    time.sleep(0.35)
    assert a.take()


def test_formats_and_upgrade(spark, tmp_path):
    root = str(tmp_path / "old")
    db = Database(spark, root, S.define({"t": {"k": S.text().primary_key()}}), prefix="one/two", commit_log=False)
    assert db.files.root.endswith("one/two") and db.log.state().format == 1
    assert code(db.query, "ALTER TABLE t ADD COLUMN price decimal(10, 2)") == "FORMAT_REQUIRED" == code(db.ordered, "DELETE FROM t WHERE k = 'a'")
    assert code(lambda: Database(spark, f"{root}/one/two", S.define({"t": {"k": S.text().primary_key(), "p": S.decimal(2)}}))) == "FORMAT_REQUIRED"
    v = db.current_version()
    assert db.upgrade() == {"version": v + 1, "format": 2} == db.upgrade()
    db.query("ALTER TABLE t ADD COLUMN price decimal(10, 2)")
    assert db.as_of(v).state.format == 1
    assert Database(spark, root, store=db.files).log.state().format == 2


def test_publishing_by_rename_has_one_winner(db):
    files = db.files
    files.local = False
    got = []
    threads = [threading.Thread(target=lambda k=k: got.append(files.create("_log/race.json", f"{k}".encode()))) for k in range(6)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert got.count(True) >= 1 and files.read("_log/race.json").decode() in "012345" and not files.create("_log/race.json", b"x")


def test_lines_that_do_not_parse_are_kept_aside(spark, tmp_path):
    schema = S.define({"events": {"id": S.uuid().primary_key(), "kind": S.text()}})
    db = Database(spark, str(tmp_path / "q"), schema, append_tier=True)
    db.query("INSERT INTO events (kind) VALUES ('a')")
    db.files.create("queue/events/zz.json", b'{"id": "x", "kind": "b"}\n{"id": nonsense\n{"kind": "no key"}')
    assert ingest.fold(db) == 2 and db.files.list("queue/events") == []
    lost = sorted(r.value for r in spark.read.text(f"{db.files.uri}/quarantine/events/*").collect())
    assert lost == ['{"id": nonsense', '{"kind":"no key"}']


def test_exports_to_a_folder_are_written_by_tasks(db, spark, tmp_path):
    db.query("INSERT INTO notes (id, body, score) VALUES ('a', 'x,\"y', 1), ('b', NULL, 2)")
    assert db.export("csv", str(tmp_path / "c")) == db.export("json", str(tmp_path / "c2")).replace("c2", "c")
    assert spark.read.json(str(tmp_path / "c2" / "notes")).count() == 2
    assert spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "c" / "notes")).filter("id = 'a'").first().body == 'x,"y'
    script = db.export("postgres", str(tmp_path / "p.sql"))
    assert script == str(tmp_path / "p.sql") and open(script).read() == db.export("postgres")


def test_kept_files_are_never_stale_and_bounded(spark, tmp_path):
    db = Database(spark, str(tmp_path / "kept"), S.define({"t": {"k": S.integer().primary_key(), "v": S.text()}}), cache_rows=25)
    db.load("t", spark.range(10).selectExpr("id AS k", "'old' AS v"))
    assert [db.query("SELECT COUNT(*) AS n FROM t WHERE v = 'old'").first().n for _ in range(2)] == [10, 10] and len(db.chunks._kept) == 1
    db.query("UPDATE t SET v = 'new' WHERE k < 4")
    assert db.query("SELECT COUNT(*) AS n FROM t WHERE v = 'old'").first().n == 6
    db.load("t", spark.range(100, 110).selectExpr("id AS k", "'old' AS v"))
    assert db.query("SELECT COUNT(*) AS n FROM t").first().n == 20 and sum(n for n, _ in db.chunks._kept.values()) <= 25
    db.query("ALTER TABLE t ADD COLUMN w text")
    assert db.query("SELECT w FROM t WHERE k = 1").collect() == [(None,)]
    db.load("t", spark.range(200, 300).selectExpr("id AS k", "'x' AS v"))
    assert db.query("SELECT COUNT(*) AS n FROM t").first().n == 120
