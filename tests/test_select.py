from decimal import ROUND_HALF_UP, Decimal

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from strata.errors import StrataError
from strata.sources.folder import Folder


@pytest.fixture(scope="module")
def db(spark):
    views = {
        "people": spark.createDataFrame([(1, "Ada", 10.0, True), (2, "Bob", None, False), (3, None, 30.5, None), (4, "ada", -2.0, True)], "id long, name string, score double, ok boolean"),
        "pets": spark.createDataFrame([(10, 1, "cat"), (11, 1, "dog"), (12, 2, "cat"), (13, None, "owl")], "id long, owner long, kind string"),
        "money": spark.createDataFrame([(1, Decimal("9.50")), (2, Decimal("0.10")), (3, Decimal("0.20")), (4, None)], "id long, price decimal(18,2)"),
        "staff": spark.createDataFrame([("a", None), ("b", "a"), ("c", "a")], "id string, boss string"),
        "docs": spark.createDataFrame([(1, '{"user":{"name":"Ada"},"tags":["x","y"],"n":5}'), (2, "broken")], "id long, body string"),
        "times": spark.createDataFrame([("2026-06-05T10:20:30Z",), ("2026-06-30T00:00:00Z",), ("2026-07-01T00:00:00Z",)], "at string"),
        "empty": spark.createDataFrame([], "id long, name string"),
    }
    return Folder(spark, "/nowhere", views)


def rows(db, sql, *params):
    return sorted((tuple(r) for r in db.query(sql, *params).collect()), key=repr)


@pytest.mark.parametrize(
    "where,ids",
    [
        ("name = 'Ada'", [1]),
        ("NOT (name = 'Ada')", [2, 3, 4]),
        ("NOT (NOT (name = 'Ada'))", [1]),
        ("name <> 'Ada'", [2, 4]),
        ("name NOT IN ('Ada', NULL)", [2, 4]),
        ("name IN ('Ada', NULL)", [1]),
        ("NOT (name IN ('Ada'))", [2, 3, 4]),
        ("score NOT BETWEEN 0 AND 20", [3, 4]),
        ("NOT (score BETWEEN 0 AND 20)", [2, 3, 4]),
        ("name LIKE 'A%'", [1]),
        ("name LIKE '_ob'", [2]),
        ("name NOT LIKE 'A%'", [2, 4]),
        ("score IS NULL", [2]),
        ("ok", [1, 4]),
        ("NOT ok", [2, 3]),
        ("ok = FALSE", [2]),
        ("score > 5 OR name = 'Bob'", [1, 2, 3]),
        ("name = NULL", []),
        ("id = '2'", [2]),
    ],
)
def test_two_valued_filters(db, where, ids):
    assert [r[0] for r in rows(db, f"SELECT id FROM people WHERE {where}")] == ids


def test_projected_comparison_is_never_null(db):
    assert rows(db, "SELECT id, name = 'Ada' AS yes FROM people") == [(1, True), (2, False), (3, False), (4, False)]


def test_joins(db):
    assert rows(db, "SELECT p.name, t.kind FROM people p JOIN pets t ON p.id = t.owner") == [("Ada", "cat"), ("Ada", "dog"), ("Bob", "cat")]
    assert len(rows(db, "SELECT p.id, t.kind FROM people p LEFT JOIN pets t ON t.owner = p.id")) == 5
    assert rows(db, "SELECT s.id, b.id AS boss FROM staff s JOIN staff b ON s.boss = b.id") == [("b", "a"), ("c", "a")]


def test_subqueries(db):
    assert rows(db, "SELECT id FROM people WHERE id NOT IN (SELECT owner FROM pets)") == [(3,), (4,)]
    assert rows(db, "SELECT id FROM people WHERE id IN (SELECT owner FROM pets WHERE kind = 'dog') OR score = (SELECT MAX(score) FROM people)") == [(1,), (3,)]
    assert rows(db, "SELECT id, (SELECT COUNT(*) FROM empty) AS n, (SELECT name FROM empty) AS x FROM money WHERE id = (SELECT MIN(id) FROM money)") == [(1, 0, None)]
    assert rows(db, "SELECT kind, COUNT(*) AS n FROM pets GROUP BY kind HAVING kind IN (SELECT kind FROM pets WHERE id < 11)") == [("cat", 2)]


def test_groups(db):
    assert rows(db, "SELECT kind AS k, COUNT(*) AS n FROM pets GROUP BY k HAVING n > 1") == [("cat", 2)]
    assert rows(db, "SELECT UPPER(kind) AS id, COUNT(*) AS n FROM pets GROUP BY UPPER(kind)")[0] == ("CAT", 2)
    assert rows(db, "SELECT COUNT(*) AS n, COUNT(name) AS m, SUM(id) AS s FROM empty") == [(0, 0, None)]
    assert rows(db, "SELECT CASE WHEN SUM(score) > 30 THEN 'much' ELSE 'little' END AS v, COUNT(DISTINCT ok) AS d FROM people") == [("much", 2)]
    assert rows(db, "SELECT GROUP_CONCAT(score, '|') AS g FROM people WHERE id = 1") == [("10",)]
    assert rows(db, "SELECT COUNT(*) AS n FROM people HAVING n > 100") == []


def test_a_real_column_wins_over_an_alias_in_group_by(db):
    assert len(rows(db, "SELECT kind AS owner, COUNT(*) AS n FROM pets GROUP BY kind, owner")) == 4


def test_functions(db):
    got = rows(db, "SELECT SUBSTR('hello', 2, 3) AS a, CAST(130.0 AS text) AS b, ROUND(2.5) AS c, MOD(-7, 3) AS d, MOD(1, 0) AS e, 7 / 2 AS f, 1 / 0 AS g, TRIM('\t x ') AS h, LENGTH('äb') AS i, CEIL(1.2) AS j, CAST('x' AS integer) AS k FROM people WHERE id = 1")
    assert got == [("ell", "130", 3.0, -1, None, 3.5, None, "x", 2, 2, None)]


def test_time_as_text(db):
    assert rows(db, "SELECT COUNT(*) AS n FROM times WHERE at BETWEEN '2026-06-01' AND '2026-06-30'") == [(1,)]
    assert rows(db, "SELECT STRFTIME('%Y-%m', at) AS m, COUNT(*) AS n FROM times GROUP BY m") == [("2026-06", 2), ("2026-07", 1)]
    assert "T" in rows(db, "SELECT NOW() AS n FROM times LIMIT 1")[0][0]


def test_json(db):
    assert rows(db, "SELECT id, JSON_EXTRACT(body, '$.user.name') AS u, JSON_EXTRACT(body, '$.tags[1]') AS t, body ->> 'n' AS n FROM docs") == [(1, "Ada", "y", "5"), (2, None, None, None)]
    assert rows(db, "SELECT id FROM docs WHERE JSON_EXTRACT(body, '$.n') > 4") == [(1,)]


def test_decimals_are_exact(db):
    assert rows(db, "SELECT price * 1.08 AS m, price + 0.005 AS p, ROUND(price / 3, 3) AS d FROM money WHERE id = 1") == [(Decimal("10.2600"), Decimal("9.505"), Decimal("3.167"))]
    assert rows(db, "SELECT SUM(price) AS s, AVG(price) AS a, MAX(price) AS m FROM money WHERE id IN (2, 3)") == [(Decimal("0.30"), Decimal("0.150000"), Decimal("0.20"))]
    assert rows(db, "SELECT id FROM money WHERE price = 0.2") == [(3,)]


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(-10**9, 10**9), st.integers(1, 10**6)), min_size=1, max_size=20))
def test_decimal_rules_against_python(spark, pairs):
    def dec(x):
        return Decimal(x).scaleb(-2)

    db = Folder(spark, "/nowhere", {"d": spark.createDataFrame([(k, dec(a), dec(b)) for k, (a, b) in enumerate(pairs)], "id int, a decimal(18,2), b decimal(18,2)")})
    for r in db.query("SELECT id, a + b AS s, a * b AS m, a / b AS q, ROUND(a, 1) AS r FROM d").collect():
        a, b = map(dec, pairs[r.id])
        assert (r.s, r.m) == (a + b, a * b)
        assert r.q == (a / b).quantize(Decimal("1e-6"), ROUND_HALF_UP) and r.r == a.quantize(Decimal("0.1"), ROUND_HALF_UP)


@pytest.mark.parametrize(
    "sql,code",
    [
        ("SELECT id FROM nosuch", "UNKNOWN_TABLE"),
        ("SELECT nosuch FROM people", "UNKNOWN_COLUMN"),
        ("SELECT ID FROM people", "UNKNOWN_COLUMN"),
        ("SELECT x.id FROM people", "UNKNOWN_TABLE"),
        ("SELECT id FROM people p JOIN pets t ON p.id = t.owner", "UNKNOWN_COLUMN"),
        ("SELECT p.id FROM people p JOIN pets t ON p.id = p.id", "INVALID_JOIN_CONDITION"),
        ("SELECT name, COUNT(*) AS n FROM people", "NOT_GROUPED"),
        ("SELECT * FROM people p JOIN pets t ON p.id = t.owner", "DUPLICATE_COLUMN"),
        ("SELECT id FROM people WHERE id = (SELECT id FROM pets)", "SUBQUERY_MULTIPLE_ROWS"),
        ("SELECT id FROM people WHERE id = (SELECT id, kind FROM pets)", "SUBQUERY_SHAPE"),
        ("SELECT id FROM people WHERE id IN (SELECT id, kind FROM pets)", "SUBQUERY_SHAPE"),
        ("SELECT p.id FROM people p WHERE p.id IN (SELECT t.owner FROM pets t WHERE t.id = p.id)", "UNKNOWN_TABLE"),
        ("SELECT JSON_EXTRACT(body, 'user') AS x FROM docs", "INVALID_JSON_PATH"),
        ("SELECT price * 1.5e2 AS x FROM money", "TYPE_MISMATCH"),
        ("SELECT m.price * p.score AS x FROM money m JOIN people p ON m.id = p.id", "TYPE_MISMATCH"),
        ("DELETE FROM people WHERE id = 1", "READ_ONLY"),
    ],
)
def test_refused(db, sql, code):
    with pytest.raises(StrataError) as e:
        db.query(sql).collect()
    assert e.value.code == code


def test_order_limit_distinct(db):
    assert [r.id for r in db.query("SELECT id, score FROM people ORDER BY score DESC, id").collect()] == [3, 1, 4, 2]
    assert [r.n for r in db.query("SELECT name AS n FROM people ORDER BY id LIMIT 2 OFFSET 1").collect()] == ["Bob", None]
    assert rows(db, "SELECT DISTINCT kind FROM pets") == [("cat",), ("dog",), ("owl",)]


def test_filters_reach_the_scan(spark, tmp_path):
    spark.range(100).selectExpr("id", "cast(id as string) AS name").write.parquet(f"{tmp_path}/t.parquet")
    plan = Folder(spark, str(tmp_path)).query("SELECT id FROM t WHERE name = '5' AND id < 50")._jdf.queryExecution().toString()
    assert "EqualTo(name,5)" in plan and "LessThan(id,50)" in plan
