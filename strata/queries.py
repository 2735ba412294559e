"""Registered queries, each through the SQL front end, with the DuckDB text that checks it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.sources.folder import Folder, money

FLAG = """SELECT c.c_mktsegment AS segment, STRFTIME('%Y-%m', o.o_orderdate) AS month, COUNT(*) AS n, ROUND(SUM(o.o_totalprice), 2) AS revenue
FROM orders o INNER JOIN customer c ON o.o_custkey = c.c_custkey WHERE o.o_orderstatus = 'F'
GROUP BY segment, month HAVING n > 0 ORDER BY month LIMIT 1000"""

#: name -> dialect text, or (dialect text, DuckDB text) where they differ.
SQL: dict[str, str | tuple[str, str]] = {
    "q_flag": (
        FLAG,
        """SELECT c_mktsegment AS segment, strftime(o_orderdate, '%Y-%m') AS month, count(*) AS n, round(sum(o_totalprice), 2) AS revenue
        FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'F' GROUP BY 1, 2""",
    ),
    "scan_star_nation": "SELECT * FROM nation",
    "project_arith_lineitem": "SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) AS net, l_quantity + 1 AS q1, l_linenumber - 1 AS l0 FROM lineitem",
    "filter_cmp": "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice >= 100000 AND o_orderstatus <> 'F'",
    "filter_and_or_not": "SELECT c_custkey FROM customer WHERE NOT (c_acctbal < 0 OR c_mktsegment = 'BUILDING') AND c_nationkey > 3",
    "filter_in_list": "SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_nationkey IN (1, 2, 3)",
    "filter_not_in_list": "SELECT c_custkey FROM customer WHERE c_mktsegment NOT IN ('BUILDING', 'MACHINERY')",
    "filter_between": "SELECT p_partkey, p_size FROM part WHERE p_size BETWEEN 5 AND 10",
    "filter_not_between": "SELECT p_partkey, p_size FROM part WHERE p_size NOT BETWEEN 5 AND 45",
    "filter_like": "SELECT c_custkey, c_name FROM customer WHERE c_name LIKE '%00_1%'",
    "filter_not_like": "SELECT p_partkey FROM part WHERE p_type NOT LIKE '%A%'",
    "filter_is_null_after_left_join": (
        "SELECT c.c_custkey FROM customer c LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey LEFT JOIN region r ON n.n_nationkey = r.r_regionkey WHERE r.r_name IS NULL",
        "SELECT c_custkey FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_nationkey = r_regionkey WHERE r_name IS NULL",
    ),
    "filter_time_range": (
        "SELECT o_orderkey FROM orders WHERE o_orderdate >= '1996-01-01' AND o_orderdate < '1996-04-01'",
        "SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1996-04-01'",
    ),
    "two_valued_not": (
        "SELECT c.c_custkey, r.r_name FROM customer c LEFT JOIN region r ON c.c_nationkey = r.r_regionkey WHERE NOT (r.r_name = 'ASIA')",
        "SELECT c_custkey, r_name FROM customer LEFT JOIN region ON c_nationkey = r_regionkey WHERE NOT coalesce(r_name = 'ASIA', false)",
    ),
    "distinct_status": "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders",
    "case_searched": "SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'high' WHEN o_totalprice > 100000 THEN 'middle' ELSE 'low' END AS band FROM orders",
    "case_simple": "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'open' END AS state FROM orders",
    "concat_pipe": "SELECT c_custkey, c_name || '/' || c_mktsegment AS both FROM customer",
    "cast_text_int": (
        "SELECT l_orderkey, CAST(l_quantity AS text) AS q, CAST(l_linenumber AS text) AS l, CAST('12' AS integer) AS i, CAST('x' AS integer) AS none, CAST(l_linenumber AS real) AS r FROM lineitem",
        "SELECT l_orderkey, CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) AS q, CAST(l_linenumber AS VARCHAR) AS l, CAST(12 AS BIGINT) AS i, CAST(NULL AS BIGINT) AS none, CAST(l_linenumber AS DOUBLE) AS r FROM lineitem",
    ),
    "fn_upper_lower_length_trim": "SELECT p_partkey, UPPER(p_name) AS u, LOWER(p_type) AS l, LENGTH(p_name) AS n, TRIM('  ' || p_brand || ' ') AS t FROM part",
    "fn_substr_replace": "SELECT p_partkey, SUBSTR(p_name, 2, 4) AS s, SUBSTR(p_name, 3) AS tail, REPLACE(p_brand, 'Brand', 'B') AS b FROM part",
    "fn_round_abs_ceil_floor_mod": (
        "SELECT c_custkey, ROUND(c_acctbal, 1) AS r1, ABS(c_acctbal) AS a, CEIL(c_acctbal) AS up, FLOOR(c_acctbal) AS down, MOD(c_custkey, 7) AS m FROM customer",
        "SELECT c_custkey, round(c_acctbal, 1) AS r1, abs(c_acctbal) AS a, CAST(ceil(c_acctbal) AS BIGINT) AS up, CAST(floor(c_acctbal) AS BIGINT) AS down, mod(c_custkey, 7) AS m FROM customer",
    ),
    "fn_coalesce_nullif_ifnull": "SELECT o_orderkey, COALESCE(NULLIF(o_orderstatus, 'F'), 'was F') AS c, NULLIF(o_orderstatus, 'O') AS n, IFNULL(NULLIF(o_orderpriority, '5-LOW'), '-') AS i FROM orders",
    "fn_date_strftime": (
        "SELECT o_orderkey, DATE(o_orderdate) AS d, STRFTIME('%Y/%m %H:%M:%S', o_orderdate) AS s FROM orders",
        "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS d, strftime(o_orderdate, '%Y/%m %H:%M:%S') AS s FROM orders",
    ),
    "json_extract_events": (
        "SELECT event_id, JSON_EXTRACT(props, '$.k') AS k, JSON_EXTRACT(props, '$.no.such[0]') AS none FROM events WHERE JSON_EXTRACT(props, '$.k') >= 5",
        "SELECT event_id, json_extract_string(props, '$.k') AS k, CAST(NULL AS VARCHAR) AS none FROM events WHERE CAST(json_extract_string(props, '$.k') AS DOUBLE) >= 5",
    ),
    "json_arrow_events": ("SELECT event_id, props ->> 'k' AS k FROM events", "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events"),
    "agg_global": (
        "SELECT COUNT(*) AS n, SUM(l_linenumber) AS s, MIN(l_shipdate) AS first, MAX(l_extendedprice) AS top FROM lineitem",
        "SELECT count(*) AS n, CAST(sum(l_linenumber) AS BIGINT) AS s, min(l_shipdate) AS first, max(l_extendedprice) AS top FROM lineitem",
    ),
    "agg_empty": (
        "SELECT COUNT(*) AS n, SUM(o_orderkey) AS s, AVG(o_totalprice) AS a FROM orders WHERE o_orderkey < 0",
        "SELECT count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS s, avg(o_totalprice) AS a FROM orders WHERE o_orderkey < 0",
    ),
    "agg_group_by_col": "SELECT o_orderpriority, COUNT(*) AS n, ROUND(SUM(o_totalprice), 2) AS revenue FROM orders GROUP BY o_orderpriority",
    "agg_group_by_expr": (
        "SELECT STRFTIME('%Y', o_orderdate) AS y, COUNT(*) AS n FROM orders GROUP BY STRFTIME('%Y', o_orderdate)",
        "SELECT strftime(o_orderdate, '%Y') AS y, count(*) AS n FROM orders GROUP BY 1",
    ),
    "agg_group_by_alias": ("SELECT DATE(ts) AS day, COUNT(*) AS n FROM events GROUP BY day", "SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n FROM events GROUP BY 1"),
    "agg_group_by_case_alias": (
        "SELECT CASE WHEN p_size > 25 THEN 'big' ELSE 'small' END AS size, COUNT(*) AS n, MAX(p_retailprice) AS top FROM part GROUP BY size",
        "SELECT CASE WHEN p_size > 25 THEN 'big' ELSE 'small' END AS size, count(*) AS n, max(p_retailprice) AS top FROM part GROUP BY 1",
    ),
    "agg_count_distinct": "SELECT l_returnflag, COUNT(DISTINCT l_suppkey) AS n FROM lineitem GROUP BY l_returnflag",
    "agg_sum_distinct": (
        "SELECT l_returnflag, SUM(DISTINCT l_linenumber) AS s FROM lineitem GROUP BY l_returnflag",
        "SELECT l_returnflag, CAST(sum(DISTINCT l_linenumber) AS BIGINT) AS s FROM lineitem GROUP BY l_returnflag",
    ),
    "agg_min_max_avg": "SELECT c_mktsegment, MIN(c_acctbal) AS low, MAX(c_name) AS last, ROUND(AVG(c_acctbal), 4) AS mean FROM customer GROUP BY c_mktsegment",
    "agg_group_concat": (
        "SELECT r.r_name, GROUP_CONCAT(n.n_name, '; ') AS names, GROUP_CONCAT(DISTINCT n.n_regionkey) AS keys, GROUP_CONCAT(NULLIF(n.n_nationkey, 7)) AS ids FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey GROUP BY r.r_name",
        """SELECT r_name, string_agg(n_name, '; ' ORDER BY n_name) AS names, string_agg(DISTINCT CAST(n_regionkey AS VARCHAR)) AS keys,
           string_agg(CAST(n_nationkey AS VARCHAR), ',' ORDER BY CAST(n_nationkey AS VARCHAR)) FILTER (n_nationkey <> 7) AS ids FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name""",
    ),
    "having_alias": "SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey HAVING n > 12",
    "having_aggregate": "SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey HAVING MAX(o_totalprice) > 300000 AND COUNT(*) > 5",
    "agg_case_over_sum": "SELECT c_nationkey, CASE WHEN SUM(c_acctbal) > 250000 THEN 'rich' ELSE 'poor' END AS verdict FROM customer GROUP BY c_nationkey",
    "join_inner": (
        "SELECT o.o_orderkey, c.c_name FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey WHERE c.c_mktsegment = 'BUILDING'",
        "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING'",
    ),
    "join_left": (
        "SELECT n.n_name, r.r_name FROM nation n LEFT JOIN region r ON n.n_nationkey = r.r_regionkey",
        "SELECT n_name, r_name FROM nation LEFT JOIN region ON n_nationkey = r_regionkey",
    ),
    "join_three_way": (
        "SELECT l.l_orderkey, l.l_linenumber, c.c_name FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN customer c ON o.o_custkey = c.c_custkey WHERE l.l_quantity > 45",
        "SELECT l_orderkey, l_linenumber, c_name FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey WHERE l_quantity > 45",
    ),
    "join_five_way_region_revenue": (
        """SELECT r.r_name, ROUND(SUM(l.l_extendedprice * (1 - l.l_discount)), 2) AS revenue FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
        JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey GROUP BY r.r_name""",
        """SELECT r_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey
        JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name""",
    ),
    "join_self_nation": (
        "SELECT a.n_name AS one, b.n_name AS other FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey WHERE a.n_nationkey < b.n_nationkey",
        "SELECT a.n_name AS one, b.n_name AS other FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey WHERE a.n_nationkey < b.n_nationkey",
    ),
    "join_left_chain": (
        "SELECT s.s_suppkey, n.n_name, r.r_name FROM supplier s LEFT JOIN nation n ON s.s_nationkey = n.n_nationkey LEFT JOIN region r ON n.n_regionkey = r.r_regionkey",
        "SELECT s_suppkey, n_name, r_name FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey",
    ),
    "semi_in_subquery": "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 250000)",
    "anti_not_in_subquery": "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 150000)",
    "anti_not_in_with_null": (
        "SELECT n_nationkey FROM nation WHERE n_nationkey NOT IN (SELECT r.r_regionkey FROM nation x LEFT JOIN region r ON x.n_nationkey = r.r_regionkey)",
        "SELECT n_nationkey FROM nation WHERE n_nationkey NOT IN (SELECT r_regionkey FROM region)",
    ),
    "in_subquery_under_or": "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 250000) OR c_acctbal < 0",
    "sub_scalar_avg": "SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT AVG(o_totalprice) FROM orders)",
    "sub_scalar_max": "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice = (SELECT MAX(o_totalprice) FROM orders)",
    "sub_nested": "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > (SELECT AVG(o_totalprice) FROM orders WHERE o_orderstatus = 'F'))",
    "sub_scalar_count": "SELECT r_name, (SELECT COUNT(*) FROM nation) AS nations FROM region",
    "order_by_multi": "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders ORDER BY o_orderstatus DESC, o_totalprice, o_orderkey LIMIT 50",
    "order_by_alias": "SELECT o_orderkey AS k, o_totalprice * 2 AS twice FROM orders ORDER BY twice DESC, k LIMIT 20",
    "limit_offset": "SELECT p_partkey FROM part ORDER BY p_partkey LIMIT 10 OFFSET 25",
    "dec_sum": (
        "SELECT o_orderstatus, SUM(price) AS s, MIN(price) AS low, MAX(price) AS top FROM orders_exact GROUP BY o_orderstatus",
        "SELECT o_orderstatus, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DECIMAL(28,2)) AS s, min(CAST(o_totalprice AS DECIMAL(18,2))) AS low, max(CAST(o_totalprice AS DECIMAL(18,2))) AS top FROM orders GROUP BY 1",
    ),
    "dec_mul": (
        "SELECT o_orderkey, price * 1.08 AS gross, price + 0.005 AS more FROM orders_exact",
        "SELECT o_orderkey, CAST(o_totalprice AS DECIMAL(18,2)) * 1.08 AS gross, CAST(o_totalprice AS DECIMAL(18,2)) + 0.005 AS more FROM orders",
    ),
    "dec_avg": (
        "SELECT o_orderstatus, AVG(price) AS mean FROM orders_exact GROUP BY o_orderstatus",
        """SELECT o_orderstatus, CAST(CAST(((2 * cents * 10000 + n) // (2 * n)) // 1000000 AS VARCHAR) || '.' || lpad(CAST(((2 * cents * 10000 + n) // (2 * n)) % 1000000 AS VARCHAR), 6, '0') AS DECIMAL(38,6)) AS mean
           FROM (SELECT o_orderstatus, CAST(sum(CAST(CAST(o_totalprice AS DECIMAL(18,2)) * 100 AS HUGEINT)) AS HUGEINT) AS cents, CAST(count(*) AS HUGEINT) AS n FROM orders GROUP BY 1)""",
    ),
    "dec_div": (
        "SELECT o_orderkey, price / 7 AS seventh FROM orders_exact",
        """SELECT o_orderkey, CAST(CAST(((2 * cents * 10000 + 7) // 14) // 1000000 AS VARCHAR) || '.' || lpad(CAST(((2 * cents * 10000 + 7) // 14) % 1000000 AS VARCHAR), 6, '0') AS DECIMAL(38,6)) AS seventh
           FROM (SELECT o_orderkey, CAST(CAST(o_totalprice AS DECIMAL(18,2)) * 100 AS HUGEINT) AS cents FROM orders)""",
    ),
    "dec_by_integer": (
        "SELECT o_orderkey, price * 3 AS three, price + o_orderkey AS more, price - 1 AS less FROM orders_exact",
        "SELECT o_orderkey, CAST(o_totalprice AS DECIMAL(18,2)) * 3 AS three, CAST(o_totalprice AS DECIMAL(18,2)) + o_orderkey AS more, CAST(o_totalprice AS DECIMAL(18,2)) - 1 AS less FROM orders",
    ),
    "filter_is_not_null": (
        "SELECT c.c_custkey, o.o_orderkey FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey WHERE o.o_orderkey IS NOT NULL AND NULLIF(c.c_nationkey, 3) IS NOT NULL",
        "SELECT c_custkey, o_orderkey FROM customer JOIN orders ON c_custkey = o_custkey WHERE c_nationkey <> 3",
    ),
    "comment_in_statement": (
        "SELECT n_name -- the name; 'quoted' too\n FROM nation -- and the table\n WHERE n_regionkey = 1",
        "SELECT n_name FROM nation WHERE n_regionkey = 1",
    ),
    "cast_boolean": (
        "SELECT n_nationkey, CAST(n_regionkey AS boolean) AS some, CAST('true' AS boolean) AS yes FROM nation",
        "SELECT n_nationkey, n_regionkey <> 0 AS some, TRUE AS yes FROM nation",
    ),
    "now_is_one_moment": (
        "SELECT n_nationkey, NOW() = CURRENT_TIMESTAMP AS same, NOW() > '2020-01-01' AS later FROM nation",
        "SELECT n_nationkey, TRUE AS same, TRUE AS later FROM nation",
    ),
    "dec_compare": (
        "SELECT o_orderkey FROM orders_exact WHERE price > 150000.005 AND price <> 200000",
        "SELECT o_orderkey FROM orders WHERE CAST(o_totalprice AS DECIMAL(18,2)) > 150000.005 AND CAST(o_totalprice AS DECIMAL(18,2)) <> 200000",
    ),
    "dec_round": (
        "SELECT o_orderkey, ROUND(price, 1) AS r FROM orders_exact",
        "SELECT o_orderkey, round(CAST(o_totalprice AS DECIMAL(18,2)), 1) AS r FROM orders",
    ),
}


def exact_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders with the total as an exact decimal named price."""
    return money(spark.read.parquet(f"{sf_dir}/orders.parquet").withColumn("price", F.col("o_totalprice")), "price")


def _run(sql: str) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        views = {"orders_exact": exact_orders(spark, sf_dir)} if "orders_exact" in sql else {}
        return Folder(spark, sf_dir, views).query(sql)

    return query


QUERIES = {name: _run(text if isinstance(text, str) else text[0]) for name, text in SQL.items()}
ORACLE_SQL = {name: text if isinstance(text, str) else text[1] for name, text in SQL.items()}
