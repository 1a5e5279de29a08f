"""Registered queries of the facade, each with the DuckDB statement that gives the same rows.

Most run as SQL text through the engine, over a schema that declares the driver's tables; where both
dialects agree the text itself is the twin.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import operators as op
from ..engine import Engine
from ..functions import col, expr, iso_timestamp
from ..schema import Constraints, Schema, SchemaBuilder
from ..sources import FileProvider, FunctionProvider, KeyValueProvider, MemoryProvider, ScanPlan, ScanRequest
from ..streaming import windowed_counts
from ..validation import violations

Query = Callable[[SparkSession, str], DataFrame]

COLUMNS = {
    "region": {"r_regionkey": "integer", "r_name": "string"},
    "nation": {"n_nationkey": "integer", "n_name": "string", "n_regionkey": "integer"},
    "customer": {"c_custkey": "integer", "c_name": "string", "c_nationkey": "integer", "c_acctbal": "real", "c_mktsegment": "string"},
    "supplier": {"s_suppkey": "integer", "s_name": "string", "s_nationkey": "integer", "s_acctbal": "real"},
    "part": {"p_partkey": "integer", "p_name": "string", "p_brand": "string", "p_type": "string", "p_size": "integer", "p_retailprice": "real"},
    "orders": {"o_orderkey": "integer", "o_custkey": "integer", "o_orderstatus": "string", "o_totalprice": "real", "o_orderdate": "timestamp", "o_orderpriority": "string"},
    "lineitem": {"l_orderkey": "integer", "l_partkey": "integer", "l_suppkey": "integer", "l_linenumber": "integer", "l_quantity": "real", "l_extendedprice": "real", "l_discount": "real", "l_tax": "real", "l_returnflag": "string", "l_linestatus": "string", "l_shipdate": "timestamp"},
    "events": {"event_id": "integer", "ts": "timestamp", "user_id": "integer", "event_type": "string", "value": "real", "props": "json"},
}


@lru_cache(maxsize=16)
def schema(root: str) -> Schema:
    files = FileProvider(root)
    b = SchemaBuilder()
    for name, columns in COLUMNS.items():
        b.table(name, files.entity(name), {c: getattr(col, kind)() for c, kind in columns.items()})
    b.table(
        "my_orders",
        files.entity("orders", scope=lambda ctx: (lambda rows: rows["o_custkey"] == ctx["customer"]) if ctx else None),
        {
            "id": col.id("o_orderkey", type="integer"),
            "customer_id": col.integer("o_custkey", nullable=False, references=("my_customers", "id")),
            "status": col.string("o_orderstatus", enum=("open", "filled", "partial"), enum_map={"O": "open", "F": "filled", "P": "partial"}),
            "priority": col.string("o_orderpriority"),
            "total": col.real("o_totalprice"),
            "total_cents": col.calc("real", lambda c: expr.multiply(c("total"), expr.literal(100.0))),
            "is_large": col.calc("boolean", lambda c: expr.gte(c("total"), expr.literal(200000.0))),
        },
        Constraints(checks_in=(("priority", ("1-URGENT", "2-HIGH", "3-MEDIUM")),), unique=(("customer_id",),)),
    )
    b.table("my_customers", files.entity("customer"), {"id": col.id("c_custkey", type="integer"), "name": col.string("c_name", unique=True), "segment": col.string("c_mktsegment"), "nation_id": col.integer("c_nationkey")})
    b.view("order_lines", lambda v: v.join(v.scan("my_orders"), v.scan("my_customers").withColumnRenamed("id", "cid"), "customer_id", "cid"), ["id", "customer_id", "name", "segment", "total", "is_large"])
    b.view("segment_spend", lambda v: v.aggregate(v.scan("order_lines"), ["segment"], orders=v.count(), customers=v.count_distinct("customer_id"), spend=v.sum("total")))
    b.view("raw_regions", lambda v: v.scan(files.entity("region"), ["r_regionkey", "r_name"]))
    return b.build()


def engine(spark: SparkSession, root: str, **options) -> Engine:
    return Engine(spark, schema(root), **options)


def _sql(text: str, context=None) -> Query:
    return lambda spark, root: engine(spark, root).query(text, context)


#: Name: SQL that both engines read alike.
SAME = {
    "flagship_segment_spend": "SELECT c.c_mktsegment, COUNT(*) AS order_count, ROUND(SUM(o.o_totalprice), 2) AS spend FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey GROUP BY c.c_mktsegment",
    "scan_project": "SELECT o_orderkey, o_totalprice FROM orders",
    "scan_star": "SELECT * FROM nation",
    "scan_rename_calc": "SELECT o_orderkey AS id, o_totalprice / 100 AS dollars, o_totalprice >= 200000 AS is_large FROM orders",
    "filter_eq": "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F'",
    "filter_neq": "SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F'",
    "filter_range": "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 100000 AND o_totalprice <= 150000 AND o_orderkey >= 10 AND o_orderkey < 50000",
    "filter_literal_left": "SELECT o_orderkey FROM orders WHERE 300000 < o_totalprice",
    "filter_in": "SELECT o_orderkey FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')",
    "filter_not_in": "SELECT o_orderkey FROM orders WHERE o_orderpriority NOT IN ('1-URGENT', '2-HIGH')",
    "filter_in_null": "SELECT o_orderkey, o_orderpriority IN ('1-URGENT', NULL) AS a, o_orderpriority NOT IN ('1-URGENT', NULL) AS b FROM orders",
    "filter_between": "SELECT p_partkey FROM part WHERE p_retailprice BETWEEN 920 AND 940",
    "filter_like": "SELECT p_partkey FROM part WHERE p_name LIKE '%l_e b%'",
    "filter_not_like": "SELECT p_partkey FROM part WHERE p_type NOT LIKE '%STEEL%'",
    "filter_null": "SELECT c.c_custkey FROM customer c LEFT JOIN (SELECT * FROM orders WHERE o_totalprice > 480000) o ON c.c_custkey = o.o_custkey WHERE o.o_orderkey IS NULL",
    "filter_not_null": "SELECT c.c_custkey, o.o_orderkey FROM customer c LEFT JOIN (SELECT * FROM orders WHERE o_totalprice > 480000) o ON c.c_custkey = o.o_custkey WHERE o.o_orderkey IS NOT NULL",
    "filter_distinct_from": "SELECT c.c_custkey, o.o_orderkey FROM customer c LEFT JOIN (SELECT * FROM orders WHERE o_totalprice > 480000) o ON c.c_custkey = o.o_custkey WHERE o.o_orderstatus IS DISTINCT FROM 'F'",
    "filter_not_distinct_from": "SELECT c.c_custkey, o.o_orderkey FROM customer c LEFT JOIN (SELECT * FROM orders WHERE o_totalprice > 480000) o ON c.c_custkey = o.o_custkey WHERE o.o_orderstatus IS NOT DISTINCT FROM NULL OR o.o_orderstatus IS NOT DISTINCT FROM 'F'",
    "filter_bool_tree": "SELECT o_orderkey FROM orders WHERE (o_orderstatus = 'F' OR (o_totalprice > 200000 AND NOT o_orderpriority = '5-LOW')) AND o_orderkey > 5",
    "select_no_from": "SELECT 1 AS x, 'a' AS y",
    "join_inner": "SELECT o.o_orderkey, c.c_name FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey",
    "join_left": "SELECT c.c_custkey, o.o_orderkey FROM customer c LEFT JOIN (SELECT * FROM orders WHERE o_totalprice > 480000) o ON c.c_custkey = o.o_custkey",
    "join_right": "SELECT c.c_custkey, o.o_orderkey FROM (SELECT * FROM orders WHERE o_totalprice > 480000) o RIGHT JOIN customer c ON c.c_custkey = o.o_custkey",
    "join_full": "SELECT c.c_custkey, s.s_suppkey FROM customer c FULL JOIN supplier s ON c.c_custkey = s.s_suppkey",
    "join_multi": "SELECT r.r_name, n.n_name, COUNT(*) AS n_orders FROM region r JOIN nation n ON r.r_regionkey = n.n_regionkey JOIN customer c ON n.n_nationkey = c.c_nationkey JOIN orders o ON c.c_custkey = o.o_custkey GROUP BY r.r_name, n.n_name",
    "join_self": "SELECT a.n_name AS left_name, b.n_name AS right_name FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey WHERE a.n_nationkey < b.n_nationkey",
    "join_range": "SELECT p.p_partkey, q.p_partkey AS other FROM part p JOIN part q ON p.p_brand = q.p_brand AND p.p_size < q.p_size WHERE p.p_partkey < 200 AND q.p_partkey < 200",
    "agg_global": "SELECT COUNT(*) AS n, ROUND(SUM(l_extendedprice), 2) AS total, ROUND(AVG(l_quantity), 6) AS mean, MIN(l_discount) AS low, MAX(l_discount) AS high FROM lineitem",
    "agg_empty": "SELECT COUNT(*) AS n, SUM(l_quantity) AS total, MIN(l_quantity) AS low FROM lineitem WHERE l_quantity < 0",
    "agg_group_all_fns": "SELECT l_returnflag, l_linestatus, COUNT(*) AS n, COUNT(l_tax) AS n_tax, ROUND(SUM(l_extendedprice), 2) AS total, ROUND(AVG(l_discount), 8) AS mean, MIN(l_shipdate) AS first_ship, MAX(l_quantity) AS most FROM lineitem GROUP BY l_returnflag, l_linestatus",
    "agg_pricing_summary": "SELECT l_returnflag, l_linestatus, ROUND(SUM(l_quantity), 2) AS sum_qty, ROUND(SUM(l_extendedprice * (1 - l_discount)), 2) AS revenue, COUNT(*) AS n FROM lineitem WHERE l_shipdate <= CAST('1998-09-02' AS TIMESTAMP) GROUP BY l_returnflag, l_linestatus",
    "agg_distinct": "SELECT l_returnflag, COUNT(DISTINCT l_suppkey) AS suppliers, ROUND(SUM(DISTINCT l_quantity), 2) AS sum_q, ROUND(AVG(DISTINCT l_quantity), 6) AS avg_q FROM lineitem GROUP BY l_returnflag",
    "agg_ordinal_expr": "SELECT CASE WHEN o_totalprice > 150000 THEN 'big' ELSE 'small' END AS size_class, COUNT(*) AS n FROM orders GROUP BY 1",
    "agg_having": "SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey HAVING COUNT(*) > 12",
    "agg_having_hidden": "SELECT o_custkey FROM orders GROUP BY o_custkey HAVING SUM(o_totalprice) > 1500000",
    "agg_null_key": "SELECT o.o_orderstatus, COUNT(*) AS n, COUNT(o.o_orderkey) AS orders, MIN(o.o_totalprice) AS low FROM customer c LEFT JOIN (SELECT * FROM orders WHERE o_totalprice > 480000) o ON c.c_custkey = o.o_custkey GROUP BY o.o_orderstatus",
    "select_distinct": "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders",
    "win_row_number": "SELECT o_orderkey, ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders",
    "win_rank": "SELECT p_partkey, RANK() OVER (PARTITION BY p_brand ORDER BY p_size) AS r, DENSE_RANK() OVER (PARTITION BY p_brand ORDER BY p_size) AS d FROM part",
    "win_lead_lag": "SELECT o_orderkey, LEAD(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS nxt, LAG(o_orderkey, 2, 0) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS prev2 FROM orders",
    "win_first_value": "SELECT o_orderkey, FIRST_VALUE(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS f FROM orders",
    "win_running_sum": "SELECT o_orderkey, ROUND(SUM(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 2) AS running FROM orders",
    "win_bounded_avg": "SELECT o_orderkey, ROUND(AVG(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING), 4) AS mean FROM orders",
    "win_partition_count": "SELECT o_orderkey, COUNT(*) OVER (PARTITION BY o_custkey) AS n, MIN(o_totalprice) OVER (PARTITION BY o_custkey) AS low, MAX(o_totalprice) OVER (PARTITION BY o_custkey) AS high FROM orders",
    "win_named": "SELECT o_orderkey, ROW_NUMBER() OVER w AS rn, ROUND(SUM(o_totalprice) OVER w, 2) AS s FROM orders WINDOW w AS (PARTITION BY o_orderpriority ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)",
    "win_over_group": "SELECT o_custkey, COUNT(*) AS n, RANK() OVER (ORDER BY COUNT(*) DESC) AS r FROM orders GROUP BY o_custkey",
    "win_count_distinct": "SELECT o_orderkey, COUNT(DISTINCT o_orderpriority) OVER (PARTITION BY o_custkey) AS kinds FROM orders",
    "sort_multi": "SELECT o_orderkey FROM orders ORDER BY o_orderstatus DESC, o_totalprice ASC, o_orderkey LIMIT 25",
    "sort_alias": "SELECT o_orderkey, o_totalprice AS t FROM orders ORDER BY t DESC, o_orderkey LIMIT 10",
    "sort_ordinal": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY 2 DESC, 1 LIMIT 10",
    "sort_aggregate": "SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey ORDER BY n DESC, o_custkey LIMIT 7",
    "sort_nulls": "SELECT c.c_custkey, o.o_orderkey FROM customer c LEFT JOIN (SELECT * FROM orders WHERE o_totalprice > 480000) o ON c.c_custkey = o.o_custkey ORDER BY o.o_orderkey DESC NULLS LAST, c.c_custkey LIMIT 1200",
    "limit_offset": "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 10 OFFSET 20",
    "union_all": "SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier",
    "union_distinct": "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier",
    "intersect_distinct": "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier",
    "except_distinct": "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM (SELECT * FROM orders WHERE o_totalprice > 480000) o",
    "setop_chain": "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier EXCEPT SELECT n_nationkey FROM nation WHERE n_regionkey = 1",
    "cte_single": "WITH big AS (SELECT o_custkey, o_totalprice FROM orders WHERE o_totalprice > 200000) SELECT o_custkey, COUNT(*) AS n FROM big GROUP BY o_custkey",
    "cte_chained": "WITH a(k, t) AS (SELECT o_custkey, o_totalprice FROM orders), b AS (SELECT k, MAX(t) AS top FROM a GROUP BY k) SELECT k, top FROM b WHERE top > 300000",
    "cte_recursive_all": "WITH RECURSIVE fib(n, a, b) AS (SELECT 1, 0, 1 UNION ALL SELECT n + 1, b, a + b FROM fib WHERE n < 30) SELECT n, a FROM fib",
    "cte_recursive_deep": "WITH RECURSIVE t(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM t WHERE n < 200) SELECT COUNT(*) AS n, MAX(n) AS top FROM t",
    "cte_recursive_union": "WITH RECURSIVE reach(k) AS (SELECT 1 UNION SELECT (k * 7) % 25 FROM reach) SELECT n.n_name FROM reach r JOIN nation n ON r.k = n.n_nationkey",
    "derived_table": "SELECT d.o_custkey, d.n FROM (SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey) d WHERE d.n > 10",
    "subq_scalar_where": "SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT AVG(o_totalprice) FROM orders)",
    "subq_scalar_select": "SELECT n_name, (SELECT COUNT(*) FROM region) AS regions FROM nation",
    "subq_exists": "SELECT r_name FROM region WHERE EXISTS (SELECT 1 FROM nation WHERE n_nationkey > 20)",
    "subq_not_exists": "SELECT r_name FROM region WHERE NOT EXISTS (SELECT 1 FROM nation WHERE n_nationkey > 99)",
    "corr_exists": "SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 250000)",
    "corr_not_exists": "SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 480000)",
    "subq_in": "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')",
    "subq_not_in": "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 480000)",
    "corr_in": "SELECT c_custkey FROM customer c WHERE c.c_custkey IN (SELECT o.o_custkey FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderstatus = 'F')",
    "corr_not_in": "SELECT c_custkey FROM customer c WHERE c.c_custkey NOT IN (SELECT o.o_custkey FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderstatus = 'F')",
    "corr_scalar_where": "SELECT o_orderkey FROM orders o WHERE o.o_totalprice = (SELECT MAX(i.o_totalprice) FROM orders i WHERE i.o_custkey = o.o_custkey)",
    "corr_scalar_select": "SELECT c_custkey, (SELECT MAX(o.o_totalprice) FROM orders o WHERE o.o_custkey = c.c_custkey) AS top FROM customer c",
    "fn_arith": "SELECT p_partkey, p_size + 1 AS a, p_size - 7 AS b, p_size * 3 AS c, p_size / 4 AS d, p_size % 5 AS e FROM part",
    "fn_concat": "SELECT n_name || '-' || r_name AS full_name FROM nation JOIN region ON n_regionkey = r_regionkey",
    "fn_case_conv": "SELECT p_partkey, LOWER(p_type) AS low, UPPER(p_name) AS up FROM part",
    "fn_text": "SELECT p_partkey, TRIM('  ' || p_name || ' ') AS t, LENGTH(p_name) AS n, SUBSTR(p_name, 2, 3) AS s, SUBSTRING(p_name, 3) AS u FROM part",
    "fn_coalesce_nullif": "SELECT c.c_custkey, COALESCE(o.o_orderkey, -1) AS k, COALESCE(NULL, o.o_orderstatus) AS s, NULLIF(c.c_mktsegment, 'BUILDING') AS seg FROM customer c LEFT JOIN (SELECT * FROM orders WHERE o_totalprice > 480000) o ON c.c_custkey = o.o_custkey",
    "fn_abs_round": "SELECT c_custkey, ABS(c_acctbal) AS a, ROUND(c_acctbal) AS r0, ROUND(c_acctbal, 1) AS r1 FROM customer",
    "fn_case": "SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'large' WHEN o_totalprice > 100000 THEN 'medium' ELSE 'small' END AS c FROM orders",
    "fn_compare": "SELECT p_partkey, p_size = 5 AS a, p_size <> 5 AS b, p_size > 5 AS c, p_size >= 5 AS d, p_size < 5 AS e, p_size <= 5 AS f, NOT p_size = 5 AS g, p_size BETWEEN 3 AND 9 AS h, p_brand IS NULL AS i FROM part",
    "filter_in_null_rows": "SELECT o_orderkey FROM orders WHERE o_orderpriority IN ('1-URGENT', NULL)",
    "fn_null_tests": "SELECT c.c_custkey, o.o_orderstatus IS NULL AS a, o.o_orderstatus IS NOT NULL AS b, o.o_orderstatus IS NOT DISTINCT FROM NULL AS c, o.o_orderstatus IS DISTINCT FROM 'F' AS d, o.o_orderstatus = 'F' AS e, NOT (o.o_orderstatus = 'F') AS f FROM customer c LEFT JOIN (SELECT * FROM orders WHERE o_totalprice > 480000) o ON c.c_custkey = o.o_custkey",
    "fn_exponent": "SELECT p_partkey, p_size * 1e2 AS a, 1.5E-1 * p_size AS b, .5e1 AS c FROM part WHERE p_retailprice < 9.5e2",
    "fn_backslash": "SELECT n_name, n_name || '\\x' AS a, n_name || '\\x' LIKE '%\\x' AS b, n_name LIKE 'A\\_%' AS c FROM nation",
    "fn_boolean": "SELECT p_partkey, CAST(p_size - 1 AS BOOLEAN) AS a, CAST(p_size > 10 AS INTEGER) AS b, (p_size > 10) = TRUE AS c FROM part",
    "fn_substr_negative": "SELECT p_partkey, SUBSTR(p_name, -3) AS a, SUBSTR(p_name, -4, 2) AS b FROM part",
    "win_default_frame": "SELECT o_orderkey, COUNT(*) OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS n, MAX(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS top FROM orders",
    "win_range_frame": "SELECT o_orderkey, COUNT(*) OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey RANGE BETWEEN 100 PRECEDING AND CURRENT ROW) AS n FROM orders",
    "join_null_keys": "SELECT a.k, b.v FROM (SELECT NULLIF(n_regionkey, 1) AS k, n_nationkey FROM nation) a JOIN (SELECT NULLIF(r_regionkey, 1) AS k, r_name AS v FROM region) b ON a.k = b.k",
    "not_in_null_subquery": "SELECT n_nationkey FROM nation WHERE n_regionkey NOT IN (SELECT NULLIF(r_regionkey, 1) FROM region WHERE r_regionkey < 2) OR n_nationkey < 3",
    "market_share": "SELECT n.n_name, ROUND(SUM(l.l_extendedprice * (1 - l.l_discount)), 2) AS revenue FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey WHERE o.o_orderstatus = 'F' GROUP BY n.n_name",
}

#: Name: (facade SQL, DuckDB twin, context).
TWINS = {
    "win_distinct_kinds": (
        "SELECT o_orderkey, COUNT(DISTINCT o_orderpriority, o_orderstatus) OVER (PARTITION BY o_custkey) AS pairs, SUM(DISTINCT o_custkey) OVER (PARTITION BY o_orderstatus) AS total, ROUND(AVG(DISTINCT o_custkey) OVER (PARTITION BY o_orderstatus), 4) AS mean, COUNT(DISTINCT NULLIF(o_orderstatus, 'F')) OVER (PARTITION BY o_custkey) AS kinds FROM orders",
        "SELECT o_orderkey, COUNT(DISTINCT o_orderpriority || o_orderstatus) OVER (PARTITION BY o_custkey) AS pairs, CAST(SUM(DISTINCT o_custkey) OVER (PARTITION BY o_orderstatus) AS BIGINT) AS total, ROUND(AVG(DISTINCT o_custkey) OVER (PARTITION BY o_orderstatus), 4) AS mean, COUNT(DISTINCT NULLIF(o_orderstatus, 'F')) OVER (PARTITION BY o_custkey) AS kinds FROM orders",
        None,
    ),
    "limit_mysql": ("SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 20, 10", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 10 OFFSET 20", None),
    "fn_cast": ("SELECT o_orderkey, CAST(o_orderkey AS TEXT) AS t, CAST(o_totalprice AS INTEGER) AS i, CAST(o_orderkey AS REAL) AS r FROM orders", "SELECT o_orderkey, CAST(o_orderkey AS VARCHAR) AS t, CAST(trunc(o_totalprice) AS BIGINT) AS i, CAST(o_orderkey AS DOUBLE) AS r FROM orders", None),
    "fn_divide_zero": ("SELECT p_partkey, 10 / (p_size - p_size) AS z FROM part", "SELECT p_partkey, CAST(NULL AS DOUBLE) AS z FROM part", None),
    "quoted_names": ('SELECT "n_name" AS "Nation" FROM "nation";', 'SELECT n_name AS "Nation" FROM nation', None),
    "view_calculated": ("SELECT id, status, total_cents, is_large FROM my_orders", "SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'O' THEN 'open' WHEN 'F' THEN 'filled' WHEN 'P' THEN 'partial' END AS status, o_totalprice * 100 AS total_cents, o_totalprice >= 200000 AS is_large FROM orders", None),
    "view_enum_filter": ("SELECT id FROM my_orders WHERE status = 'filled'", "SELECT o_orderkey AS id FROM orders WHERE o_orderstatus = 'F'", None),
    "view_join": ("SELECT id, name FROM order_lines WHERE is_large", "SELECT o_orderkey AS id, c_name AS name FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice >= 200000", None),
    "view_aggregate": ("SELECT segment, orders, customers, ROUND(spend, 2) AS spend FROM segment_spend", "SELECT c_mktsegment AS segment, COUNT(*) AS orders, COUNT(DISTINCT o_custkey) AS customers, ROUND(SUM(o_totalprice), 2) AS spend FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1", None),
    "view_raw_entity": ("SELECT r_name FROM raw_regions WHERE r_regionkey > 1", "SELECT r_name FROM region WHERE r_regionkey > 1", None),
    "view_scoped": ("SELECT id, total FROM my_orders", "SELECT o_orderkey AS id, o_totalprice AS total FROM orders WHERE o_custkey = 7", {"customer": 7}),
}


def _api(build: Callable[[Callable[[str], DataFrame]], DataFrame]) -> Query:
    return lambda spark, root: build(lambda name: spark.read.parquet(f"{root}/{name}.parquet"))


#: Name: (DataFrame form, DuckDB twin).
APIS: dict[str, tuple[Query, str]] = {
    "op_scan": (_api(lambda t: op.scan(t("orders"), ["o_orderkey"], [("o_orderstatus", "eq", "F"), ("o_totalprice", "gt", 1000.0)], [("o_orderkey", "desc")], 20, 5)), "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 1000 ORDER BY o_orderkey DESC LIMIT 20 OFFSET 5"),
    "op_clauses": (
        _api(lambda t: op.filtered(t("part"), [("p_size", "gte", 3), ("p_size", "lte", 40), ("p_size", "neq", 9), ("p_size", "not_in", [5, 7]), ("p_name", "like", "%e%"), ("p_brand", "is_not_null"), ("p_brand", "is_distinct_from", "x")]).select("p_partkey")),
        "SELECT p_partkey FROM part WHERE p_size >= 3 AND p_size <= 40 AND p_size <> 9 AND p_size NOT IN (5, 7) AND p_name LIKE '%e%' AND p_brand IS NOT NULL",
    ),
    "join_semi": (_api(lambda t: op.join(t("customer"), t("orders"), "c_custkey", "o_custkey", "semi").select("c_custkey")), "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)"),
    "join_anti": (_api(lambda t: op.join(t("customer"), op.filtered(t("orders"), [("o_totalprice", "gt", 480000.0)]), "c_custkey", "o_custkey", "anti").select("c_custkey")), "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 480000)"),
    "op_not_in_null": (_api(lambda t: op.project(t("part"), p_partkey="p_partkey", a=op.clause("p_size", "not_in", [5, None]), b=op.clause("p_size", "in", [5, None]))), "SELECT p_partkey, p_size NOT IN (5, NULL) AS a, p_size IN (5, NULL) AS b FROM part"),
    "join_lookup": (_api(lambda t: op.lookup_join(op.filtered(t("orders"), [("o_totalprice", "gt", 300000.0)]), t("customer"), "o_custkey", "c_custkey").select("o_orderkey", "c_name")), "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 300000"),
    "op_lookup_many": (_api(lambda t: op.lookup_many(t("customer"), "c_custkey", [3, 5, None, 5, 8], ["c_custkey", "c_name"])), "SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (3, 5, 8)"),
    "op_aggregate": (_api(lambda t: op.aggregate(t("orders"), ["o_orderstatus"], {"n": ("count",), "kinds": ("count", "o_orderpriority", True), "top": ("max", "o_totalprice")}, F.col("n") > 1)), "SELECT o_orderstatus, COUNT(*) AS n, COUNT(DISTINCT o_orderpriority) AS kinds, MAX(o_totalprice) AS top FROM orders GROUP BY 1 HAVING COUNT(*) > 1"),
    "op_window": (_api(lambda t: op.window(t("orders"), "rn", "row_number", (), ["o_custkey"], [("o_orderkey", "asc")]).select("o_orderkey", "rn")), "SELECT o_orderkey, ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn FROM orders"),
    "op_set_chain": (_api(lambda t: op.set_op("except", t("nation").select("n_nationkey"), t("customer").where("c_nationkey < 8").select("c_nationkey"), t("supplier").where("s_nationkey > 15").select("s_nationkey"))), "SELECT n_nationkey FROM nation EXCEPT SELECT c_nationkey FROM customer WHERE c_nationkey < 8 EXCEPT SELECT s_nationkey FROM supplier WHERE s_nationkey > 15"),
    "topk": (_api(lambda t: op.top_k(t("orders").select("o_orderkey", "o_totalprice"), [("o_totalprice", "desc"), ("o_orderkey", "asc")], 15)), "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 15"),
    "event_windows": (_api(lambda t: windowed_counts(t("events"), "ts", ["event_type"], "1 hour").withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss"))), "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS window_start, event_type, COUNT(*) AS n FROM events GROUP BY 1, 2"),
    "constraint_checks": (
        lambda spark, root: violations((e := engine(spark, root)).schema.tables["my_orders"].load(spark, None), e.schema.tables["my_orders"], e.schema),
        """SELECT 'not_null' AS "constraint", 'id' AS columns, COUNT(*) FILTER (WHERE o_orderkey IS NULL) AS violations FROM orders
        UNION ALL SELECT 'not_null', 'customer_id', COUNT(*) FILTER (WHERE o_custkey IS NULL) FROM orders
        UNION ALL SELECT 'enum', 'status', COUNT(*) FILTER (WHERE o_orderstatus NOT IN ('O', 'F', 'P')) FROM orders
        UNION ALL SELECT 'check_in', 'priority', COUNT(*) FILTER (WHERE o_orderpriority NOT IN ('1-URGENT', '2-HIGH', '3-MEDIUM')) FROM orders
        UNION ALL SELECT 'primary_key', 'id', CAST(coalesce(sum(n), 0) AS BIGINT) FROM (SELECT COUNT(*) AS n FROM orders GROUP BY o_orderkey HAVING COUNT(*) > 1)
        UNION ALL SELECT 'unique', 'customer_id', CAST(coalesce(sum(n), 0) AS BIGINT) FROM (SELECT COUNT(*) AS n FROM orders GROUP BY o_custkey HAVING COUNT(*) > 1)""",
    ),
}



# -- providers that are no files ----------------------------------------------------------------------------

_SQUARES = T.StructType([T.StructField("k", T.LongType()), T.StructField("square", T.LongType())])


def _stored(keys: tuple) -> list[dict]:
    """A store that answers by key, with text for numbers; every seventh is missing."""
    return [{"sq": str(int(k.split(":")[1]) ** 2)} if int(k.split(":")[1]) % 7 else {} for k in keys]


def _other_providers(root: str) -> Schema:
    memory = MemoryProvider({"levels": ([(1, "low"), (2, None), (3, "high"), (None, "none")], "level long, label string")})
    made = FunctionProvider({"sizes": lambda spark, ctx: spark.read.parquet(f"{root}/part.parquet").groupBy("p_size").count()})
    kv = KeyValueProvider({"squares": (_SQUARES, "k", _stored)}, build_key=lambda name, k: f"{name}:{k}", decode=lambda name, k, r: {"k": k, "square": int(r["sq"])})
    files = FileProvider(root)
    b = SchemaBuilder()
    b.table("levels", memory.entity("levels"), {"level": col.integer(), "label": col.string(coerce=F.upper)})
    b.table("sizes", made.entity("sizes"), {"size": col.integer("p_size"), "n": col.integer("count")})
    b.table("squares", kv.entity("squares"), {"k": col.integer(), "square": col.integer()})
    b.table("shipped", files.entity("orders", scope=lambda ctx: lambda rows: rows["o_orderdate"] < F.lit(ctx).cast("timestamp")), {"id": col.integer("o_orderkey"), "day": col.string("o_orderdate", coerce=iso_timestamp)})
    return b.build()


def _other(text: str, context=None) -> Query:
    return lambda spark, root: Engine(spark, _other_providers(root)).query(text, context)


def _residual(spark: SparkSession, root: str) -> DataFrame:
    """A source that takes one filter and the sort itself, by number; the other filter and the limit are left to Spark."""

    def plan(spark, context, request):
        rows = spark.read.parquet(f"{root}/orders.parquet").where(op.clause(*request.filters[0]))
        return ScanPlan(op.ordered(rows, list(request.order_by)), frozenset({0}), sorted=True)

    entity = FileProvider(root).entity("orders", plan_scan=plan)
    return entity.scan(spark, None, ScanRequest(("o_orderkey",), (("o_orderstatus", "eq", "F"), ("o_totalprice", "lt", 200000.0)), (("o_orderkey", "desc"),), 25, 5))


SOURCES: dict[str, tuple[Query, str]] = {
    "src_memory": (_other("SELECT level, label FROM levels"), "SELECT * FROM (VALUES (1, 'LOW'), (2, NULL), (3, 'HIGH'), (NULL, 'NONE')) v(level, label)"),
    "src_function": (_other("SELECT size, n FROM sizes WHERE size > 10"), "SELECT p_size AS size, COUNT(*) AS n FROM part WHERE p_size > 10 GROUP BY 1"),
    "src_key_value": (_other("SELECT k, square FROM squares WHERE k IN (1, 2, 7, 9)"), "SELECT c_custkey AS k, c_custkey * c_custkey AS square FROM customer WHERE c_custkey IN (1, 2, 9)"),
    "src_coerce_scope": (_other("SELECT id, day FROM shipped", "1995-03-01"), "SELECT o_orderkey AS id, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.000Z') AS day FROM orders WHERE o_orderdate < TIMESTAMP '1995-03-01'"),
    "src_residual": (_residual, "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_totalprice < 200000 ORDER BY o_orderkey DESC LIMIT 25 OFFSET 5"),
    "src_join_providers": (_other("SELECT l.label, s.square FROM levels l JOIN squares s ON l.level = s.k WHERE s.k IN (1, 2, 3)"), "SELECT CASE level WHEN 1 THEN 'LOW' WHEN 3 THEN 'HIGH' END AS label, level * level AS square FROM (VALUES (1), (2), (3)) v(level)"),
}

QUERIES: dict[str, Query] = {n: _sql(s) for n, s in SAME.items()} | {n: _sql(s, c) for n, (s, _, c) in TWINS.items()} | {n: q for n, (q, _) in (APIS | SOURCES).items()}
SQL: dict[str, str] = SAME | {n: s for n, (_, s, _) in TWINS.items()} | {n: s for n, (_, s) in (APIS | SOURCES).items()}
