"""Registered queries over the driver's tables: the dialect's text, and the same in DuckDB's."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .engine import Engine

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "conversations")
_KEYS = {"region": "r_regionkey", "nation": "n_nationkey", "customer": "c_custkey", "supplier": "s_suppkey", "part": "p_partkey", "orders": "o_orderkey", "events": "event_id", "documents": "doc_id"}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def engine_for(spark: SparkSession, sf_dir: str, sql: str | None = None, **fulltext) -> Engine:
    """A session with the driver's tables (those that sql names); documents and conversations have full-text indexes."""
    e = Engine(spark)
    for t in TABLES:
        if sql is None or re.search(rf"\b{t}\b", sql):
            e.register(t, f"{sf_dir}/{t}.parquet", [_KEYS[t]] if t in _KEYS else None, ["text"] if t in ("documents", "conversations") else None, **(fulltext if t in ("documents", "conversations") else {}))
    return e


def _add(name: str, sql: str, oracle: str | None, params: list | None = None, **fulltext) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return engine_for(spark, sf_dir, sql, **fulltext).query(sql, params)

    run.__name__, run.__doc__ = name, sql
    QUERIES[name] = run
    if oracle is not None:
        ORACLE_SQL[name] = oracle


def _same(name: str, sql: str, params: list | None = None) -> None:
    """Text that means the same in both dialects."""
    _add(name, sql, sql, params)


def _r2(x: str) -> str:
    return f"(CASE WHEN {x} < 0 THEN ceil({x} * 100.0 - 0.5) ELSE floor({x} * 100.0 + 0.5) END / 100.0)"


_add(
    "flagship",
    "SELECT c_mktsegment, COUNT(*) AS cnt, ROUND(SUM(o_totalprice), 2) AS total FROM customer JOIN orders ON c_custkey = o_custkey WHERE o_totalprice > 1000 GROUP BY c_mktsegment HAVING COUNT(*) > 1 ORDER BY total DESC",
    f"SELECT c_mktsegment, COUNT(*) AS cnt, {_r2('SUM(o_totalprice)')} AS total FROM customer JOIN orders ON c_custkey = o_custkey WHERE o_totalprice > 1000 GROUP BY c_mktsegment HAVING COUNT(*) > 1",
)

# scans, projections, predicates
_same("scan_project", "SELECT o_orderkey AS k, o_orderstatus AS s, o_totalprice AS p FROM orders")
_same("scan_star", "SELECT * FROM nation")
_same("filter_cmp", "SELECT o_orderkey FROM orders WHERE o_totalprice >= 1000.5 AND o_orderkey <> 7 AND o_custkey < 900")
_same("filter_and_or_not", "SELECT p_partkey FROM part WHERE (p_size > 30 OR p_brand = 'Brand#11') AND NOT p_retailprice < 950")
_same("pk_seek", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey = 42")
_same("range_scan_limit_100", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey >= 500 ORDER BY o_orderkey ASC LIMIT 100")
_same("like", "SELECT p_partkey, p_name FROM part WHERE p_name LIKE '%a_e%'")
_same("not_like", "SELECT p_partkey FROM part WHERE p_type NOT LIKE '%S%'")
_same("in_list", "SELECT c_custkey FROM customer WHERE c_nationkey IN (1, 3, 5) AND c_mktsegment IN ('BUILDING', 'MACHINERY')")
_same("not_in_list", "SELECT n_nationkey FROM nation WHERE n_nationkey NOT IN (1, 2, 3)")
_add("in_list_null", "SELECT n_nationkey, n_nationkey IN (1, NULL) AS a, NULLIF(n_nationkey, 2) NOT IN (1, 5) AS b FROM nation", "SELECT n_nationkey, (n_nationkey IN (1, NULL))::INT AS a, (NULLIF(n_nationkey, 2) NOT IN (1, 5))::INT AS b FROM nation")
_same("between", "SELECT o_orderkey FROM orders WHERE o_totalprice BETWEEN 1000 AND 5000 AND o_orderkey NOT BETWEEN 10 AND 2000")
_add("between_null", "SELECT p_partkey, p_size BETWEEN NULLIF(p_size, 10) AND 20 AS b FROM part", "SELECT p_partkey, CASE WHEN NULLIF(p_size, 10) IS NULL THEN NULL ELSE (p_size BETWEEN NULLIF(p_size, 10) AND 20)::INT END AS b FROM part")
_add("is_null", "SELECT p_partkey, NULLIF(p_size, 10) IS NULL AS a, NULLIF(p_size, 10) IS NOT NULL AS b FROM part", "SELECT p_partkey, (NULLIF(p_size, 10) IS NULL)::INT AS a, (NULLIF(p_size, 10) IS NOT NULL)::INT AS b FROM part")
_add("regexp", "SELECT p_partkey FROM part WHERE p_name REGEXP '^[a-m].*e' AND REGEXP_LIKE(p_brand, '[13]$')", "SELECT p_partkey FROM part WHERE regexp_matches(p_name, '^[a-m].*e') AND regexp_matches(p_brand, '[13]$')")
_same("case_searched", "SELECT p_partkey, CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'medium' ELSE 'large' END AS c FROM part")
_same("case_simple", "SELECT n_nationkey, CASE n_regionkey WHEN 0 THEN 'a' WHEN 1 THEN 'b' END AS c FROM nation")
_add("if_fn", "SELECT p_partkey, IF(p_size > 20, p_size, 0 - p_size) AS v, IF(p_name, 'x', 'y') AS w FROM part", "SELECT p_partkey, IF(p_size > 20, p_size, -p_size)::BIGINT AS v, IF(p_name <> '', 'x', 'y') AS w FROM part")
_add("truthiness", "SELECT n_nationkey FROM nation WHERE n_nationkey AND n_name AND NOT NULLIF(n_regionkey, 3) = 2", "SELECT n_nationkey FROM nation WHERE n_nationkey <> 0 AND n_name <> '' AND NOT NULLIF(n_regionkey, 3) = 2")
_add("incomparable", "SELECT n_nationkey, n_name = 5 AS a, n_name <> 5 AS b, NULLIF(n_name, n_name) <> 5 AS c FROM nation", "SELECT n_nationkey, 0 AS a, 1 AS b, NULL::INT AS c FROM nation")
_add("no_from", "SELECT 1 + 1 AS a, 'it''s' AS b, LENGTH(X'48656c6c6f') AS c, NULL AS d, 3 > 2 AS e", "SELECT 2::BIGINT AS a, 'it''s' AS b, 5::BIGINT AS c, NULL::VARCHAR AS d, 1 AS e")
_add("prepared_params", "SELECT o_orderkey FROM orders WHERE o_custkey = ? AND o_totalprice > ?", "SELECT o_orderkey FROM orders WHERE o_custkey = 10 AND o_totalprice > 100.5", [10, 100.5])
_add("date_compare", "SELECT o_orderkey FROM orders WHERE o_orderdate >= '1995-01-01' AND o_orderdate < '1996-01-01 00:00:00'", "SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1995-01-01' AND o_orderdate < TIMESTAMP '1996-01-01'")

# arithmetic and casts
_add("int_div", "SELECT o_orderkey, (o_orderkey - 7000) / 7 AS d, 7 / (o_orderkey + 1) AS e FROM orders", "SELECT o_orderkey, (o_orderkey - 7000) // 7 AS d, 7 // (o_orderkey + 1) AS e FROM orders")
_same("int_mod", "SELECT o_orderkey, (o_orderkey - 7000) % 13 AS m, -(o_orderkey) AS n FROM orders")
_same("float_arith", "SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice * (1 - l_discount) AS net, l_quantity / 3 AS third FROM lineitem")
_add("wide_int", "SELECT p_partkey, p_size * 100000000 AS w FROM part", "SELECT p_partkey, p_size::BIGINT * 100000000 AS w FROM part")
_add("cast_float_int", "SELECT l_orderkey, l_linenumber, l_partkey, CAST(0 - l_extendedprice AS BIGINT) AS i FROM lineitem", "SELECT l_orderkey, l_linenumber, l_partkey, CAST(trunc(0 - l_extendedprice) AS BIGINT) AS i FROM lineitem")
_add("cast_str_int", "SELECT p_partkey, CAST(RIGHT(p_brand, 1) AS INT) + 1 AS b, CAST(' 12 ' AS SMALLINT) AS c FROM part", "SELECT p_partkey, CAST(right(p_brand, 1) AS BIGINT) + 1 AS b, 12::BIGINT AS c FROM part")
_add("cast_decimal_half_even", "SELECT p_partkey, CAST(p_size / 8.0 AS DECIMAL(10,1)) AS d FROM part", "SELECT p_partkey, CAST(round_even(p_size / 8.0, 1) AS DECIMAL(10,1)) AS d FROM part")
_add("decimal_arith", "SELECT p_partkey, CAST(p_size AS DECIMAL(10,2)) * CAST('1.25' AS DECIMAL(10,2)) + 1 AS d FROM part", "SELECT p_partkey, p_size::DECIMAL(10,2) * 1.25::DECIMAL(10,2) + 1 AS d FROM part")
_add("cast_date", "SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS d, CAST('2026-02-22T13:04:05' AS DATETIME) AS t, CAST(o_orderdate AS VARCHAR) AS s FROM orders", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS d, TIMESTAMP '2026-02-22 13:04:05' AS t, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS s FROM orders")
_add("cast_uuid", "SELECT n_nationkey, CAST('550E8400E29B41D4A716446655440000' AS UUID) AS u, LENGTH(CAST(n_name AS VARBINARY)) AS b FROM nation", "SELECT n_nationkey, '550e8400-e29b-41d4-a716-446655440000' AS u, strlen(n_name) AS b FROM nation")

# scalar functions
_add("fn_length", "SELECT doc_id, LENGTH(text) AS b, CHAR_LENGTH(text) AS c FROM documents", "SELECT doc_id, strlen(text) AS b, length(text) AS c FROM documents")
_add("fn_concat", "SELECT p_partkey, CONCAT(p_brand, '-', p_size, NULLIF(p_size, 10)) AS c FROM part", "SELECT p_partkey, p_brand || '-' || p_size || NULLIF(p_size, 10) AS c FROM part")
_add(
    "fn_substring",
    "SELECT p_partkey, SUBSTRING(p_name, 3) AS a, SUBSTR(p_name, -4, 2) AS b, SUBSTRING(p_name, 0, 3) AS c, SUBSTRING(p_name, -500, 3) AS d, SUBSTRING(p_name, 2, -1) AS e FROM part",
    "SELECT p_partkey, substring(p_name, 3) AS a, CASE WHEN length(p_name) < 4 THEN substring(p_name, 1, 2) ELSE substring(p_name, length(p_name) - 3, 2) END AS b, '' AS c, substring(p_name, 1, 3) AS d, '' AS e FROM part",
)
_same("fn_upper_lower", "SELECT doc_id, UPPER(lang) AS u, LOWER(source) AS l FROM documents")
_add("fn_trim", "SELECT p_partkey, TRIM(CONCAT('  ', p_brand, ' ')) AS a, LTRIM(CONCAT('  ', p_brand, ' ')) AS b, RTRIM(CONCAT(' ', p_brand, '  ')) AS c FROM part", "SELECT p_partkey, p_brand AS a, p_brand || ' ' AS b, ' ' || p_brand AS c FROM part")
_same("fn_replace", "SELECT p_partkey, REPLACE(p_name, 'a', '<>') AS r FROM part")
_add("fn_replace_empty", "SELECT n_nationkey, REPLACE(n_name, '', '-') AS r FROM nation", "SELECT n_nationkey, '-' || regexp_replace(n_name, '(.)', '\\1-', 'g') AS r FROM nation")
_same("fn_reverse_repeat", "SELECT n_nationkey, REVERSE(n_name) AS r, REPEAT(n_name, 2) AS p FROM nation")
_add("fn_left_right", "SELECT p_partkey, LEFT(p_name, 4) AS a, RIGHT(p_name, 3) AS b, LEFT(p_name, -1) AS c FROM part", "SELECT p_partkey, left(p_name, 4) AS a, right(p_name, 3) AS b, '' AS c FROM part")
_add("fn_pad", "SELECT p_partkey, LPAD(p_brand, 12, '*+') AS a, RPAD(p_brand, 3, '*') AS b, LPAD(p_brand, 20, '') AS c FROM part", "SELECT p_partkey, lpad(p_brand, 12, '*+') AS a, left(p_brand, 3) AS b, p_brand AS c FROM part")
_add("fn_instr_locate", "SELECT p_partkey, INSTR(p_name, 'e') AS a, LOCATE('e', p_name, 4) AS b, LOCATE('e', p_name, 0) AS c FROM part", "SELECT p_partkey, instr(p_name, 'e') AS a, CASE WHEN length(p_name) + 1 < 4 THEN 0 WHEN instr(substring(p_name, 4), 'e') = 0 THEN 0 ELSE instr(substring(p_name, 4), 'e') + 3 END AS b, 0::BIGINT AS c FROM part")
_same("fn_abs", "SELECT c_custkey, ABS(c_acctbal) AS a FROM customer")
_same("fn_ceil_floor", "SELECT c_custkey, CEIL(c_acctbal) AS a, CEILING(c_acctbal) AS b, FLOOR(c_acctbal) AS c FROM customer")
_add("fn_round", "SELECT c_custkey, ROUND(c_acctbal) AS a, ROUND(c_acctbal, 1) AS b, ROUND(c_custkey, 2) AS c FROM customer", "SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN ceil(c_acctbal - 0.5) ELSE floor(c_acctbal + 0.5) END AS a, CASE WHEN c_acctbal < 0 THEN ceil(c_acctbal * 10 - 0.5) ELSE floor(c_acctbal * 10 + 0.5) END / 10 AS b, c_custkey AS c FROM customer")
_add("fn_round_decimal", "SELECT p_partkey, ROUND(CAST(p_size / 8.0 AS DECIMAL(10,3)), 1) AS d FROM part", "SELECT p_partkey, CAST(round_even(CAST(p_size / 8.0 AS DECIMAL(10,3)), 1) AS DECIMAL(9,1)) AS d FROM part")
_add("fn_mod_power", "SELECT p_partkey, MOD(p_size, 7) AS m, POWER(p_size, 2) AS p, POW(2, 0 - p_size) AS n, POWER(1.5, 2) AS f FROM part", "SELECT p_partkey, (p_size % 7)::BIGINT AS m, (p_size * p_size)::BIGINT AS p, 0::BIGINT AS n, 2.25::DOUBLE AS f FROM part")
_add(
    "date_format_all",
    "SELECT o_orderkey, DATE_FORMAT(o_orderdate, '%Y/%m/%d %H:%i:%s %y %c %e %M %b %W %a %w %j %p %% %f %q') AS f FROM orders",
    "SELECT o_orderkey, strftime(o_orderdate, '%Y/%m/%d %H:%M:%S %y %-m %-d %B %b %A %a %w %j %p %% 000000 q') AS f FROM orders",
)
_add("date_format_text", "SELECT n_nationkey, DATE_FORMAT('2026-02-22', '%W, %M %e') AS a, DATE_FORMAT(n_name, '%Y') AS b FROM nation", "SELECT n_nationkey, 'Sunday, February 22' AS a, NULL::VARCHAR AS b FROM nation")
_add("now_type", "SELECT CHAR_LENGTH(DATE_FORMAT(NOW(), '%Y-%m-%d %T')) AS a, CURRENT_TIMESTAMP <= NOW() AS b", "SELECT 19::BIGINT AS a, 1 AS b")
_add("fn_null_choice", "SELECT p_partkey, COALESCE(NULLIF(p_size, 10), NULLIF(p_size, 11), 0) AS a, IFNULL(NULLIF(p_brand, 'Brand#11'), 'none') AS b FROM part", "SELECT p_partkey, COALESCE(NULLIF(p_size, 10), NULLIF(p_size, 11), 0)::BIGINT AS a, COALESCE(NULLIF(p_brand, 'Brand#11'), 'none') AS b FROM part")
_add("fn_uuid", "SELECT n_nationkey, CHAR_LENGTH(UUID_V4()) AS a, SUBSTRING(UUID_V7(), 15, 1) AS b FROM nation", "SELECT n_nationkey, 36::BIGINT AS a, '7' AS b FROM nation")
_add("json_extract", "SELECT event_id, JSON_EXTRACT(props, '$.k') AS k, JSON_EXTRACT(props, '$.none') AS n FROM events", "SELECT event_id, json_extract(props, '$.k')::VARCHAR AS k, NULL::VARCHAR AS n FROM events")
_add("json_extract_path", "SELECT event_id, JSON_EXTRACT(CONCAT('{\"a\":[', props, ',{\"k\":\"s\"}]}'), '$.a[*].k') AS k FROM events", "SELECT event_id, '[' || json_extract(props, '$.k')::VARCHAR || ',\"s\"]' AS k FROM events")
_add("json_extract_slice", "SELECT event_id, JSON_EXTRACT(CONCAT('[1,', props, ',3]'), '$[-1]') AS a, JSON_EXTRACT(CONCAT('[1,', props, ',3]'), '$[0:3:2]') AS b, JSON_EXTRACT(CONCAT('[1,', props, ',3]'), '$[2,0]') AS c FROM events", "SELECT event_id, '3' AS a, '[1,3]' AS b, '[3,1]' AS c FROM events")
_add("json_extract_filter", "SELECT event_id, JSON_EXTRACT(CONCAT('[', props, ',{\"k\":-1}]'), '$[?(@.k > 50 && @.k < 80 || @.k == -1)].k') AS k FROM events", "SELECT event_id, CASE WHEN json_extract(props, '$.k')::INT BETWEEN 51 AND 79 THEN '[' || json_extract(props, '$.k')::VARCHAR || ',-1]' ELSE '-1' END AS k FROM events")
_add("json_set", "SELECT event_id, JSON_SET(props, '$.z[1]', event_type) AS j FROM events", "SELECT event_id, '{\"k\":' || json_extract(props, '$.k')::VARCHAR || ',\"z\":[null,\"' || event_type || '\"]}' AS j FROM events")
_add("json_remove", "SELECT event_id, JSON_REMOVE(props, '$.k') AS j, JSON_REMOVE(props, '$.q') AS l FROM events", "SELECT event_id, '{}' AS j, '{\"k\":' || json_extract(props, '$.k')::VARCHAR || '}' AS l FROM events")
_add("json_type", "SELECT event_id, JSON_TYPE(props) AS a, JSON_TYPE(JSON_EXTRACT(props, '$.k')) AS b, JSON_TYPE('[1]') AS c, JSON_TYPE('1.5') AS d, JSON_TYPE('null') AS e FROM events", "SELECT event_id, 'OBJECT' AS a, 'INTEGER' AS b, 'ARRAY' AS c, 'DOUBLE' AS d, 'NULL' AS e FROM events")
_add("json_contains", "SELECT event_id, JSON_CONTAINS(props, '$.k') AS a, JSON_CONTAINS(props, '69') AS b FROM events", "SELECT event_id, 1 AS a, (json_extract(props, '$.k')::VARCHAR = '69')::INT AS b FROM events")

# joins
_same("join_inner", "SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
_same("join_left", "SELECT n_name, r_name FROM nation LEFT JOIN region ON n_regionkey = r_regionkey AND r_regionkey > 1")
_same("join_right", "SELECT n_name, r_name FROM nation RIGHT OUTER JOIN region ON n_regionkey = r_regionkey AND n_nationkey > 20")
_same("join_cross", "SELECT n_nationkey, r_regionkey FROM nation CROSS JOIN region")
_same("join_theta", "SELECT a.n_nationkey AS x, b.n_nationkey AS y FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey AND a.n_regionkey = b.n_regionkey OR a.n_nationkey = 24")
_same("join_self", "SELECT a.n_name AS x, b.n_name AS y FROM nation AS a JOIN nation AS b ON a.n_regionkey = b.n_regionkey WHERE a.n_nationkey <> b.n_nationkey")
_add(
    "join_multi",
    "SELECT r_name, COUNT(*) AS n, ROUND(SUM(l_extendedprice), 0) AS s FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name",
    "SELECT r_name, COUNT(*) AS n, floor(SUM(l_extendedprice) + 0.5) AS s FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name",
)
_same("join_null_keys", "SELECT a.n_nationkey AS x, b.n_nationkey AS y FROM nation a JOIN nation b ON NULLIF(a.n_regionkey, 1) = NULLIF(b.n_regionkey, 1) WHERE b.n_nationkey < 5")
_same("join_star", "SELECT r.*, n_name FROM region r JOIN nation ON r_regionkey = n_regionkey")

# aggregation
_same("agg_count", "SELECT COUNT(*) AS a, COUNT(NULLIF(p_size, 10)) AS b, COUNT(DISTINCT p_brand) AS c FROM part")
_add("agg_sum", "SELECT SUM(p_size) AS a, ROUND(SUM(p_retailprice), 0) AS b, SUM(CAST(p_size AS DECIMAL(10,2))) AS c FROM part", "SELECT SUM(p_size)::BIGINT AS a, floor(SUM(p_retailprice) + 0.5) AS b, SUM(p_size::DECIMAL(10,2)) AS c FROM part")
_add("agg_avg_int", "SELECT p_brand, AVG(p_size) AS a FROM part GROUP BY p_brand", "SELECT p_brand, (SUM(p_size) // COUNT(p_size))::BIGINT AS a FROM part GROUP BY p_brand")
_add("agg_avg_float", "SELECT l_returnflag, ROUND(AVG(l_quantity), 2) AS a FROM lineitem GROUP BY l_returnflag", f"SELECT l_returnflag, {_r2('AVG(l_quantity)')} AS a FROM lineitem GROUP BY l_returnflag")
_same("agg_min_max", "SELECT p_type, MIN(p_name) AS a, MAX(p_size) AS b, MIN(p_retailprice) AS c FROM part GROUP BY p_type")
_add("agg_group_multi", "SELECT l_returnflag, l_linestatus, COUNT(*) AS n, ROUND(SUM(l_quantity), 0) AS q FROM lineitem GROUP BY l_returnflag, l_linestatus", "SELECT l_returnflag, l_linestatus, COUNT(*) AS n, floor(SUM(l_quantity) + 0.5) AS q FROM lineitem GROUP BY l_returnflag, l_linestatus")
_add("agg_group_expr", "SELECT p_size / 10 AS d, COUNT(*) AS n FROM part GROUP BY p_size / 10", "SELECT (p_size // 10)::BIGINT AS d, COUNT(*) AS n FROM part GROUP BY p_size // 10")
_same("agg_group_null", "SELECT NULLIF(n_regionkey, 2) AS g, COUNT(*) AS n FROM nation GROUP BY NULLIF(n_regionkey, 2)")
_same("agg_having", "SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey HAVING COUNT(*) > 12 AND MIN(o_totalprice) > 500")
_add("agg_sum_distinct", "SELECT l_returnflag, SUM(DISTINCT l_linenumber) AS s, COUNT(DISTINCT l_suppkey) AS c FROM lineitem GROUP BY l_returnflag", "SELECT l_returnflag, SUM(DISTINCT l_linenumber)::BIGINT AS s, COUNT(DISTINCT l_suppkey) AS c FROM lineitem GROUP BY l_returnflag")
_add("distinct_order_hidden", "SELECT DISTINCT c_mktsegment FROM customer ORDER BY c_acctbal LIMIT 2", "SELECT c_mktsegment FROM customer GROUP BY c_mktsegment ORDER BY MIN(c_acctbal) LIMIT 2")
_add("distinct_order_hidden_desc", "SELECT DISTINCT c_nationkey FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 5 OFFSET 2", "SELECT c_nationkey FROM customer GROUP BY c_nationkey ORDER BY MAX(c_acctbal) DESC LIMIT 5 OFFSET 2")
_same("agg_distinct", "SELECT DISTINCT p_brand, p_size FROM part")
_add("agg_empty", "SELECT COUNT(*) AS a, SUM(p_size) AS b, MAX(p_name) AS c FROM part WHERE p_size < 0", "SELECT 0::BIGINT AS a, NULL::BIGINT AS b, NULL::VARCHAR AS c")
_same("agg_empty_group", "SELECT p_brand, COUNT(*) AS a FROM part WHERE p_size < 0 GROUP BY p_brand")
_add("agg_loose_column", "SELECT n_regionkey, n_name AS first_name, COUNT(*) AS n FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, arg_min(n_name, n_nationkey) AS first_name, COUNT(*) AS n FROM nation GROUP BY n_regionkey")
_add("agg_in_expression", "SELECT c_nationkey, MAX(c_custkey) - MIN(c_custkey) + COUNT(*) * 2 AS v FROM customer GROUP BY c_nationkey", "SELECT c_nationkey, MAX(c_custkey) - MIN(c_custkey) + COUNT(*) * 2 AS v FROM customer GROUP BY c_nationkey")

# order, limit, sets
_same("order_multi", "SELECT p_partkey, p_brand, p_size FROM part ORDER BY p_brand DESC, p_size, p_partkey LIMIT 50")
_add("order_nulls", "SELECT n_nationkey, NULLIF(n_regionkey, 2) AS g FROM nation ORDER BY g, n_nationkey LIMIT 8", "SELECT n_nationkey, NULLIF(n_regionkey, 2) AS g FROM nation ORDER BY g NULLS FIRST, n_nationkey LIMIT 8")
_same("limit_offset", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 20 OFFSET 35")
_same("topk", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
_same("order_hidden", "SELECT p_name FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 5")
_same("union", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
_same("union_all", "SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier")
_same("union_chain_order", "SELECT n_regionkey AS k FROM nation UNION SELECT r_regionkey FROM region UNION ALL SELECT n_nationkey FROM nation ORDER BY k DESC LIMIT 12")

# subqueries
_same("in_sub", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000)")
_same("not_in_sub", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 100000)")
_same("not_in_sub_null", "SELECT n_nationkey FROM nation WHERE n_regionkey NOT IN (SELECT NULLIF(r_regionkey, 1) FROM region WHERE r_regionkey < 2)")
_same("exists", "SELECT n_nationkey FROM nation WHERE EXISTS (SELECT 1 FROM region WHERE r_regionkey = 3)")
_same("not_exists", "SELECT n_nationkey FROM nation WHERE NOT EXISTS (SELECT 1 FROM region WHERE r_regionkey > 100) AND n_regionkey = 1")
_add("scalar_select", "SELECT n_nationkey, (SELECT MAX(r_regionkey) FROM region) AS m FROM nation", "SELECT n_nationkey, (SELECT MAX(r_regionkey) FROM region) AS m FROM nation")
_same("scalar_where", "SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT AVG(o_totalprice) FROM orders)")
_same("nested_sub", "SELECT c_custkey FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey IN (SELECT r_regionkey FROM region WHERE r_name = 'ASIA'))")


# full text; the query's bigrams have two distinct characters each, so replace() counts them
def _bm25(table: str, key: str, query: str, stop: int | None = None) -> str:
    grams = list(dict.fromkeys(query[i : i + 2] for i in range(len(query) - 1)))
    df = ", ".join(f"count(*) FILTER (contains(text, '{g}')) AS d{i}" for i, g in enumerate(grams))
    tf = ", ".join(f"((length(text) - length(replace(text, '{g}', ''))) // 2)::DOUBLE AS f{i}" for i, g in enumerate(grams))
    use = [f"CASE WHEN floor(d{i} * 1000000 / n) < {stop} THEN 1.0 ELSE 0.0 END" if stop else "1.0" for i in range(len(grams))]
    length = "greatest(" + " + ".join(f"f{i} * {u}" for i, u in enumerate(use)) + ", 1.0)"
    score = " + ".join(f"CASE WHEN f{i} * {u} > 0 THEN ln((n - d{i} + 0.5) / (d{i} + 0.5) + 1.0) * (f{i} * 2.2) / (f{i} + 1.2 * (0.25 + 0.75 * len / avgdl)) ELSE 0.0 END" for i, u in enumerate(use))
    return f"""WITH c AS (SELECT count(text)::DOUBLE AS n, greatest(sum(greatest(length(text) - 1, 0)) / count(text), 1.0) AS avgdl, {df} FROM {table}),
t AS (SELECT {key}, text, {tf} FROM {table}),
l AS (SELECT t.*, c.*, {length} AS len FROM t, c),
s AS (SELECT {key}, text, CAST(round(({score}) * 1000000) AS BIGINT) AS score FROM l)"""


_Q = "leaux"
_add("fts_natural", f"SELECT doc_id, MATCH(text) AGAINST('{_Q}') AS score FROM documents WHERE MATCH(text) AGAINST('{_Q}' IN NATURAL LANGUAGE MODE) > 0", _bm25("documents", "doc_id", _Q) + " SELECT doc_id, score FROM s WHERE score > 0")
_add("fts_natural_topk", f"SELECT doc_id, MATCH(text) AGAINST('{_Q}') AS score FROM documents WHERE MATCH(text) AGAINST('{_Q}') > 0 ORDER BY score DESC, doc_id LIMIT 20", _bm25("documents", "doc_id", _Q) + " SELECT doc_id, score FROM s WHERE score > 0 ORDER BY score DESC, doc_id LIMIT 20")
_add("fts_natural_ordered_ids", "SELECT doc_id FROM documents WHERE MATCH(text) AGAINST('thst' IN NATURAL LANGUAGE MODE) > 0 ORDER BY doc_id LIMIT 20", "SELECT doc_id FROM documents WHERE contains(text, 'th') OR contains(text, 'hs') OR contains(text, 'st') ORDER BY doc_id LIMIT 20")
_add("fts_stop_filter", "SELECT doc_id, MATCH(text) AGAINST('leaux') AS score FROM documents WHERE MATCH(text) AGAINST('leaux') > 0", _bm25("documents", "doc_id", _Q, 500_000) + " SELECT doc_id, score FROM s WHERE score > 0", stop_filter=True, stop_df_ratio_ppm=500_000)
_add("fts_boolean_must", "SELECT doc_id FROM documents WHERE MATCH(text) AGAINST('+aux +ch' IN BOOLEAN MODE)", "SELECT doc_id FROM documents WHERE (contains(text, 'au') OR contains(text, 'ux')) AND contains(text, 'ch')")
_add("fts_boolean_not", "SELECT doc_id FROM documents WHERE MATCH(text) AGAINST('+th -qu' IN BOOLEAN MODE) > 0", "SELECT doc_id FROM documents WHERE contains(text, 'th') AND NOT contains(text, 'qu')")
_add("fts_boolean_phrase", "SELECT doc_id, MATCH(text) AGAINST('\"of the\" +an' IN BOOLEAN MODE) AS s FROM documents", "SELECT doc_id, CASE WHEN contains(text, 'of the') AND contains(text, 'an') THEN 1000000 ELSE 0 END::BIGINT AS s FROM documents")
_add("fts_boolean_should", "SELECT doc_id FROM documents WHERE MATCH(text) AGAINST('zx ung' IN BOOLEAN MODE)", "SELECT doc_id FROM documents WHERE contains(text, 'zx') OR contains(text, 'un') OR contains(text, 'ng')")
_add("fts_or_predicate", "SELECT doc_id FROM documents WHERE MATCH(text) AGAINST('+ung' IN BOOLEAN MODE) > 0 OR NOT MATCH(text) AGAINST('+ea' IN BOOLEAN MODE)", "SELECT doc_id FROM documents WHERE contains(text, 'un') OR contains(text, 'ng') OR NOT contains(text, 'ea')")
_add("fts_join", "SELECT d.doc_id, e.event_id FROM documents d JOIN events e ON d.doc_id = e.event_id WHERE MATCH(text) AGAINST('+ung' IN BOOLEAN MODE) > 0", "SELECT d.doc_id, e.event_id FROM documents d JOIN events e ON d.doc_id = e.event_id WHERE contains(text, 'un') OR contains(text, 'ng')")
_add(
    "fts_snippet",
    "SELECT doc_id, fts_snippet(text, 'the', '<mark>', '</mark>', 10) AS s FROM documents WHERE MATCH(text) AGAINST('\"the\"' IN BOOLEAN MODE) > 0",
    """WITH p AS (SELECT doc_id, text, instr(text, 'the') AS i, length(text) AS n FROM documents WHERE contains(text, 'the')), w AS (SELECT *, greatest(i - 10, 1) AS lo, least(i + 12, n) AS hi FROM p)
SELECT doc_id, (CASE WHEN lo > 1 THEN '...' ELSE '' END) || substring(text, lo, i - lo) || '<mark>the</mark>' || substring(text, i + 3, hi - i - 2) || (CASE WHEN hi < n THEN '...' ELSE '' END) AS s FROM w""",
)
_add("fts_conversations", "SELECT conv_id, turn, MATCH(text) AGAINST('+wh +th' IN BOOLEAN MODE) AS s FROM conversations", "SELECT conv_id, turn, CASE WHEN contains(text, 'wh') AND contains(text, 'th') THEN 1000000 ELSE 0 END::BIGINT AS s FROM conversations")


# changes: the state of a table after some statements
def _after(name: str, statements: list[str], final: str, oracle: str | None, tables: dict[str, list[str]]) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        e = Engine(spark)
        for t, key in tables.items():
            e.load(t, spark.read.parquet(f"{sf_dir}/{t}.parquet"), key)
        for s in statements:
            e.execute(s)
        return e.query(final)

    run.__name__, run.__doc__ = name, "; ".join([*statements, final])
    QUERIES[name] = run
    if oracle is not None:
        ORACLE_SQL[name] = oracle


_N, _C = {"nation": ["n_nationkey"]}, {"customer": ["c_custkey"]}
_after(
    "dml_insert_default_autoinc",
    ["CREATE TABLE t (id BIGINT PRIMARY KEY AUTO_INCREMENT, name VARCHAR(10) DEFAULT 'none', v INT CHECK (v > 0))", "INSERT INTO t (v) VALUES (1), (2)", "INSERT INTO t (id, name, v) VALUES (10, NULL, NULL), (11, 'x', 5)", "INSERT INTO t (name) VALUES ('last')"],
    "SELECT id, name, v FROM t",
    "SELECT * FROM (VALUES (1::BIGINT, 'none', 1), (2, 'none', 2), (10, 'none', NULL), (11, 'x', 5), (3, 'last', NULL)) AS t(id, name, v)",
    {},
)
_after("dml_update_expr", ["UPDATE customer SET c_acctbal = c_acctbal * 2, c_name = CONCAT(c_name, '-', c_nationkey) WHERE c_mktsegment = 'BUILDING'"], "SELECT c_custkey, c_name, c_acctbal FROM customer", "SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN c_name || '-' || c_nationkey ELSE c_name END AS c_name, CASE WHEN c_mktsegment = 'BUILDING' THEN c_acctbal * 2 ELSE c_acctbal END AS c_acctbal FROM customer", _C)
_after("dml_delete_where", ["DELETE FROM customer WHERE c_acctbal < 0 OR c_nationkey IN (1, 2)"], "SELECT c_custkey FROM customer", "SELECT c_custkey FROM customer WHERE NOT (c_acctbal < 0 OR c_nationkey IN (1, 2))", _C)
_after("dml_upsert", ["INSERT INTO nation VALUES (3, 'changed', 9), (100, 'new', 1), (100, 'again', 2) ON DUPLICATE KEY UPDATE n_name = CONCAT(n_name, '!'), n_regionkey = n_regionkey + 10"], "SELECT * FROM nation", "SELECT n_nationkey, CASE WHEN n_nationkey = 3 THEN n_name || '!' ELSE n_name END AS n_name, (CASE WHEN n_nationkey = 3 THEN n_regionkey + 10 ELSE n_regionkey END)::BIGINT AS n_regionkey FROM nation UNION ALL SELECT 100, 'new!', 11", _N)
_after("dml_replace", ["CREATE UNIQUE INDEX u ON nation(n_name)", "REPLACE INTO nation VALUES (3, 'three', 9), (200, 'three', 8)"], "SELECT * FROM nation", "SELECT n_nationkey, n_name, n_regionkey::BIGINT AS n_regionkey FROM nation WHERE n_nationkey <> 3 UNION ALL SELECT 200, 'three', 8", _N)
_FK = ["CREATE TABLE c (id BIGINT PRIMARY KEY, nk BIGINT, FOREIGN KEY (nk) REFERENCES nation(n_nationkey) ON DELETE {} ON UPDATE CASCADE)", "INSERT INTO c VALUES (1, 3), (2, 4), (3, 3), (4, NULL)"]
_after("dml_fk_cascade", [_FK[0].format("CASCADE"), _FK[1], "DELETE FROM nation WHERE n_nationkey = 3", "UPDATE nation SET n_nationkey = 40 WHERE n_nationkey = 4"], "SELECT id, nk FROM c", "SELECT * FROM (VALUES (2::BIGINT, 40::BIGINT), (4, NULL)) AS t(id, nk)", _N)
_after("dml_fk_set_null", [_FK[0].format("SET NULL"), _FK[1], "DELETE FROM nation WHERE n_nationkey = 3"], "SELECT id, nk FROM c", "SELECT * FROM (VALUES (1::BIGINT, NULL::BIGINT), (2, 4), (3, NULL), (4, NULL)) AS t(id, nk)", _N)
_after("dml_savepoint_flow", ["BEGIN", "DELETE FROM nation WHERE n_nationkey < 10", "SAVEPOINT s", "DELETE FROM nation", "ROLLBACK TO SAVEPOINT s", "COMMIT"], "SELECT n_nationkey FROM nation", "SELECT n_nationkey::BIGINT AS n_nationkey FROM nation WHERE n_nationkey >= 10", _N)
_after("dml_rollback", ["BEGIN", "UPDATE nation SET n_name = 'x'", "ROLLBACK"], "SELECT n_nationkey, n_name FROM nation", "SELECT n_nationkey::BIGINT AS n_nationkey, n_name FROM nation", _N)
_after("ddl_alter", ["ALTER TABLE nation ADD COLUMN tag VARCHAR(5) DEFAULT 'new'", "ALTER TABLE nation CHANGE n_name label TEXT", "ALTER TABLE nation MODIFY n_regionkey SMALLINT", "UPDATE nation SET tag = 'old' WHERE n_nationkey < 5", "ALTER TABLE nation DROP COLUMN n_regionkey", "RENAME TABLE nation TO n2"], "SELECT n_nationkey, label, tag FROM n2", "SELECT n_nationkey::BIGINT AS n_nationkey, n_name AS label, CASE WHEN n_nationkey < 5 THEN 'old' ELSE 'new' END AS tag FROM nation", _N)

# reports
_after("show_tables", ["CREATE TABLE b (x INT)", "CREATE TABLE a (y INT)", "DROP TABLE b"], "SHOW TABLES", 'SELECT * FROM (VALUES (\'a\'), (\'nation\')) AS t("Table")', _N)
_after("describe", ["CREATE TABLE t (id INT PRIMARY KEY, v VARCHAR(3) NOT NULL DEFAULT 'q')"], "DESCRIBE t", "SELECT * FROM (VALUES ('id', 'INT', 'NO', 'PRI', 'NULL', ''), ('v', 'VARCHAR(3)', 'NO', '', 'q', '')) AS t(Field, Type, \"Null\", Key, \"Default\", Extra)", {})
_after("show_create_table", ["CREATE TABLE t (id INT PRIMARY KEY, v DECIMAL(5,1) CHECK (v > 1))"], "SHOW CREATE TABLE t", "SELECT 't' AS \"Table\", 'CREATE TABLE t (' || chr(10) || '  id INT PRIMARY KEY,' || chr(10) || '  v DECIMAL(5,1) CHECK (v > 1)' || chr(10) || ')' AS \"Create Table\"", {})
_after("explain_plan", ["CREATE INDEX i ON nation(n_regionkey)", "ANALYZE TABLE nation"], "EXPLAIN SELECT * FROM nation WHERE n_regionkey = 2", "SELECT 1::BIGINT AS id, 'SIMPLE' AS select_type, 'nation' AS \"table\", 'ref' AS type, 'i' AS key, count(*) // count(DISTINCT n_regionkey) AS \"rows\", 1200 + 3 * (count(*) // count(DISTINCT n_regionkey)) AS cost, 'Using where; Using index' AS Extra FROM nation", _N)

# definitions and changes on whole given tables
_D = {"documents": ["doc_id"]}
_after("ddl_drop_index", ["CREATE UNIQUE INDEX u ON nation(n_name)", "DROP INDEX u", "UPDATE nation SET n_name = 'same'"], "SELECT n_nationkey, n_name FROM nation", "SELECT n_nationkey::BIGINT AS n_nationkey, 'same' AS n_name FROM nation", _N)
_after("ddl_rename_table", ["RENAME TABLE nation TO land", "DELETE FROM land WHERE n_regionkey = 0"], "SELECT n_nationkey, n_name FROM land", "SELECT n_nationkey::BIGINT AS n_nationkey, n_name FROM nation WHERE n_regionkey <> 0", _N)
_after("dml_fk_update_set_null", [_FK[0].format("CASCADE").replace("ON UPDATE CASCADE", "ON UPDATE SET NULL"), _FK[1], "UPDATE nation SET n_nationkey = 40 WHERE n_nationkey = 3"], "SELECT id, nk FROM c", "SELECT * FROM (VALUES (1::BIGINT, NULL::BIGINT), (2, 4), (3, NULL), (4, NULL)) AS t(id, nk)", _N)
_after(
    "dml_savepoint_release",
    ["BEGIN", "DELETE FROM nation WHERE n_nationkey < 5", "SAVEPOINT s", "DELETE FROM nation WHERE n_nationkey < 10", "RELEASE SAVEPOINT s", "COMMIT"],
    "SELECT n_nationkey FROM nation", "SELECT n_nationkey::BIGINT AS n_nationkey FROM nation WHERE n_nationkey >= 10", _N,
)
_after(
    "fts_index_follows_changes",
    ["CREATE FULLTEXT INDEX f ON documents(text) WITH PARSER ngram OPTIONS (n=2, normalize='nfkc')", "UPDATE documents SET text = 'zebra quagga' WHERE lang = 'en' AND MATCH(text) AGAINST('+th' IN BOOLEAN MODE) > 0", "DELETE FROM documents WHERE MATCH(text) AGAINST('+qu -zebra' IN BOOLEAN MODE) > 0"],
    "SELECT doc_id, MATCH(text) AGAINST('\"zebra\"' IN BOOLEAN MODE) AS z FROM documents",
    """WITH u AS (SELECT doc_id, CASE WHEN lang = 'en' AND contains(text, 'th') THEN 'zebra quagga' ELSE text END AS text FROM documents)
SELECT doc_id, CASE WHEN contains(text, 'zebra') THEN 1000000 ELSE 0 END::BIGINT AS z FROM u WHERE text IS NULL OR NOT (contains(text, 'qu') AND NOT (contains(text, 'ze') OR contains(text, 'eb') OR contains(text, 'br') OR contains(text, 'ra')))""",
    _D,
)
