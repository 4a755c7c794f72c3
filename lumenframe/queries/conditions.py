"""Scans, projections, filters and conditional expressions."""

from __future__ import annotations

from lumenframe.queries.registry import Registry

R = Registry()

# scans and projections
R.sql("scan_all", "SELECT * FROM orders")
R.sql("scan_projected", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderdate >= TIMESTAMP_NTZ '2000-01-01 00:00:00' AND o_totalprice > 100000")
R.sql("scan_limit_ordered", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50")
R.sql("scan_count_star", "SELECT count(*) AS n FROM lineitem")
R.sql("project_arith", "SELECT l_orderkey, l_linenumber, l_quantity, round(l_extendedprice * (1 - l_discount) * (1 + l_tax), 6) AS charge, l_quantity * 2 + l_linenumber AS mixed FROM lineitem")
R.sql(
    "project_literals",
    """SELECT r_regionkey, 1 AS i, CAST(2.5 AS DOUBLE) AS d, 'it''s' AS s, TRUE AS b, DATE '2020-02-29' AS dt,
              TIMESTAMP_NTZ '2020-02-29 12:34:56' AS ts, CAST(NULL AS INTEGER) AS nothing FROM region""",
)
R.sql("project_alias", "SELECT n.n_nationkey AS id, n.n_name AS label, n.n_regionkey + 1 AS region_no FROM nation AS n")
R.sql("select_distinct", "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")

# filters
R.sql("filter_cmp_num", "SELECT l_orderkey, l_quantity FROM lineitem WHERE l_quantity >= 49 AND l_discount < 0.03 AND l_tax <> 0 AND l_linenumber <= 3")
R.sql("filter_cmp_str", "SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority >= '3' AND o_orderpriority < '5' AND o_orderstatus <> 'F'")
R.sql("filter_cmp_ts", "SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate > TIMESTAMP_NTZ '1998-06-01 00:00:00' AND o_orderdate <= TIMESTAMP_NTZ '1998-09-30 00:00:00'")
R.sql("filter_and_or_not", "SELECT c_custkey FROM customer WHERE (c_mktsegment = 'BUILDING' OR c_acctbal > 9000) AND NOT (c_nationkey = 3 OR c_nationkey > 20)")
R.sql(
    "filter_is_null",
    "SELECT k, v FROM (SELECT c_custkey AS k, CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_acctbal END AS v FROM customer) AS t WHERE v IS NULL OR (v IS NOT NULL AND v < 0)",
)
R.sql(
    "filter_is_true_false",
    """SELECT k, (b IS TRUE) AS t, (b IS NOT TRUE) AS nt, (b IS FALSE) AS f, (b IS NOT FALSE) AS nf
       FROM (SELECT c_custkey AS k, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_acctbal > 5000 END AS b FROM customer) AS t WHERE b IS NOT FALSE""",
)
R.sql(
    "filter_three_valued",
    """SELECT k, a AND b AS both_true, a OR b AS any_true, NOT a AS neg
       FROM (SELECT c_custkey AS k, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_custkey % 3 = 1 END AS a,
                    CASE WHEN c_nationkey % 3 = 0 THEN NULL ELSE c_nationkey % 3 = 1 END AS b FROM customer) AS t""",
)
R.sql(
    "filter_not_distinct",
    """SELECT k, a, b FROM (SELECT c_custkey AS k, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_nationkey END AS a,
              CASE WHEN c_custkey % 10 = 0 THEN NULL ELSE c_custkey % 25 END AS b FROM customer) AS t WHERE a IS NOT DISTINCT FROM b""",
)
R.sql(
    "filter_distinct_from",
    """SELECT k FROM (SELECT c_custkey AS k, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_nationkey END AS a,
              CASE WHEN c_custkey % 10 = 0 THEN NULL ELSE c_custkey % 25 END AS b FROM customer) AS t WHERE a IS DISTINCT FROM b""",
)
R.sql("filter_between", "SELECT p_partkey, p_size FROM part WHERE p_size BETWEEN 10 AND 20 AND p_retailprice NOT BETWEEN 950 AND 1000")
R.sql("filter_in_list", "SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_nationkey NOT IN (1, 2, 3)")
R.sql("filter_like", "SELECT p_partkey, p_name FROM part WHERE p_name LIKE 'small%' OR p_name LIKE '%bolt' OR p_name LIKE '_ed%'")
R.sql("filter_not_like", "SELECT p_partkey, p_name FROM part WHERE p_name NOT LIKE '%o%' AND p_brand LIKE 'Brand#1_'")
R.sql("filter_like_special", "SELECT c_custkey, c_name FROM customer WHERE c_name LIKE '%#0000000_9' AND c_name NOT LIKE '%.%'")
R.sql("filter_pushdown_expr", "SELECT o_orderkey FROM orders WHERE o_orderkey + 10 < 500 AND abs(o_totalprice - 200000) < 50000")

# conditional expressions
R.sql("case_num", "SELECT o_orderkey, CASE WHEN o_totalprice > 400000 THEN 3 WHEN o_totalprice > 200000 THEN 2 ELSE 1 END AS band, CASE o_orderstatus WHEN 'F' THEN o_totalprice END AS closed FROM orders")
R.sql("case_str", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'final' WHEN o_orderstatus = 'O' THEN o_orderpriority ELSE 'pending' END AS state FROM orders")
R.sql("coalesce", "SELECT c_custkey, coalesce(CASE WHEN c_custkey % 2 = 0 THEN c_acctbal END, CASE WHEN c_custkey % 3 = 0 THEN -1.5 END, 0.0) AS v, coalesce(CASE WHEN c_nationkey > 12 THEN c_name END, 'none') AS s FROM customer")
R.sql(
    "nvl",
    "SELECT c_custkey, nvl(CASE WHEN c_custkey % 2 = 0 THEN c_nationkey END, -1) AS v FROM customer",
    "SELECT c_custkey, ifnull(CASE WHEN c_custkey % 2 = 0 THEN c_nationkey END, -1) AS v FROM customer",
)
R.sql("nullif", "SELECT c_custkey, nullif(c_nationkey, 5) AS v, nullif(c_mktsegment, 'BUILDING') AS s FROM customer")
R.sql("greatest_least", "SELECT l_orderkey, greatest(l_quantity, l_linenumber, 10) AS g, least(l_discount, l_tax) AS l, greatest('a', l_returnflag) AS s FROM lineitem")
R.sql(
    "boolean_columns",
    """SELECT o_orderkey, o_totalprice > 250000 AS big, (o_totalprice > 250000) = (o_orderstatus = 'F') AS agree,
              CASE WHEN o_totalprice > 250000 AND NOT o_orderstatus = 'F' THEN TRUE ELSE FALSE END AS open_big FROM orders""",
)
