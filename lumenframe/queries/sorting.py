"""Sorting, limits and set operations."""

from __future__ import annotations

from lumenframe.operators import order_by, top_k_per_group, widened_union
from lumenframe.queries.registry import Registry, Tables

R = Registry()

R.sql("sort_multi", "SELECT c_custkey, c_mktsegment, c_acctbal FROM customer ORDER BY c_mktsegment ASC NULLS LAST, c_acctbal DESC NULLS LAST, c_custkey LIMIT 100")
R.sql("sort_nulls", "SELECT k, v FROM (SELECT c_custkey AS k, CASE WHEN c_custkey % 50 = 0 THEN NULL ELSE c_acctbal END AS v FROM customer) AS t ORDER BY v ASC NULLS FIRST, k LIMIT 60")
R.sql("sort_nulls_default_desc", "SELECT k, v FROM (SELECT c_custkey AS k, CASE WHEN c_custkey % 50 = 0 THEN NULL ELSE c_acctbal END AS v FROM customer) AS t ORDER BY v DESC NULLS FIRST, k LIMIT 60")
R.sql("sort_ordinal_alias", "SELECT n_regionkey AS reg, n_name AS label FROM nation ORDER BY reg DESC, 2 LIMIT 12")
R.sql("sort_expression", "SELECT p_partkey, p_size FROM part ORDER BY p_size % 7 DESC, abs(p_partkey - 500), p_partkey LIMIT 40")
R.sql("topk", "SELECT l_orderkey, l_linenumber, l_extendedprice, l_quantity, l_partkey FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey LIMIT 100")
R.sql("limit_offset", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 25 OFFSET 100")
R.sql("limit_zero", "SELECT o_orderkey FROM orders LIMIT 0")
R.sql("union_all", "SELECT c_nationkey AS k, c_name AS label FROM customer WHERE c_acctbal > 9000 UNION ALL SELECT s_nationkey, s_name FROM supplier UNION ALL SELECT s_nationkey, s_name FROM supplier")
R.sql("union_distinct", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier UNION SELECT NULL")
R.sql("union_type_widen", "SELECT n_nationkey AS v, n_name AS s FROM nation UNION ALL SELECT s_acctbal, s_name FROM supplier")
R.sql("intersect", "SELECT c_nationkey AS k FROM customer WHERE c_acctbal > 9500 INTERSECT SELECT s_nationkey FROM supplier")
R.sql("except", "SELECT n_nationkey AS k FROM nation EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000")
R.sql(
    "minus",
    "SELECT n_nationkey AS k FROM nation MINUS SELECT c_nationkey FROM customer WHERE c_acctbal > 9700",
    "SELECT n_nationkey AS k FROM nation EXCEPT SELECT c_nationkey FROM customer WHERE c_acctbal > 9700",
)


@R.frame("sort_op_order_by", "SELECT k, v FROM (SELECT c_custkey AS k, CASE WHEN c_custkey % 50 = 0 THEN NULL ELSE c_acctbal END AS v FROM customer) AS t ORDER BY v DESC NULLS FIRST, k LIMIT 40 OFFSET 10")
def _order_by(t: Tables):
    rows = t.sql("SELECT c_custkey AS k, CASE WHEN c_custkey % 50 = 0 THEN NULL ELSE c_acctbal END AS v FROM customer")
    return order_by(rows, ("v", "desc"), "k", limit=40, offset=10)


@R.frame("sort_op_top_per_group", "SELECT l_suppkey, l_orderkey, l_linenumber, l_extendedprice FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey) AS r FROM lineitem) AS t WHERE r <= 3")
def _top_per_group(t: Tables):
    rows = t.lineitem.select("l_suppkey", "l_orderkey", "l_linenumber", "l_extendedprice", "l_partkey")
    return top_k_per_group(rows, ["l_suppkey"], [("l_extendedprice", "desc"), "l_orderkey", "l_linenumber", "l_partkey"], 3).drop("l_partkey")


@R.frame("union_op_widened", "SELECT CAST(n_nationkey AS DOUBLE) AS v FROM nation UNION SELECT s_acctbal FROM supplier UNION SELECT CAST(n_regionkey > 2 AS INTEGER) FROM nation")
def _widened(t: Tables):
    return widened_union(t.nation.selectExpr("n_nationkey AS v"), t.supplier.select("s_acctbal"), t.nation.selectExpr("n_regionkey > 2"), distinct=True)
