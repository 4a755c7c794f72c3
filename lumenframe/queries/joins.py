"""Joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenframe.operators import anti_join_null_aware, null_safe_join, range_join, salted_join, spread_join
from lumenframe.queries.registry import Registry, Tables

R = Registry()
NULLABLE = "SELECT c_custkey AS k, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE c_nationkey END AS a FROM customer"
OTHER = "SELECT s_suppkey AS s, CASE WHEN s_suppkey % 9 = 0 THEN NULL ELSE s_nationkey END AS b FROM supplier"

R.sql("join_inner", "SELECT o_orderkey, c_name, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 300000")
R.sql("join_inner_multi_key", "SELECT a.l_orderkey, a.l_linenumber, a.l_quantity, b.l_quantity AS other FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber AND a.l_quantity < b.l_quantity")
R.sql("join_inner_residual", "SELECT o_orderkey, l_linenumber, l_shipdate FROM orders JOIN lineitem ON o_orderkey = l_orderkey AND l_shipdate > o_orderdate AND l_quantity > 45")
R.sql("join_cross", "SELECT r_name, n_name FROM region CROSS JOIN nation")
R.sql("join_mixed_null_safe", f"SELECT k, a, s FROM ({NULLABLE}) AS x JOIN ({OTHER}) AS y ON k = s AND a IS NOT DISTINCT FROM b")
R.sql("join_self", "SELECT a.n_name AS n1, b.n_name AS n2 FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
R.sql("join_comma", "SELECT c_custkey, n_name, r_name FROM customer, nation, region WHERE c_nationkey = n_nationkey AND n_regionkey = r_regionkey AND r_name <> 'ASIA'")
R.sql("join_using", "SELECT k, total, n FROM (SELECT o_custkey AS k, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY o_custkey) AS a JOIN (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY o_custkey) AS b USING (k)")
R.sql("join_natural", "SELECT k, x, y FROM (SELECT n_nationkey AS k, n_name AS x FROM nation) AS a NATURAL JOIN (SELECT s_nationkey AS k, s_name AS y FROM supplier) AS b")
R.sql("join_mixed_key_types", "SELECT s_suppkey, n_name FROM supplier JOIN nation ON s_suppkey = CAST(n_nationkey AS DOUBLE)")
R.sql("join_left_residual", "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 350000 AND c_acctbal < o_totalprice / 100")
R.sql("join_or_root", "SELECT n_nationkey, r_name FROM nation JOIN region ON n_regionkey = r_regionkey OR n_nationkey = r_regionkey")
R.sql(
    "join_semi",
    "SELECT c_custkey FROM customer LEFT SEMI JOIN orders ON c_custkey = o_custkey AND o_totalprice > 400000",
    "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE c_custkey = o_custkey AND o_totalprice > 400000)",
)
R.sql(
    "join_anti",
    "SELECT c_custkey FROM customer LEFT ANTI JOIN orders ON c_custkey = o_custkey AND o_totalprice > 200000",
    "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE c_custkey = o_custkey AND o_totalprice > 200000)",
)


@R.frame("join_full", f"SELECT k, a, b, s FROM ({NULLABLE}) AS x FULL OUTER JOIN ({OTHER}) AS y ON a = b")
def _full(t: Tables):
    return spread_join(t.sql(NULLABLE), t.sql(OTHER), [("a", "b")], "full").select("k", "a", "b", "s")


@R.frame("join_null_safe", f"SELECT k, a, b, s FROM ({NULLABLE}) AS x JOIN ({OTHER}) AS y ON a IS NOT DISTINCT FROM b")
def _null_equal(t: Tables):
    return spread_join(t.sql(NULLABLE), t.sql(OTHER), [("a", "b")], null_safe=True).select("k", "a", "b", "s")


@R.frame("join_right", f"SELECT k, b, s FROM ({NULLABLE}) AS x RIGHT JOIN ({OTHER}) AS y ON a = b")
def _right(t: Tables):
    return spread_join(t.sql(NULLABLE), t.sql(OTHER), [("a", "b")], "right").select("k", "b", "s")


@R.frame("join_left", f"SELECT k, a, s FROM ({NULLABLE}) AS x LEFT JOIN ({OTHER}) AS y ON a = b")
def _left(t: Tables):
    return spread_join(t.sql(NULLABLE), t.sql(OTHER), [("a", "b")], "left").select("k", "a", "s")


@R.frame("join_op_null_safe", f"SELECT k, s FROM ({NULLABLE}) AS x JOIN ({OTHER}) AS y ON a IS NOT DISTINCT FROM b")
def _null_safe(t: Tables):
    return null_safe_join(t.sql(NULLABLE), t.sql(OTHER), [("a", "b")]).select("k", "s")


@R.frame("join_non_equi", "SELECT a.p_partkey AS p1, b.p_partkey AS p2 FROM part a JOIN part b ON a.p_retailprice < b.p_retailprice AND a.p_size > b.p_size + 40")
def _non_equi(t: Tables):
    a = t.sql("SELECT p_partkey AS p1, p_retailprice AS price1, p_size AS size1 FROM part")
    b = t.sql("SELECT p_partkey AS p2, p_retailprice AS price2, p_size + 40 AS size2 FROM part")
    return range_join(a, b, (F.col("size1"), F.col("size2")), F.col("price1") < F.col("price2")).select("p1", "p2")


@R.frame("join_op_salted", "SELECT l_returnflag, count(*) AS n, CAST(sum(w) AS BIGINT) AS w FROM lineitem JOIN (SELECT DISTINCT l_returnflag AS f, ascii(l_returnflag) AS w FROM lineitem) AS k ON l_returnflag = f GROUP BY l_returnflag")
def _salted(t: Tables):
    weights = t.sql("SELECT DISTINCT l_returnflag, ascii(l_returnflag) AS w FROM lineitem")
    return salted_join(t.lineitem.select("l_returnflag", "l_orderkey"), weights, "l_returnflag").groupBy("l_returnflag").agg(F.count("*").alias("n"), F.sum("w").alias("w"))


@R.frame("join_op_not_in", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 150000)")
def _not_in(t: Tables):
    return anti_join_null_aware(t.customer.select("c_custkey"), t.orders.where("o_totalprice > 150000"), "c_custkey", "o_custkey")
