"""Aggregations."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenframe.operators import count_rows_with_all, keep_first
from lumenframe.queries.registry import Registry, Tables

R = Registry()
NULLS = "(SELECT c_custkey AS k, CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_nationkey END AS g, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_acctbal END AS v FROM customer) AS t"

R.sql("agg_global", "SELECT count(*) AS n, round(sum(l_quantity), 2) AS q, round(avg(l_discount), 6) AS d, min(l_shipdate) AS first_ship, max(l_shipdate) AS last_ship FROM lineitem")
R.sql("agg_global_empty", "SELECT count(*) AS n, sum(l_quantity) AS q, max(l_returnflag) AS f FROM lineitem WHERE l_quantity < 0")
R.sql("agg_group", "SELECT l_returnflag, count(*) AS n, round(sum(l_extendedprice), 2) AS total FROM lineitem GROUP BY l_returnflag")
R.sql("agg_group_multi", "SELECT l_returnflag, l_linestatus, l_linenumber, count(*) AS n, round(avg(l_quantity), 6) AS q FROM lineitem GROUP BY l_returnflag, l_linestatus, l_linenumber")
R.sql("agg_group_expr", "SELECT year(o_orderdate) AS y, o_totalprice > 250000 AS big, count(*) AS n FROM orders GROUP BY year(o_orderdate), o_totalprice > 250000")
R.sql("agg_group_ordinal", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY 1, 2")
R.sql("agg_group_null_key", f"SELECT g, count(*) AS n, count(v) AS nv, round(sum(v), 2) AS s FROM {NULLS} GROUP BY g")
R.sql("agg_count_star", "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY o_orderstatus")
R.sql("agg_count_col", f"SELECT count(g) AS ng, count(v) AS nv FROM {NULLS}")
R.sql("agg_count_multi", f"SELECT count(g, v) AS n FROM {NULLS}", f"SELECT count(CASE WHEN g IS NOT NULL AND v IS NOT NULL THEN 1 END) AS n FROM {NULLS}")
R.sql("agg_count_distinct", "SELECT l_returnflag, count(DISTINCT l_suppkey) AS supps, count(DISTINCT l_partkey) AS parts FROM lineitem GROUP BY l_returnflag")
R.sql("agg_count_distinct_global", "SELECT count(DISTINCT o_custkey) AS custs, count(DISTINCT o_orderpriority) AS prios, count(*) AS n FROM orders")
R.sql("agg_sum", "SELECT l_linenumber, sum(l_orderkey) AS keys, round(sum(l_tax), 4) AS tax FROM lineitem GROUP BY l_linenumber")
R.sql("agg_sum0", f"SELECT g, coalesce(round(sum(CASE WHEN v > 9000 THEN v END), 2), 0) AS s FROM {NULLS} GROUP BY g")
R.sql("agg_min_max", "SELECT o_orderpriority, min(o_totalprice) AS lo, max(o_totalprice) AS hi, min(o_orderdate) AS d0, max(o_orderstatus) AS st FROM orders GROUP BY o_orderpriority")
R.sql("agg_avg", f"SELECT g, round(avg(v), 6) AS a, round(avg(k), 6) AS ak FROM {NULLS} GROUP BY g")
R.sql("agg_stddev_pop", "SELECT p_brand, round(stddev_pop(p_retailprice), 6) AS s FROM part GROUP BY p_brand")
R.sql("agg_stddev_samp", "SELECT p_brand, round(stddev_samp(p_retailprice), 6) AS s, round(stddev(p_size), 6) AS z FROM part GROUP BY p_brand")
R.sql("agg_var_pop", "SELECT p_type, round(var_pop(p_size), 6) AS v FROM part GROUP BY p_type")
R.sql("agg_var_samp", "SELECT p_type, round(var_samp(p_size), 6) AS v, round(variance(p_size), 6) AS w FROM part GROUP BY p_type")
R.sql("agg_having", "SELECT o_custkey, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY o_custkey HAVING count(*) >= 15 AND sum(o_totalprice) > 1000000")
R.sql("agg_expr_of_aggs", "SELECT l_linestatus, round(sum(l_extendedprice) / count(*), 4) AS mean_price, max(l_quantity) - min(l_quantity) AS span FROM lineitem GROUP BY l_linestatus")
R.sql("group_no_agg", f"SELECT g FROM {NULLS} GROUP BY g")
R.sql("agg_rollup", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
R.sql("agg_cube", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")


@R.frame("agg_op_count_all", f"SELECT g, count(CASE WHEN k IS NOT NULL AND v IS NOT NULL THEN 1 END) AS n FROM {NULLS} GROUP BY g")
def _count_all(t: Tables):
    return t.sql(f"SELECT * FROM {NULLS}").groupBy("g").agg(count_rows_with_all("k", "v").alias("n"))


@R.frame("agg_op_keep_first", f"SELECT DISTINCT g, v IS NULL AS nothing FROM {NULLS}")
def _keep_first(t: Tables):
    return keep_first(t.sql(f"SELECT * FROM {NULLS}").select("g", F.col("v").isNull().alias("nothing")), ["g", "nothing"])
