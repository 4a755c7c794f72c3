"""Window functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenframe.operators import bounded_rows, numbered, running
from lumenframe.queries.registry import Registry, Tables

R = Registry()
O = "PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey"  # noqa: E741
NULLS = "(SELECT c_custkey AS k, c_nationkey AS p, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE c_acctbal END AS v FROM customer) AS t"

R.sql("win_min_part", "SELECT o_orderkey, min(o_totalprice) OVER (PARTITION BY o_custkey) AS v FROM orders")
R.sql("win_max_part", "SELECT o_orderkey, max(o_totalprice) OVER (PARTITION BY o_custkey, o_orderstatus) AS v FROM orders")
R.sql("win_count_part", "SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey) AS v FROM orders")
R.sql("win_sum_part", "SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey), 2) AS v FROM orders")
R.sql("win_avg_part", "SELECT o_orderkey, round(avg(o_totalprice) OVER (PARTITION BY o_custkey), 7) AS v FROM orders")
R.sql("win_running_sum", f"SELECT o_orderkey, round(sum(o_totalprice) OVER ({O} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 2) AS v FROM orders")
R.sql("win_row_number", f"SELECT o_orderkey, row_number() OVER ({O}) AS v FROM orders")
R.sql("win_lag", f"SELECT o_orderkey, lag(o_totalprice, 1) OVER ({O}) AS v, lag(o_orderkey, 3) OVER ({O}) AS w FROM orders")
R.sql("win_lead", f"SELECT o_orderkey, lead(o_totalprice, 1) OVER ({O}) AS v, lead(o_orderkey, 2) OVER ({O}) AS w FROM orders")
R.sql("win_first_value", f"SELECT o_orderkey, first_value(o_totalprice) OVER ({O}) AS v FROM orders")
R.sql("win_last_value", f"SELECT o_orderkey, last_value(o_totalprice) OVER ({O} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS v FROM orders")
R.sql("win_rows_bounded", f"SELECT o_orderkey, round(sum(o_totalprice) OVER ({O} ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING), 2) AS v, count(*) OVER ({O} ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING) AS n FROM orders")
R.sql("win_rows_unbounded_preceding", f"SELECT o_orderkey, max(o_totalprice) OVER ({O} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS v FROM orders")
R.sql("win_rows_unbounded_following", f"SELECT o_orderkey, min(o_totalprice) OVER ({O} ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS v FROM orders")
R.sql("win_rows_whole", f"SELECT o_orderkey, count(*) OVER ({O} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS v FROM orders")
R.sql("win_nulls_first_last", f"SELECT k, row_number() OVER (PARTITION BY p ORDER BY v ASC NULLS FIRST, k) AS a, row_number() OVER (PARTITION BY p ORDER BY v DESC NULLS LAST, k) AS b FROM {NULLS}")
R.sql("win_null_values", f"SELECT k, count(v) OVER (PARTITION BY p) AS n, round(sum(v) OVER (PARTITION BY p ORDER BY k ROWS BETWEEN 1 PRECEDING AND CURRENT ROW), 2) AS s FROM {NULLS}")
R.sql("win_multi_over", f"SELECT o_orderkey, row_number() OVER ({O}) AS a, count(*) OVER (PARTITION BY o_orderstatus) AS b, max(o_totalprice) OVER (PARTITION BY o_orderpriority) AS c FROM orders")
R.sql("win_range", "SELECT l_orderkey, l_linenumber, count(*) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber RANGE BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS v FROM lineitem")
R.sql("win_range_default", "SELECT l_orderkey, l_linenumber, count(*) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS v FROM lineitem")
R.sql("win_rank", "SELECT c_custkey, rank() OVER (PARTITION BY c_mktsegment ORDER BY c_nationkey) AS v FROM customer")
R.sql("win_dense_rank", "SELECT c_custkey, dense_rank() OVER (PARTITION BY c_mktsegment ORDER BY c_nationkey DESC) AS v FROM customer")
R.sql("win_top_per_group", "SELECT o_custkey, o_orderkey, r FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) AS t WHERE r <= 2")
R.sql("win_agg_then_window", "SELECT y, n, sum(n) OVER (PARTITION BY 1 ORDER BY y ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS total FROM (SELECT year(o_orderdate) AS y, count(*) AS n FROM orders GROUP BY year(o_orderdate)) AS t")


@R.frame("win_no_partition", "SELECT o_orderkey, round(sum(o_totalprice) OVER (ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 3 PRECEDING AND 2 FOLLOWING), 2) AS v, min(o_totalprice) OVER (ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 3 PRECEDING AND 2 FOLLOWING) AS m FROM orders")
def _no_partition(t: Tables):
    orders = t.orders.select("o_orderkey", "o_orderdate", "o_totalprice")
    return bounded_rows(orders, ["o_orderdate", "o_orderkey"], {"v": F.sum("o_totalprice"), "m": F.min("o_totalprice")}, 3, 2).select("o_orderkey", F.round("v", 2).alias("v"), "m")


@R.frame("win_op_numbered", "SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS row_number FROM orders")
def _numbered(t: Tables):
    return numbered(t.orders.select("o_orderkey", "o_totalprice"), [("o_totalprice", "desc"), "o_orderkey"]).select("o_orderkey", "row_number")


@R.frame("win_op_running", "SELECT o_orderkey, CAST(sum(o_custkey) OVER (ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING) AS BIGINT) AS v FROM orders")
def _running(t: Tables):
    return running(t.orders.select("o_orderkey", "o_orderdate", "o_custkey"), ["o_orderdate", "o_orderkey"], "o_custkey", "v").select("o_orderkey", "v")
