"""Subqueries, nested queries and common table expressions."""

from __future__ import annotations

from lumenframe.queries.registry import Registry

R = Registry()

R.sql("in_subquery", "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal > 5000)")
R.sql("not_in_subquery", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 100000)")
R.sql("not_in_subquery_null", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT CASE WHEN o_orderkey = 1 THEN NULL ELSE o_custkey END FROM orders)")
R.sql("exists", "SELECT s_suppkey FROM supplier WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_suppkey = s_suppkey AND l_quantity >= 50)")
R.sql("not_exists", "SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
R.sql("scalar_subquery", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > (SELECT 1.5 * avg(o_totalprice) FROM orders)")
R.sql("correlated_scalar", "SELECT p_partkey, l_orderkey, l_quantity FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_quantity < (SELECT 0.3 * avg(i.l_quantity) FROM lineitem i WHERE i.l_partkey = p_partkey) AND p_size < 10")
R.sql("nested_from", "SELECT seg, max(total) AS most FROM (SELECT c_mktsegment AS seg, c_nationkey AS nat, round(sum(c_acctbal), 2) AS total FROM customer GROUP BY c_mktsegment, c_nationkey) AS t GROUP BY seg")
R.sql(
    "cte",
    """WITH big AS (SELECT o_custkey, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY o_custkey HAVING count(*) > 10),
            named AS (SELECT c_custkey, c_name, c_nationkey FROM customer)
       SELECT c_name, n, total, n_name FROM big JOIN named ON o_custkey = c_custkey JOIN nation ON n_nationkey = c_nationkey""",
)
R.sql("cte_reused", "WITH t AS (SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY l_suppkey) SELECT a.l_suppkey AS supp, a.n AS n FROM t a WHERE a.n = (SELECT max(n) FROM t)")
