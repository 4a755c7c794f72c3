"""Decision-support queries, on the columns that the tables have."""

from __future__ import annotations

from lumenframe.queries.registry import Registry

R = Registry()

R.sql(
    "q1",
    """SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base_price,
              round(sum(l_extendedprice * (1 - l_discount)), 4) AS sum_disc_price, round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 1) AS sum_charge,
              round(avg(l_quantity), 4) AS avg_qty, round(avg(l_extendedprice), 3) AS avg_price, round(avg(l_discount), 6) AS avg_disc, count(*) AS count_order
       FROM lineitem WHERE l_shipdate <= TIMESTAMP_NTZ '2001-09-02 00:00:00' GROUP BY l_returnflag, l_linestatus ORDER BY l_returnflag, l_linestatus""",
)
R.sql(
    "q2",  # what a supplier asks for a part is taken from the lineitems
    """WITH ps AS (SELECT l_partkey AS ps_partkey, l_suppkey AS ps_suppkey, min(l_extendedprice) AS ps_supplycost FROM lineitem GROUP BY l_partkey, l_suppkey),
            here AS (SELECT ps_partkey, ps_supplycost, s_acctbal, s_name, n_name FROM ps JOIN supplier ON ps_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_regionkey = 3)
       SELECT round(s_acctbal, 2) AS s_acctbal, s_name, n_name, p_partkey, p_brand, round(ps_supplycost, 2) AS ps_supplycost FROM part JOIN here AS h ON p_partkey = h.ps_partkey
       WHERE p_size <= 15 AND p_type LIKE 'S%' AND h.ps_supplycost = (SELECT min(o.ps_supplycost) FROM here AS o WHERE o.ps_partkey = p_partkey)
       ORDER BY s_acctbal DESC, n_name, s_name, p_partkey LIMIT 100""",
)
R.sql(
    "q3",
    """SELECT l_orderkey, round(sum(l_extendedprice * (1 - l_discount)), 4) AS revenue, o_orderdate FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey
       WHERE c_mktsegment = 'BUILDING' AND o_orderdate < TIMESTAMP_NTZ '1998-03-15 00:00:00' AND l_shipdate > TIMESTAMP_NTZ '1998-03-15 00:00:00'
       GROUP BY l_orderkey, o_orderdate ORDER BY revenue DESC, o_orderdate, l_orderkey LIMIT 10""",
)
R.sql(
    "q4",
    """SELECT o_orderpriority, count(*) AS order_count FROM orders WHERE o_orderdate >= TIMESTAMP_NTZ '1997-07-01 00:00:00' AND o_orderdate < TIMESTAMP_NTZ '1997-10-01 00:00:00'
         AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_shipdate > o_orderdate) GROUP BY o_orderpriority""",
)
R.sql(
    "q5",
    """SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 4) AS revenue FROM customer, orders, lineitem, supplier, nation, region
       WHERE c_custkey = o_custkey AND l_orderkey = o_orderkey AND l_suppkey = s_suppkey AND c_nationkey = s_nationkey AND s_nationkey = n_nationkey AND n_regionkey = r_regionkey
         AND r_name = 'ASIA' AND o_orderdate >= TIMESTAMP_NTZ '1996-01-01 00:00:00' AND o_orderdate < TIMESTAMP_NTZ '1998-01-01 00:00:00' GROUP BY n_name""",
)
R.sql(
    "q6",
    """SELECT round(sum(l_extendedprice * l_discount), 4) AS revenue FROM lineitem WHERE l_shipdate >= TIMESTAMP_NTZ '1996-01-01 00:00:00' AND l_shipdate < TIMESTAMP_NTZ '1997-01-01 00:00:00'
         AND l_discount BETWEEN 0.045 AND 0.075 AND l_quantity < 24""",
)
R.sql(
    "q7",
    """SELECT supp_nation, cust_nation, l_year, round(sum(volume), 4) AS revenue FROM (
         SELECT n1.n_name AS supp_nation, n2.n_name AS cust_nation, year(l_shipdate) AS l_year, l_extendedprice * (1 - l_discount) AS volume
         FROM supplier, lineitem, orders, customer, nation n1, nation n2
         WHERE s_suppkey = l_suppkey AND o_orderkey = l_orderkey AND c_custkey = o_custkey AND s_nationkey = n1.n_nationkey AND c_nationkey = n2.n_nationkey
           AND ((n1.n_name = 'NATION_3' AND n2.n_name = 'NATION_7') OR (n1.n_name = 'NATION_7' AND n2.n_name = 'NATION_3'))) AS shipping
       GROUP BY supp_nation, cust_nation, l_year""",
)
R.sql(
    "q8",
    """SELECT o_year, round(sum(CASE WHEN nation = 'NATION_4' THEN volume ELSE 0 END) / sum(volume), 6) AS mkt_share FROM (
         SELECT year(o_orderdate) AS o_year, l_extendedprice * (1 - l_discount) AS volume, n2.n_name AS nation
         FROM part, supplier, lineitem, orders, customer, nation n1, nation n2, region
         WHERE p_partkey = l_partkey AND s_suppkey = l_suppkey AND l_orderkey = o_orderkey AND o_custkey = c_custkey AND c_nationkey = n1.n_nationkey
           AND n1.n_regionkey = r_regionkey AND r_name = 'AMERICA' AND s_nationkey = n2.n_nationkey AND p_type = 'ECONOMY') AS all_nations GROUP BY o_year""",
)
R.sql(
    "q9",
    """SELECT n_name, year(o_orderdate) AS o_year, round(sum(l_extendedprice * (1 - l_discount) - 0.1 * p_retailprice * l_quantity), 4) AS profit
       FROM part JOIN lineitem ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey JOIN orders ON o_orderkey = l_orderkey JOIN nation ON s_nationkey = n_nationkey
       WHERE p_name LIKE '%ring%' GROUP BY n_name, year(o_orderdate)""",
)
R.sql(
    "q10",
    """SELECT c_custkey, c_name, round(sum(l_extendedprice * (1 - l_discount)), 4) AS revenue, c_acctbal, n_name FROM customer, orders, lineitem, nation
       WHERE c_custkey = o_custkey AND l_orderkey = o_orderkey AND o_orderdate >= TIMESTAMP_NTZ '1997-10-01 00:00:00' AND o_orderdate < TIMESTAMP_NTZ '1998-01-01 00:00:00'
         AND l_returnflag = 'R' AND c_nationkey = n_nationkey GROUP BY c_custkey, c_name, c_acctbal, n_name ORDER BY revenue DESC, c_custkey LIMIT 20""",
)
R.sql(
    "q12",
    """SELECT l_linestatus, sum(CASE WHEN o_orderpriority = '1-URGENT' OR o_orderpriority = '2-HIGH' THEN 1 ELSE 0 END) AS high_line_count,
              sum(CASE WHEN o_orderpriority <> '1-URGENT' AND o_orderpriority <> '2-HIGH' THEN 1 ELSE 0 END) AS low_line_count
       FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_shipdate >= TIMESTAMP_NTZ '1998-01-01 00:00:00' AND l_shipdate < TIMESTAMP_NTZ '1999-01-01 00:00:00' GROUP BY l_linestatus""",
)
R.sql(
    "q13",
    """SELECT c_count, count(*) AS custdist FROM (SELECT c_custkey, count(o_orderkey) AS c_count FROM customer LEFT OUTER JOIN orders ON c_custkey = o_custkey AND o_orderpriority <> '5-LOW' GROUP BY c_custkey) AS c_orders
       GROUP BY c_count""",
)
R.sql(
    "q14",
    """SELECT round(100.0 * sum(CASE WHEN p_type LIKE 'PROMO%' THEN l_extendedprice * (1 - l_discount) ELSE 0 END) / sum(l_extendedprice * (1 - l_discount)), 6) AS promo_revenue
       FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_shipdate >= TIMESTAMP_NTZ '1997-09-01 00:00:00' AND l_shipdate < TIMESTAMP_NTZ '1997-12-01 00:00:00'""",
)
R.sql(
    "q15",
    """WITH revenue AS (SELECT l_suppkey AS supplier_no, round(sum(l_extendedprice * (1 - l_discount)), 4) AS total_revenue FROM lineitem
                       WHERE l_shipdate >= TIMESTAMP_NTZ '1998-01-01 00:00:00' AND l_shipdate < TIMESTAMP_NTZ '1998-04-01 00:00:00' GROUP BY l_suppkey)
       SELECT s_suppkey, s_name, total_revenue FROM supplier JOIN revenue ON s_suppkey = supplier_no WHERE total_revenue = (SELECT max(total_revenue) FROM revenue)""",
)
R.sql(
    "q16",
    """SELECT p_brand, p_type, p_size, count(DISTINCT l_suppkey) AS supplier_cnt FROM lineitem JOIN part ON p_partkey = l_partkey
       WHERE p_brand <> 'Brand#5' AND p_type NOT LIKE 'MEDIUM%' AND p_size IN (3, 9, 14, 19, 23, 36, 45, 49) AND l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0)
       GROUP BY p_brand, p_type, p_size""",
)
R.sql(
    "q17",
    """SELECT round(sum(l_extendedprice) / 7.0, 4) AS avg_yearly FROM lineitem JOIN part ON p_partkey = l_partkey
       WHERE p_brand = 'Brand#23' AND l_quantity < (SELECT 0.5 * avg(i.l_quantity) FROM lineitem i WHERE i.l_partkey = p_partkey)""",
)
R.sql(
    "q18",
    """SELECT c_name, c_custkey, o_orderkey, o_orderdate, o_totalprice, round(sum(l_quantity), 2) AS qty FROM customer, orders, lineitem
       WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING sum(l_quantity) > 230) AND c_custkey = o_custkey AND o_orderkey = l_orderkey
       GROUP BY c_name, c_custkey, o_orderkey, o_orderdate, o_totalprice ORDER BY o_totalprice DESC, o_orderdate, o_orderkey LIMIT 100""",
)
R.sql(
    "q19",
    """SELECT round(sum(l_extendedprice * (1 - l_discount)), 4) AS revenue FROM lineitem, part WHERE p_partkey = l_partkey AND (
         (p_brand = 'Brand#12' AND p_type IN ('SMALL', 'PROMO') AND l_quantity BETWEEN 1 AND 21 AND p_size BETWEEN 1 AND 25)
         OR (p_brand = 'Brand#23' AND p_type IN ('MEDIUM', 'LARGE') AND l_quantity BETWEEN 10 AND 40 AND p_size BETWEEN 1 AND 40)
         OR (p_brand = 'Brand#15' AND p_type = 'ECONOMY' AND l_quantity BETWEEN 20 AND 50))""",
)
