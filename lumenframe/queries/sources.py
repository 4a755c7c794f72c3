"""Sources: tables written in each format to the shared folder and registered from there."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.queries.registry import Registry, Tables

R = Registry()
CUSTOMER = "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer"
NAMES = ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]
TYPES = ["int64", "str", "int32", "float64", "str"]


def shared(t: Tables, tag: str) -> str:
    """A fresh path that driver and executors share: the checkpoint folder, or the warehouse where it is unset."""
    spark = t.session.spark
    conf = spark.sparkContext.getConf()
    base = conf.get("spark.checkpoint.dir") or spark.conf.get("spark.sql.warehouse.dir")
    return f"{base.rstrip('/')}/sources/{tag}-{uuid.uuid4().hex}"


@R.frame("src_parquet", CUSTOMER)
def _parquet(t: Tables) -> DataFrame:
    return t.session.create_table("customer", f"{t.folder}/customer.parquet").frame.select(*NAMES)


@R.frame("src_orc", CUSTOMER)
def _orc(t: Tables) -> DataFrame:
    path = shared(t, "orc")
    t.customer.write.orc(path)
    return t.session.create_table("customer_orc", path, file_format="orc").frame


@R.frame("src_csv", CUSTOMER)
def _csv(t: Tables) -> DataFrame:
    path = shared(t, "csv")
    t.customer.write.csv(path, header=True)
    return t.session.create_table("customer_csv", path, file_format="csv", names=NAMES, dtype=TYPES, header=0).frame


@R.frame("src_csv_inferred", "SELECT c_custkey, c_name, c_acctbal FROM customer")
def _csv_inferred(t: Tables) -> DataFrame:
    path = shared(t, "csv")
    t.customer.write.csv(path, header=True)
    t.session.create_table("customer_csv_inferred", path, file_format="csv")
    return t.session.sql("SELECT CAST(c_custkey AS BIGINT) AS c_custkey, c_name, c_acctbal FROM customer_csv_inferred")


@R.frame("src_psv", CUSTOMER)
def _psv(t: Tables) -> DataFrame:
    path = shared(t, "psv")
    t.customer.write.csv(path, sep="|")
    return t.session.create_table("customer_psv", path, file_format="psv", names=NAMES, dtype=TYPES).frame


@R.frame("src_json", CUSTOMER)
def _json(t: Tables) -> DataFrame:
    path = shared(t, "json")
    t.customer.write.json(path)
    return t.session.create_table("customer_json", path, file_format="json", dtype=dict(zip(NAMES, TYPES, strict=True))).frame


@R.frame("src_pandas", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
def _pandas(t: Tables) -> DataFrame:
    return t.session.create_table("nation_pandas", t.nation.toPandas()).frame  # 25 rows


@R.frame("src_arrow", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
def _arrow(t: Tables) -> DataFrame:
    return t.session.create_table("nation_arrow", t.nation.toArrow()).frame  # 25 rows


@R.frame("src_frame", "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY o_orderstatus")
def _frame(t: Tables) -> DataFrame:
    t.session.create_table("orders_by_status", t.orders.groupBy("o_orderstatus").agg(F.count("*").alias("n")))
    return t.session.sql("SELECT o_orderstatus, n FROM orders_by_status")


def _partitioned(t: Tables) -> str:
    path = shared(t, "parts")
    t.orders.select("o_orderkey", "o_totalprice", "o_orderstatus").repartition("o_orderstatus").write.partitionBy("o_orderstatus").parquet(path)
    return path


@R.frame("src_partitioned", "SELECT o_orderkey, o_totalprice, o_orderstatus FROM orders WHERE o_orderstatus = 'P'")
def _found_partitions(t: Tables) -> DataFrame:
    t.session.create_table("orders_parts", _partitioned(t))
    return t.session.sql("SELECT o_orderkey, o_totalprice, o_orderstatus FROM orders_parts WHERE o_orderstatus = 'P'")


@R.frame("src_user_partitions", "SELECT o_orderkey, o_totalprice, o_orderstatus FROM orders WHERE o_orderstatus IN ('F', 'O')")
def _user_partitions(t: Tables) -> DataFrame:
    t.session.create_table("orders_some", _partitioned(t), file_format="parquet", partitions={"o_orderstatus": ["F", "O", "X"]}, partitions_schema=[("o_orderstatus", "str")])
    return t.session.sql("SELECT o_orderkey, o_totalprice, o_orderstatus FROM orders_some")


@R.frame("src_wildcard", "SELECT count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders WHERE o_orderstatus <> 'P'")
def _wildcard(t: Tables) -> DataFrame:
    t.session.create_table("orders_wild", f"{_partitioned(t)}/o_orderstatus=[FO]/*.parquet")
    return t.session.sql("SELECT count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders_wild")


@R.frame("src_file_list", "SELECT count(*) AS n FROM (SELECT n_name FROM nation UNION ALL SELECT n_name FROM nation) AS t")
def _file_list(t: Tables) -> DataFrame:
    t.session.create_table("nation_twice", [f"{t.folder}/nation.parquet", f"{t.folder}/nation.parquet"])
    return t.session.sql("SELECT count(*) AS n FROM nation_twice")


@R.frame("src_row_range", "SELECT 7 AS n")
def _row_range(t: Tables) -> DataFrame:
    t.session.create_table("nation_rows", f"{t.folder}/nation.parquet", skiprows=10, num_rows=7)
    return t.session.sql("SELECT count(*) AS n FROM nation_rows")


@R.frame("session_log", "SELECT 'done' AS status, CAST(1 AS BIGINT) AS n")
def _log(t: Tables) -> DataFrame:
    t.sql("SELECT count(*) AS n FROM nation")
    return t.session.log("SELECT status, count(*) AS n FROM query_log GROUP BY status")


@R.frame("session_token", "SELECT n_regionkey, count(*) AS n FROM nation GROUP BY n_regionkey")
def _token(t: Tables) -> DataFrame:
    _ = t.nation
    token = t.session.sql("SELECT n_regionkey, count(*) AS n FROM nation GROUP BY n_regionkey", return_token=True)
    return t.session.fetch(token)


@R.frame("src_catalog", CUSTOMER)
def _catalog(t: Tables) -> DataFrame:
    name = f"customer_{uuid.uuid4().hex}"
    t.customer.write.option("path", shared(t, "catalog")).saveAsTable(name)  # an external table: the catalog holds its place and schema
    frame = t.session.create_table("customer_catalog", "hive", hive_table_name=name).frame.select(*NAMES)
    t.session.spark.sql(f"DROP TABLE {name}")
    return frame
