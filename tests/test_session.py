"""The session: tables, queries, file systems and options."""

from __future__ import annotations

import datetime

import pandas as pd
import pyarrow as pa
import pytest

from lumenframe import Session
from lumenframe.plans.explain import count_nodes, pushed_filters, read_columns
from lumenframe.plans.options import PLANNING, spark_settings
from lumenframe.sources import SourceError
from lumenframe.sources.databases import jdbc_options
from lumenframe.sources.filesystems import describe
from lumenframe.sources.types import sql_type


@pytest.fixture
def s(spark):
    return Session(spark)


def test_tables_are_listed_described_replaced_and_dropped(s):
    s.create_table("t", pd.DataFrame({"a": [1, 2], "b": ["x", None]}))
    assert s.list_tables() == ["t"] and s.describe_table("t") == {"a": "bigint", "b": "string"}
    s.create_table("t", pa.table({"c": [1.5]}))
    assert s.describe_table("t") == {"c": "double"} and s.sql("SELECT * FROM t").collect()[0].c == 1.5
    s.drop_table("t")
    assert s.list_tables() == [] and s.describe_table("t") == {}
    with pytest.raises(Exception, match="(?i)not.found"):
        s.sql("SELECT * FROM t")


def test_unknown_arguments_and_inputs_are_refused(s):
    with pytest.raises(SourceError, match="delimeter"):
        s.create_table("t", "x.csv", delimeter=",")
    with pytest.raises(SourceError):
        s.create_table("t", 5)
    with pytest.raises(SourceError, match="partitions"):
        s.create_table("t", "x", partitions_schema=[("a", "int32")])
    with pytest.raises(SourceError, match="file format"):
        s.create_table("t", "/nowhere/x.unknown")


def test_pandas_and_arrow_types(s):
    frame = pd.DataFrame({"f": [1.0, None], "t": pd.to_datetime(["2020-02-29 01:02:03.123456789", None]), "c": pd.Categorical(["a", "b"])})
    rows = s.create_table("t", frame).frame.orderBy("c").collect()
    assert rows[1].f is None and rows[1].t is None and rows[0].t == datetime.datetime(2020, 2, 29, 1, 2, 3, 123456)
    small = pa.table({"u8": pa.array([255], pa.uint8()), "u64": pa.array([2**64 - 1], pa.uint64()), "d": pa.array([datetime.date(2020, 1, 1)], pa.date64())})
    row = s.create_table("u", small).frame.collect()[0]
    assert (row.u8, int(row.u64), row.d) == (255, 2**64 - 1, datetime.date(2020, 1, 1))


def test_csv_arguments(s, tmp_path):
    (tmp_path / "a.csv").write_text("k;v;b\n1;x;yes\n2;NA;no\n")
    rows = s.create_table("t", str(tmp_path / "a.csv"), delimiter=";", header=0, names=["k", "v", "b"], dtype=["int32", "str", "bool"], true_values=["yes"], false_values=["no"], na_values=["NA"]).frame.orderBy("k").collect()
    assert [tuple(r) for r in rows] == [(1, "x", True), (2, None, False)]
    (tmp_path / "b.psv").write_text("1|2020-01-02|0.5\n2|2020-01-03|1.5\n")
    assert s.create_table("u", str(tmp_path / "b.psv"), names=["a", "d", "x"]).frame.dtypes == [("a", "int"), ("d", "date"), ("x", "double")]
    (tmp_path / "e.csv").write_text("k,v\n")
    assert s.create_table("e", str(tmp_path / "e.csv")).frame.count() == 0


def test_json_lines_and_documents(s, tmp_path):
    (tmp_path / "a.json").write_text('{"a": 1, "b": "x"}\n{"a": 2, "b": null}\n')
    assert s.create_table("t", str(tmp_path / "a.json")).frame.count() == 2
    (tmp_path / "m.json").write_text('[\n{"a": 1},\n{"a": 2}\n]')
    assert s.create_table("u", str(tmp_path / "m.json"), lines=False).frame.count() == 2


def test_decimals_are_doubles_unless_exact(s, spark, tmp_path):
    spark.sql("SELECT CAST(1.25 AS DECIMAL(10, 2)) AS d").write.parquet(str(tmp_path / "d"))
    assert s.create_table("t", str(tmp_path / "d")).frame.dtypes == [("d", "double")]
    assert s.create_table("u", str(tmp_path / "d"), exact_decimals=True).frame.dtypes == [("d", "decimal(10,2)")]


def test_partitions(s, spark, tmp_path):
    spark.range(6).selectExpr("id", "id % 3 AS p").write.partitionBy("p").parquet(str(tmp_path / "p"))
    t = s.create_table("t", str(tmp_path / "p"), file_format="parquet", partitions={"p": [0, 2, 7]}, partitions_schema=[("p", "int64")])
    assert t.frame.dtypes[-1] == ("p", "bigint") and sorted(r.id for r in t.frame.collect()) == [0, 2, 3, 5]
    with pytest.raises(SourceError):
        s.create_table("u", str(tmp_path / "p"), file_format="parquet", partitions={"p": [99]})


def test_scans_are_pruned_and_filters_pushed(s, spark, tmp_path):
    spark.range(100).selectExpr("id", "id * 2 AS b", "CAST(id AS STRING) AS c").write.parquet(str(tmp_path / "w"))
    s.create_table("w", str(tmp_path / "w"))
    df = s.sql("SELECT b FROM w WHERE id > 90")
    assert "GreaterThan(id,90)" in pushed_filters(df)[0] and read_columns(df) == ["id:bigint,b:bigint"]
    assert count_nodes(s.sql("SELECT id FROM w ORDER BY b DESC LIMIT 3"), "TakeOrderedAndProject") == 1


def test_background_queries(s):
    s.create_table("t", pa.table({"a": [1, 2, 3]}))
    token = s.sql("SELECT sum(a) AS s FROM t", return_token=True)
    assert s.fetch(token).collect()[0].s == 6 and s.status(token)
    bad = s.sql("SELECT raise_error('no') AS s", return_token=True)
    with pytest.raises(Exception, match="no"):
        s.fetch(bad)
    with pytest.raises(KeyError):
        s.status(999)
    assert {r.status for r in s.log("SELECT status FROM query_log").collect()} == {"done", "failed"}


def test_explain_and_options(s):
    s.create_table("t", s.spark.range(10).selectExpr("id AS a"))
    assert "Filter" in s.explain("SELECT a FROM t WHERE a > 1") and "Physical Plan" in s.explain("SELECT a FROM t", detail=True)
    before = s.spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    s.sql("SELECT a FROM t", config_options={"MAX_JOIN_SCATTER_MEM_OVERHEAD": 5})
    assert s.spark.conf.get("spark.sql.autoBroadcastJoinThreshold") == before
    assert spark_settings({"EXECUTOR_THREADS": 4, "JOIN_PARTITION_SIZE_THRESHOLD": 7}) == {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "7"}


def test_the_callers_settings_stay(spark, monkeypatch):
    before = {k: spark.conf.get(k) for k in PLANNING}
    monkeypatch.setenv("LUMENFRAME_JOIN_PARTITION_SIZE_THRESHOLD", "9")
    own = Session(spark)
    own.create_table("settings_t", pa.table({"a": [1]}))
    assert own.sql("SELECT a / 0 AS x, CAST('no' AS INT) AS y, a % 0 AS z FROM settings_t").collect()[0].asDict() == {"x": None, "y": None, "z": None}
    assert {k: spark.conf.get(k) for k in PLANNING} == before and own._settings["spark.sql.adaptive.advisoryPartitionSizeInBytes"] == "9"


def test_results_are_fetched_from_the_shared_folder(s):
    token = s.sql("SELECT 1 AS a, 2 AS a, NULL AS n, INTERVAL '1' DAY AS i", return_token=True)
    got = s.fetch(token)
    assert got.columns == ["a", "a", "n", "i"] and tuple(got.collect()[0])[:3] == (1, 2, None)
    s.release(token)
    with pytest.raises(KeyError):
        s.fetch(token)


@pytest.mark.parametrize(
    ("query", "want"),
    [
        ("SELECT to_date('03/02/2001', '%d/%m/%Y') AS v", datetime.date(2001, 2, 3)),
        ("SELECT TO_DATE ( 'no' , '%Y-%m-%d' ) AS v", None),
        ("SELECT to_date('2001-02-03', 'yyyy-MM-dd') AS v", datetime.date(2001, 2, 3)),
        ("SELECT TO_TIMESTAMP('2001-02-03 04:05:06', '%Y-%m-%d %H:%M:%S') AS v", datetime.datetime(2001, 2, 3, 4, 5, 6)),
        (r"SELECT regexp_replace('ab12', '([a-z]+)(\d+)', '\2-\1') AS v", "12-ab"),
        (r"SELECT regexp_replace('aXaX', 'X', '$', 3) AS v", "aXa$"),
        (r"SELECT '%Y \\ to_date(x, ''%Y'')' AS v -- regexp_replace('a', '\w', '\1')", r"%Y \ to_date(x, '%Y')"),
        ("SELECT concat(to_date('2001', '%Y'), regexp_replace(concat('a', 'b'), 'b', 'c''d')) AS v", "2001-01-01ac'd"),
    ],
)
def test_sql_dialect(s, query, want):
    assert s.sql(query).collect()[0].v == want


def test_database_reads(s, spark, tmp_path, monkeypatch):
    import lumenframe.sources.databases as databases

    url = f"jdbc:derby:memory:lumen{tmp_path.name};create=true"
    rows = spark.range(40).selectExpr("CAST(id AS INT) AS ID", "CAST(id * 2 AS DOUBLE) AS V")
    rows.write.format("jdbc").options(url=url, dbtable="nums", driver="org.apache.derby.iapi.jdbc.AutoloadedDriver").save()
    whole = databases.jdbc_options

    def derby(engine, table, args):
        return {k: v for k, v in whole(engine, table, args).items()} | {"url": url, "driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}

    monkeypatch.setattr(databases, "jdbc_options", derby)
    s.create_table("nums", "nums", from_sql="sqlite", database="x", table_filter="ID >= 10")
    got = s.sql("SELECT count(*) AS n, min(id) AS low FROM nums WHERE v > 30")
    assert tuple(got.collect()[0]) == (24, 16)
    plain = s.sql("SELECT id FROM nums WHERE v > 30.0")
    assert "GreaterThan(V,30.0)" in pushed_filters(plain)[0] and sorted(r[0] for r in plain.collect()) == list(range(16, 40))
    split = s.create_table("parts", "nums", from_sql="sqlite", database="x", partition_column="ID", lower_bound=0, upper_bound=40, num_partitions=4)
    assert split.frame.rdd.getNumPartitions() == 4 and split.frame.count() == 40


def test_catalog_tables(s, spark):
    spark.sql("DROP TABLE IF EXISTS held")
    spark.range(6).selectExpr("id", "id % 2 AS p").write.partitionBy("p").saveAsTable("held")
    s.create_table("h", "hive", hive_table_name="held")
    assert s.sql("SELECT sum(id) AS t FROM h WHERE p = 1").collect()[0].t == 9 and s.describe_table("h") == {"id": "bigint", "p": "bigint"}
    with pytest.raises(SourceError):
        s.create_table("h", "hive", hive_table_name="nothing_here")
    spark.sql("DROP TABLE held")


def test_text_files_and_their_options(s, tmp_path):
    (tmp_path / "a.csv").write_text('a,b\n1,"x ""y"" z"\n')
    assert s.create_table("a", str(tmp_path / "a.csv")).frame.collect()[0].b == 'x "y" z'
    (tmp_path / "q.csv").write_text('a,b\n1,"x\n')
    assert s.create_table("q", str(tmp_path / "q.csv"), quoting=3).frame.collect()[0].b == '"x'
    (tmp_path / "l.csv").write_text("a;1|a;2")
    assert [r.n for r in s.create_table("l", str(tmp_path / "l.csv"), delimiter=";", lineterminator="|", names=["k", "n"], dtype=["str", "int64"]).frame.collect()] == [1, 2]
    with pytest.warns(UserWarning, match="byte_range_size"):
        s.create_table("a", str(tmp_path / "a.csv"), byte_range_size=10)
    (tmp_path / "w").mkdir()
    (tmp_path / "w" / "0.csv").write_text("n\n1\n")
    (tmp_path / "w" / "1.csv").write_text("n\nword\n")
    with pytest.raises(Exception, match="MALFORMED|FAILFAST|FAILED_READ"):
        s.create_table("w", str(tmp_path / "w"), file_format="csv").frame.collect()


def test_memory_calls(s):
    assert all(v > 0 for v in s.get_free_memory().values()) and all(v >= 0 for v in s.get_max_memory_used().values())
    s.reset_max_memory_used()


def test_file_systems(s, tmp_path):
    (tmp_path / "x.csv").write_text("a\n1\n")
    assert s.localfs("data", root=str(tmp_path))
    assert s.create_table("t", "file://data/x.csv").frame.collect()[0].a == 1
    fs = describe("s3", "b", {"bucket_name": "bucket", "access_key_id": "id", "secret_key": "key", "region": "r", "root": "/in"})
    assert fs.base == "s3a://bucket/in" and fs.conf["fs.s3a.bucket.bucket.access.key"] == "id" and fs.conf["fs.s3a.bucket.bucket.endpoint.region"] == "r"
    assert describe("hdfs", "h", {"host": "n", "port": 9000}).base == "hdfs://n:9000"
    assert describe("gs", "g", {"bucket_name": "c", "project_id": "p"}).conf["fs.gs.project.id"] == "p"
    assert s.show_filesystems() == [("data", "local", f"file://{tmp_path}")]
    for kind, prefix, args in (("s3", "a/b", {"bucket_name": "x"}), ("s3", "a", {}), ("hdfs", "a", {"bucket": 1}), ("ftp", "a", {})):
        with pytest.raises(SourceError):
            describe(kind, prefix, args)


def test_database_options():
    args = {"hostname": "h", "username": "u", "password": "p", "database": "d", "table_filter": "a > 1"}
    o = jdbc_options("mysql", "t", args)
    assert o["url"] == "jdbc:mysql://h:3306/d" and o["dbtable"] == "(SELECT * FROM t WHERE a > 1) AS filtered" and o["fetchsize"] == "100000"
    assert jdbc_options("postgresql", "t", args | {"port": 1, "table_filter": None})["url"] == "jdbc:postgresql://h:1/d"
    assert jdbc_options("sqlite", "t", {"database": "f.db"})["url"] == "jdbc:sqlite:f.db"
    for engine, bad in (("oracle", args), ("mysql", {}), ("sqlite", {})):
        with pytest.raises(SourceError):
            jdbc_options(engine, "t", bad)


def test_type_names():
    assert [sql_type(x) for x in ("int8", "UINT32", "datetime64[ns]", "float64", "str", "decimal(4,1)")] == ["tinyint", "bigint", "timestamp_ntz", "double", "string", "decimal(4,1)"]
