"""Every registered query against its SQL in DuckDB, on the smallest tables."""

from __future__ import annotations

import decimal
from pathlib import Path

import duckdb
import pytest

from lumenframe.queries import ORACLES, QUERIES
from lumenframe.queries.registry import TABLES

FOLDER = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not FOLDER.exists(), reason="no test tables")


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    return repr(round(v, 6) + 0.0) if isinstance(v, float) else repr(v)


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, oracle, name):
    got = QUERIES[name](spark, str(FOLDER))
    cur = oracle.execute(ORACLES[name])
    names, want = [c[0] for c in cur.description], cur.fetchall()
    assert sorted(got.columns) == sorted(names)
    order = [names.index(c) for c in got.columns]
    assert sorted(tuple(map(plain, r)) for r in got.collect()) == sorted(tuple(plain(r[i]) for i in order) for r in want)


@pytest.mark.skipif(not FOLDER.with_name("sf0.01").exists(), reason="no larger test tables")
def test_joins_take_whole_tables(spark):
    larger = FOLDER.with_name("sf0.01")
    keys = lambda df, c: {r[0] for r in df.select(c).where(f"{c} IS NOT NULL").distinct().collect()}
    whole = {c: keys(spark.read.parquet(f"{larger}/{t}.parquet"), c) for t, c in (("customer", "c_custkey"), ("supplier", "s_suppkey"))}
    for name, c, want in (
        ("join_left", "k", "c_custkey"), ("join_right", "s", "s_suppkey"), ("join_full", "k", "c_custkey"), ("join_full", "s", "s_suppkey"),
        ("join_null_safe", "k", "c_custkey"), ("join_op_null_safe", "k", "c_custkey"), ("join_op_null_safe", "s", "s_suppkey"),
    ):
        assert keys(QUERIES[name](spark, str(larger)), c) == whole[want], (name, c)
    part = [(r.p_partkey, r.p_retailprice, r.p_size) for r in spark.read.parquet(f"{larger}/part.parquet").collect()]
    low, high = [p for p in part if p[2] < 10], [p for p in part if p[2] > 40]
    assert QUERIES["join_non_equi"](spark, str(larger)).count() == sum(a[1] < b[1] and a[2] > b[2] + 40 for a in high for b in low)
    for name in ("join_mixed_null_safe", "join_inner_multi_key", "not_in_subquery_null"):
        assert not any(x in ORACLES[name] for x in ("c_custkey <", "s_suppkey <", "l_orderkey <", "o_orderkey <")), name


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)
