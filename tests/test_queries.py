"""Each query against its SQL, at the smallest scale."""

import math
import os
from datetime import datetime

import duckdb
import pytest

import __spark_entry__
from bnspark.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{SF}/{f}'")
    return con


def rows(values):
    def plain(v):
        if isinstance(v, float):
            return None if math.isnan(v) else round(v, 6) + 0.0
        return str(v) if isinstance(v, datetime) else v

    return sorted((tuple(plain(v) for v in r) for r in values), key=str)


@pytest.mark.parametrize("name", list(registry.QUERIES))
def test_query(spark, db, name):
    df = registry.QUERIES[name](spark, SF)
    got = rows(tuple(r) for r in df.collect())
    assert len(set(df.columns)) == len(df.columns)
    if name in registry.ORACLES:
        columns = ", ".join(f'"{c}"' for c in df.columns)
        assert got == rows(db.execute(f"SELECT {columns} FROM ({registry.ORACLES[name]})").fetchall())
    else:
        assert got


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 6
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_plans_reach_the_scan_and_reduce_before_shuffles(spark):
    """Only the columns in use are read, and counts are partial before the exchange."""
    enc = registry.raw(spark, SF, ["l_linestatus", "l_returnflag"])
    plan = enc.codes.groupBy("v0", "v1").count()._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<l_returnflag:string,l_linestatus:string>" in plan or "ReadSchema: struct<l_linestatus:string,l_returnflag:string>" in plan
    assert "partial_count" in plan and plan.count("Exchange") == 1 and "Python" not in plan
