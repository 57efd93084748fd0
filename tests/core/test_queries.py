"""Every registered query against its SQL on an independent engine."""

import duckdb
import pytest

from tests.conftest import MID
from tidemark.plans import CATALOGUE

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{MID}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(CATALOGUE))
def test_matches_sql(spark, duck, name):
    f, sql = CATALOGUE[name]
    df = f(spark, MID)
    columns = sorted(df.columns)
    mine = sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)
    assert mine
    if sql is None:
        return
    got = duck.execute(sql)
    names = [c[0] for c in got.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    want = sorted((tuple(r[i] for i in at) for r in got.fetchall()), key=repr)
    assert mine == want


def test_scans_push_filters_and_prune_columns(spark):
    plan = CATALOGUE["kv_get"][0](spark, MID)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(c_name" in plan and "ReadSchema: struct<c_custkey:bigint,c_name:string,c_acctbal:double>" in plan
    plan = CATALOGUE["table_latest"][0](spark, MID)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Window" not in plan
