"""The SQL of this subpackage's queries against the queries, on whole tables."""

import duckdb
import pytest

pytest.importorskip("tidemark.llm")
from tests.conftest import MID  # noqa: E402
from tidemark.llm import queries as Q  # noqa: E402


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_matches_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{MID}/documents.parquet'")
    got = con.execute(Q.oracle_sql()[name])
    columns = [c[0] for c in got.description]
    df = Q.queries()[name](spark, MID)
    assert sorted(columns) == sorted(df.columns)
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(got.fetchall(), key=key) == sorted(map(tuple, df.select(*columns).collect()), key=key)
