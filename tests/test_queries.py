"""Registered queries against their SQL, all of them but the operators of ``llm``, which have their own tests."""

from __future__ import annotations

import duckdb
import pytest

import __spark_entry__ as E
from tools import check

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in check.TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", [n for n in E.queries() if n not in E.LLM])
def test_query_equals_its_sql(spark, db, name):
    df = E.queries()[name](spark, SF)
    got, names = check.rows_of(df.columns, [tuple(r) for r in df.collect()])
    sql = E.oracle_sql().get(name)
    if sql is None:
        return
    res = db.sql(sql)
    want, wanted = check.rows_of(res.columns, res.fetchall())
    assert names == wanted and got == want


def test_entry(spark):
    rows = E.entry(spark)
    assert rows.columns[:3] == ["position", "value", "unit"] and rows.count() > 0
