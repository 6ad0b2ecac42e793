from __future__ import annotations

import duckdb
import pytest

import __spark_entry__ as driver
from hostweave.llm.oracles import ORACLES
from hostweave.llm.queries import QUERIES


def test_all_are_registered():
    assert set(QUERIES) | {"pipeline"} <= set(driver.queries())
    assert {int(name[2:].split("_")[0]) for name in QUERIES} == set(range(1, 14))
    assert set(ORACLES) <= set(driver.oracle_sql())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for table in ("documents", "conversations"):
        con.execute(f"create view {table} as select * from '{sf_dir}/{table}.parquet'").fetchall()
    result = con.execute(ORACLES[name])
    names = [d[0] for d in result.description]
    want = sorted(map(str, result.fetchall()))
    got = sorted(str(tuple(r)) for r in QUERIES[name](spark, sf_dir).select(*names).collect())
    assert got == want
