"""Every registered query against its SQL on the sample tables."""

from __future__ import annotations

import os

import duckdb
import pytest

import __spark_entry__ as driver
from hostweave.testkit.catalog import QUERIES
from hostweave.testkit.oracles import ORACLES as SQL

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def norm(value):
    if value is None:
        return "\0null"
    return f"{value:.9g}" if isinstance(value, float) else str(value)


def run_sql(sql: str, sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'").fetchall()
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    return names, result.fetchall()


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)
    assert set(QUERIES) <= set(driver.queries()) and set(SQL) <= set(driver.oracle_sql())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    got = sorted(tuple(map(norm, r)) for r in df.select(*columns).collect())
    names, rows = run_sql(SQL[name], sf_dir)
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert got == sorted(tuple(norm(r[i]) for i in at) for r in rows)
    assert got, "a query that returns nothing checks nothing"


def test_entry_runs(spark):
    assert os.path.isdir("/root/testdata/sf0.001")
    assert driver.entry(spark).count() > 0
