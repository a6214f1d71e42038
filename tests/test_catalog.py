"""Every registered query against its SQL at the small scale."""

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from parley.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_equals_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    result = duck.execute(catalog.ORACLES[name])
    columns = [d[0] for d in result.description]
    assert sorted(columns) == sorted(df.columns)
    want = sorted(([plain(v) for v in row] for row in result.fetchall()), key=repr)
    got = sorted(([plain(row[c]) for c in columns] for row in df.collect()), key=repr)
    assert got == want


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_runs(spark, name):
    df = catalog.QUERIES[name](spark, SF)
    assert df.columns and df.count() >= 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_top_k_plans_do_not_sort_everything(spark):
    plan = catalog.QUERIES["knn_cosine"](spark, SF)._jdf.queryExecution().toString()
    assert "TakeOrderedAndProject" in plan
    exact = catalog.QUERIES["exact_arm"](spark, SF)._jdf.queryExecution().toString()
    assert "ReadSchema: struct<doc_id:bigint" in exact and "CartesianProduct" not in exact
