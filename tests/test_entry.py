"""Every query with SQL gives the rows of DuckDB on the smallest tables."""

import glob
import math
import os
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry_module
from textloom.queries import SQL

DATA = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="the test tables are not here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


def plain(v):
    return "nan" if isinstance(v, float) and math.isnan(v) else round(v, 5) if isinstance(v, float) else v


@needs_data
@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, duck, name):
    df = entry_module.queries()[name](spark, DATA)
    cols = sorted(df.columns)
    got = Counter(tuple(plain(r[c]) for c in cols) for r in df.collect())
    result = duck.execute(SQL[name])
    at = [[d[0] for d in result.description].index(c) for c in cols]
    assert got == Counter(tuple(plain(r[k]) for k in at) for r in result.fetchall())


@needs_data
def test_entry_gives_rows(spark):
    rows = entry_module.entry(spark).collect()
    assert rows and {"query_id", "rank", "final_score"} <= set(rows[0].asDict())


def test_filters_and_columns_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "manifest.parquet")
    spark.createDataFrame([("c", "r", "p", "m", 1, 0)], "collection string, root string, path string, md5 string, generation int, other int").write.parquet(path)
    plan = entry_module.queries()["manifest_diff"](spark, str(tmp_path))._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(generation), EqualTo(generation,1)" in plan and "other" not in plan.split("ReadSchema")[-1].split("\n")[0]
