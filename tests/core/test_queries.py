"""Every registered query with SQL gives what DuckDB gives, on the smallest tables."""

import glob
import math

import duckdb
import pytest

from netloom.plans.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {f.split('/')[-1][:-8]} AS SELECT * FROM read_parquet('{f}')")
    return c


def rows(names, data):
    cell = lambda x: ("",) if x is None else (round(x, 6) if isinstance(x, float) and not math.isnan(x) else x,)
    return sorted((tuple(cell(r[n]) for n in names) for r in data), key=str)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_agrees_with_sql(spark, db, name):
    got = QUERIES[name](spark, SF)
    want = db.execute(SQL[name]).to_arrow_table().to_pylist()
    names = sorted(got.columns)
    assert names == sorted(want[0] if want else names)
    assert rows(names, [r.asDict() for r in got.collect()]) == rows(names, want)
