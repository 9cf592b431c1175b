"""Every registered query against DuckDB on the same tables."""

import glob
import os

import duckdb
import pytest

from veinworks import catalogue


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def normal(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    cell = lambda v: "nan" if isinstance(v, float) and v != v else repr(v + 0.0) if isinstance(v, float) else repr(v)
    return sorted(tuple(cell(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_equals_sql(spark, duck, sf_dir, name):
    df = catalogue.QUERIES[name](spark, sf_dir)
    got = df.collect()
    found = duck.execute(catalogue.SQL[name])
    columns = [c[0] for c in found.description]
    assert sorted(columns) == sorted(df.columns)
    assert normal(map(tuple, got), df.columns) == normal(found.fetchall(), columns)
    assert got


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.SQL)))
def test_runs(spark, sf_dir, name):
    assert catalogue.QUERIES[name](spark, sf_dir).count() > 0
