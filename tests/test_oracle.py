"""Every query with SQL gives what DuckDB gives on the same tables."""

import glob
import os
from collections import Counter

import duckdb
import pytest

from docketloom.plans import catalogue


def norm(v):
    if isinstance(v, float):
        return None if v != v else round(v, 6) + 0.0
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, list | tuple):
        return tuple(map(norm, v))
    return str(v) if hasattr(v, "isoformat") else v


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for path in glob.glob(f"{data}/*.parquet"):
        con.sql(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_equals_sql(spark, duck, data, name):
    df = catalogue.queries()[name](spark, data)
    columns = sorted(df.columns)
    mine = Counter(repr(tuple(norm(r[c]) for c in columns)) for r in df.collect())
    found = duck.sql(catalogue.oracle_sql()[name])
    assert sorted(found.columns) == columns
    at = [found.columns.index(c) for c in columns]
    assert mine == Counter(repr(tuple(norm(r[i]) for i in at)) for r in found.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(catalogue.oracle_sql())))
def test_other_queries_run(spark, data, name):
    assert catalogue.queries()[name](spark, data).count() >= 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
