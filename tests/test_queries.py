"""Every graph query with an SQL twin gives its rows."""

import os

import duckdb
import pytest

from weftgraph.format_queries import SQL as FORMATS
from weftgraph.oracles import SQL as GRAPHS
from weftgraph.queries import QUERIES

SQL = {**GRAPHS, **FORMATS}


def plain(v):
    if isinstance(v, float):
        return round(v, 8) + 0.0
    return v


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr([plain(r[i]) for i in order]) for r in data)


@pytest.fixture(scope="module")
def duck(tables):
    c = duckdb.connect()
    for f in os.listdir(tables):
        c.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{tables}/{f}')")
    return c


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, tables, duck, name):
    got = QUERIES[name](spark, tables)
    want = duck.sql(SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(want.columns, want.fetchall())


@pytest.mark.parametrize("name", ["partition_edge", "sample_gd", "deadlock_detection"])
def test_same_on_other_partitions(spark, tables, name):
    first = sorted(map(tuple, QUERIES[name](spark, tables).collect()))
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    try:
        assert sorted(map(tuple, QUERIES[name](spark, tables).collect())) == first
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
