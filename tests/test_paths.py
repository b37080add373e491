"""Shortest paths over long chains and graphs of any shape."""

import random

import duckdb
from pyspark.sql import functions as F

from weftgraph.operators import paths
from weftgraph.oracles import SQL
from weftgraph.queries import QUERIES


def _few_tables(monkeypatch, most):
    """Fail where a search writes more tables than most."""
    written, cut = [], paths.cut

    def counted(df, tag):
        written.append(tag)
        assert len(written) <= most, written
        return cut(df, tag)

    monkeypatch.setattr(paths, "cut", counted)


def test_sssp_follows_long_chains_as_its_sql(spark, tmp_path, monkeypatch):
    """One customer with 700 orders, some on the same day: before, each order took a superstep that wrote all vertices."""
    rows = spark.range(1000).select(F.when(F.col("id") == 300, 1).when(F.col("id") == 1, 300).otherwise(F.col("id")).alias("o_orderkey"), F.when(F.col("id") < 700, 0).otherwise(F.col("id") % 20).alias("o_custkey"))
    rows.withColumn("o_orderdate", F.timestamp_seconds(F.when(F.col("o_custkey") == 0, 0).otherwise(F.col("o_orderkey") % 7) * 86400)).write.parquet(str(tmp_path / "orders.parquet"))
    want = duckdb.sql(SQL["sssp"].replace("FROM orders", f"FROM '{tmp_path}/orders.parquet/*.parquet'")).fetchall()
    _few_tables(monkeypatch, 20)
    got = [tuple(r) for r in QUERIES["sssp"](spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(want) and sum(x < paths.UNREACHED for _, x in got) > 600


def test_shortest_paths_of_any_shape(spark):
    """Chains, trees, cycles with and without the source, loops, parallel and missing edges, against relaxation in Python."""
    rnd = random.Random(5)
    chain = [(i, i + 1, 1.0 + i % 3) for i in range(40)]
    parts = [
        chain + [(40, 41, 1.0), (41, 40, 2.0)],  # into a cycle
        chain + [(100, 101, 1.0), (101, 102, 1.0), (102, 100, 1.0)] + [(102 + i, 103 + i, 1.0) for i in range(20)] + [(200, 200, 1.0), (200, 201, 1.0)],  # cycles apart, with tails
        [((i - 1) // 2, i, float(i % 5)) for i in range(1, 60)] + [(i // 3 + 500, i + 501, 1.0) for i in range(40)],  # trees
        chain + [(0, 60, 1.0)] + [(60 + i, 61 + i, 0.5) for i in range(10)] + [(70, 30, 1.0), (70, 5, 1.0), (40, 80, 1.0), (80, 81, 1.0)],  # chains that meet
        [(0, 0, 1.0), (0, 1, 5.0), (0, 1, 3.0), (1, 1, 1.0), (1, 2, 1.0), (2, 3, 1.0), (2, 3, 1.0)],
        [(0, 1, 1.0), (1, 2, None), (2, 3, 1.0), (1, 4, 1.0), (4, 5, 2.0), (5, 2, None), (None, 6, 1.0), (6, 7, 1.0), (1, None, 1.0)],
        *([(rnd.randrange(30), rnd.randrange(30), float(rnd.randrange(1, 9))) for _ in range(n)] for n in (20, 32, 45, 90)),
    ]
    shapes = {
        "side by side": [tuple(v and v + 1000 * k for v in e[:2]) + e[2:] for k, part in enumerate(parts) for e in part],  # all at vertex 0
        "cycle through the source": [(0, 1, 1.0), (1, 2, 2.0), (2, 0, 3.0), (2, 9, 1.0)],
        "source absent": [(i + 1, i + 2, 1.0) for i in range(5)],
    }
    for name, edges in shapes.items():
        want = {v: paths.UNREACHED for a, b, _ in edges for v in (a, b)} | ({0: 0.0} if any(0 in e[:2] for e in edges) else {})
        for _ in want:
            for a, b, w in edges:
                if None not in (a, b, w) and want[a] < paths.UNREACHED:
                    want[b] = min(want[b], want[a] + w)
        got = paths.shortest_paths(spark.createDataFrame(edges, "src long, dst long, value double"), 0, "value").collect()
        assert {r.id: r.distance for r in got} == want and len(got) == len(want), name
