"""Queries that once did less than their whole job."""

from pyspark.sql import functions as F

from weftgraph import fixtures
from weftgraph.graph import vertices
from weftgraph.operators import paths
from weftgraph.partition import loop
from weftgraph.queries import QUERIES


def test_triangle_closing_keeps_every_candidate(spark, tmp_path):
    """25 vertices between the same two: each has 24 candidates of two common in-neighbours, the two have each other."""
    walk = [v for k in range(25) for v in (1000, k, 1001, k)]
    spark.createDataFrame([(i, i, v) for i, v in enumerate(walk)], "event_id long, ts long, user_id long").withColumn("ts", F.timestamp_seconds("ts")).write.parquet(str(tmp_path / "events.parquet"))
    got = QUERIES["triangle_closing"](spark, str(tmp_path)).collect()
    want = {(a, b, 2) for a in range(25) for b in range(25) if a != b} | {(1000, 1001, 24), (1001, 1000, 24)}
    assert {(r.id, r.candidate, r.common) for r in got} == want and len(got) == len(want)
    assert sorted(r.rank for r in got if r.id == 0) == list(range(1, 25))


def test_partition_queries_run_under_the_default_limit(spark, tables, monkeypatch):
    """The stop rule ends them, not a smaller number of supersteps."""
    names, seen = sorted(n for n in QUERIES if n.startswith("partition_") and n != "partition_report" and not n.endswith("_cycles")), []

    def partition(edges, *args, limit=None, **kwargs):
        seen.append(limit)
        return loop.Result(edges, edges)

    monkeypatch.setattr(loop, "partition", partition)
    for name in names:
        QUERIES[name](spark, tables)
    assert len(names) == 6 and seen == [None] * 6


def test_sssp_returns_every_vertex(spark, tables):
    got = {r.id: r.distance for r in QUERIES["sssp"](spark, tables).collect()}
    assert got.keys() == {r.id for r in vertices(fixtures.orders_chain(spark, tables)).collect()}
    assert got[1] == 0 and list(got.values()).count(paths.UNREACHED) > len(got) / 2


def test_queries_leave_only_their_result(spark, tables, tmp_path, monkeypatch):
    from weftgraph.plans import bsp

    monkeypatch.setattr(bsp, "shared_dir", lambda spark: str(tmp_path))
    for name in ("partition_edge", "connected_components", "sink_metis"):
        before = set(tmp_path.iterdir())
        assert QUERIES[name](spark, tables).count()
        assert len(set(tmp_path.iterdir()) - before) == 1, name


def test_paths_of_any_length(spark):
    """No number of supersteps ends a search early."""
    chain = spark.range(60).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    assert {r.id: r.distance for r in paths.shortest_paths(chain, 0).collect()} == {i: float(i) for i in range(61)}


def test_a_failing_task_is_run_again(spark):
    """A task that dies takes nothing with it: ranks and components are those of a run without failures."""
    from weftgraph.operators import components, ranks

    def dies(batches):
        from pyspark import TaskContext

        if TaskContext.get().attemptNumber() == 0 and TaskContext.get().partitionId() == 1:
            raise RuntimeError("this task is lost")
        yield from batches

    e = spark.range(400).select(F.col("id").alias("src"), ((F.col("id") * 7) % 90).alias("dst")).repartition(4)
    failing = e.mapInArrow(dies, "src long, dst long")
    for f in (lambda x: ranks.pagerank(x, 5), components.connected_components):
        want, got = ({r[0]: round(float(r[1]), 12) for r in f(x).collect()} for x in (e, failing))
        assert got == want and len(got) == 400
