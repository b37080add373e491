"""Shortest paths and maximum propagation, by frontier; shortest paths leap over chains."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..graph import both_ways, degrees, vertices
from ..plans.bsp import cut, discard

UNREACHED = 1.7976931348623157e308


def _only_ways(into: DataFrame, source: int) -> DataFrame:
    """id, to, off, where one edge alone enters id: the nearest vertex behind it that is source or that more edges enter, and how far.

    into has the number n of edges into id and, where it is one, the edge's start and weight. What leads back to a
    vertex that nothing enters, or round a cycle, is out of reach and left out. Each round doubles what a pointer
    spans, so a chain of n vertices takes log2(n) rounds."""
    behind = into.select(F.col("id").alias("to"), ((F.col("n") > 1) | (F.col("id") == source)).alias("done"))
    first = into.filter(F.col("n") == 1).filter(F.col("id") != source).select("id", "to", "off").join(behind, "to", "left")
    way = cut(first.select("id", "to", "off", F.coalesce("done", F.col("to") == source).alias("done"), F.col("done").isNotNull().alias("entered")).filter("done OR entered").drop("entered"), "sp-way")
    left = way.filter("NOT done").count()
    while left:
        on = way.select(F.col("id").alias("to"), F.col("to").alias("next"), F.col("off").alias("more"), F.col("done").alias("last"))
        moved = way.filter("NOT done").join(on, "to").select("id", F.col("next").alias("to"), (F.col("off") + F.col("more")).alias("off"), F.col("last").alias("done"))
        way, old = cut(way.filter("done").union(moved), "sp-way"), way
        discard(old)
        left, before = way.filter("NOT done").count(), left
        if left == before:  # round i ends the ways of 2^(i-1) + 1 to 2^i edges; if there are none, none is longer, and cycles are left
            break
    return way.filter("done").select("id", "to", "off")


def shortest_paths(edges: DataFrame, source: int, weight: str | None = None) -> DataFrame:
    """id, distance from source; UNREACHED where there is no path.

    Vertices that one edge alone enters are as far as the vertex they hang on plus the way from there: long chains take
    no supersteps. Among the others, only those that improved send on. Sums of weights are taken way by way, which
    shows in the last digits of weights that are not whole."""
    e = cut(edges.select("src", "dst", (F.col(weight) if weight else F.lit(1.0)).cast("double").alias("w")), "sp-edges")
    links = e.filter("src IS NOT NULL AND dst IS NOT NULL AND w IS NOT NULL")
    into = cut(links.groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("n"), F.min("src").alias("to"), F.min("w").alias("off")), "sp-into")
    way = _only_ways(into, source)
    joints = into.filter(F.col("n") > 1).filter(F.col("id") != source).select("id")
    start = e.sparkSession.range(1).select(F.lit(source).cast("long").alias("id"), F.lit(0.0).alias("distance"), F.lit(True).alias("active"))
    state = cut(start.union(joints.select("id", F.lit(UNREACHED), F.lit(False))), "sp")
    if not joints.isEmpty():
        ends = links.join(joints.withColumnRenamed("id", "dst"), "dst").join(way.select(F.col("id").alias("src"), "to", "off"), "src", "left")
        between = cut(ends.select(F.coalesce("to", "src").alias("src"), "dst", (F.coalesce("off", F.lit(0.0)) + F.col("w")).alias("w")), "sp-between")
        while True:
            sent = between.join(state.filter("active").select(F.col("id").alias("src"), "distance"), "src").groupBy(F.col("dst").alias("id")).agg(F.min(F.col("distance") + F.col("w")).alias("offer"))
            new = state.join(sent, "id", "left").select("id", F.least("distance", F.coalesce("offer", "distance")).alias("distance"), (F.coalesce("offer", "distance") < F.col("distance")).alias("active"))
            state, old = cut(new, "sp"), state
            discard(old)
            if state.filter("active").isEmpty():
                break
    reached = state.filter(F.col("distance") < UNREACHED).select("id", "distance")
    known = reached.union(way.join(reached.withColumnRenamed("id", "to"), "to").select("id", F.col("distance") + F.col("off")))
    return vertices(e).join(known, "id", "left").select("id", F.least("distance", F.lit(UNREACHED)).alias("distance"))


def max_propagation(edges: DataFrame) -> DataFrame:
    """id, value: the largest out-degree among the vertices from which this one can be reached, itself included."""
    e = cut(edges.select("src", "dst"), "mp-edges")
    state = cut(degrees(both_ways(edges)).select("id", F.col("out_deg").alias("value"), F.lit(True).alias("active")), "mp")
    while True:
        sent = e.join(state.filter("active").select(F.col("id").alias("src"), "value"), "src").groupBy(F.col("dst").alias("id")).agg(F.max("value").alias("offer"))
        old = state
        state = cut(state.join(sent, "id", "left").select("id", F.greatest("value", F.coalesce("offer", "value")).alias("value"), (F.coalesce("offer", "value") > F.col("value")).alias("active")), "mp")
        discard(old)
        if state.filter("active").isEmpty():
            break
    return state.select("id", "value")
