"""Weakly connected components by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.bsp import cut


def _roots(parents: DataFrame) -> DataFrame:
    """parents(id, p) with p <= id, each p replaced by the end of its chain; chains halve with each jump."""
    while True:
        jumped = parents.join(parents.select(F.col("id").alias("p"), F.col("p").alias("far")), "p")
        if jumped.filter("far <> p").isEmpty():
            return parents
        parents = cut(jumped.select("id", F.col("far").alias("p")), "cc-jump")


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """id, component (the smallest id of the component) for every endpoint of edges.

    In each round every vertex points to its smallest neighbour (or itself), chains of pointers are followed
    to their ends, and the edges are rewritten between those ends. At least every other end of an edge goes
    in a round, and the edges that are left, without copies, shrink as fast; long paths go in one round."""
    a, b = F.col(src), F.col(dst)
    e = cut(edges.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct(), "cc-edges")
    found: DataFrame | None = None
    while True:
        ends = e.select(F.explode(F.array(F.struct(F.col("a").alias("id"), F.col("b").alias("n")), F.struct(F.col("b").alias("id"), F.col("a").alias("n")))).alias("x"))
        parents = _roots(cut(ends.groupBy("x.id").agg(F.min("x.n").alias("n")).select("id", F.least("id", "n").alias("p")), "cc-parents"))
        if found is None:
            found = parents
        else:
            step = parents.select(F.col("id").alias("p"), F.col("p").alias("q"))
            found = cut(found.join(step, "p", "left").select("id", F.coalesce("q", "p").alias("p")), "cc-found")
        one, two = parents.select(F.col("id").alias("a"), F.col("p").alias("pa")), parents.select(F.col("id").alias("b"), F.col("p").alias("pb"))
        e = cut(e.filter("a <> b").join(one, "a").join(two, "b").filter("pa <> pb").select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct(), "cc-edges")
        if e.isEmpty():
            return found.select("id", F.col("p").alias("component"))
