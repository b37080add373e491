"""PageRank in two definitions, random walk with restart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..graph import vertices
from ..plans.bsp import cut, discard


def _spread(edges: DataFrame) -> DataFrame:
    """src, dst, share: each edge with the part of its source's rank it carries."""
    out = edges.groupBy("src").agg(F.count(F.lit(1)).alias("n"))
    return cut(edges.select("src", "dst").join(out, "src").select("src", "dst", (F.lit(1.0) / F.col("n")).alias("share")), "spread")


def pagerank(edges: DataFrame, steps: int = 30, damping: float = 0.85, initial: DataFrame | None = None) -> DataFrame:
    """id, rank after so many steps of r = (1 - damping) / N + damping * sum; mass at sinks is lost.

    initial(id, rank) starts it, else 1 everywhere."""
    ids = cut(vertices(edges), "pr-ids")
    n = ids.count()
    out = edges.groupBy("src").agg(F.count(F.lit(1)).alias("n"))
    e = cut(edges.select("src", "dst").join(out, "src"), "pr-edges")
    ranks = ids.withColumn("rank", F.lit(1.0)) if initial is None else initial
    for _ in range(steps):
        got = e.join(ranks.withColumnRenamed("id", "src"), "src").groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("rank") / F.col("n")).alias("got"))
        old = ranks
        ranks = cut(ids.join(got, "id", "left").select("id", (F.lit(1 - damping) / n + F.lit(damping) * F.coalesce("got", F.lit(0.0))).alias("rank")), "pr")
        discard(old)
    return ranks


def random_walk(edges: DataFrame, steps: int = 30, restart: float = 0.15, tolerance: float = 1e-5, sources: DataFrame | None = None, weight: str | None = None) -> tuple[DataFrame, int]:
    """(id, rank) and the number of steps: a walk that jumps with probability restart, to any vertex or to sources(id).

    Mass at sinks is spread over all vertices, and each state is divided by the total mass of the one
    before; it stops when the L1 change falls under the tolerance. With a weight column a transition carries
    state times weight, else state / out-degree."""
    ids = cut(vertices(edges), "rw-ids")
    n = ids.count()
    if sources is None:
        bias: Column = F.lit(restart / n)
    else:
        sources = cut(sources.select("id").distinct().join(ids, "id", "left_semi").withColumn("source", F.lit(1)), "rw-sources")
        n_sources = sources.count()
        if not n_sources:
            raise ValueError("a walk with restart needs a source vertex")
        ids = cut(ids.join(sources, "id", "left"), "rw-ids")
        bias = F.when(F.col("source") == 1, F.lit(restart / n_sources)).otherwise(0.0)
    e = cut(edges.select("src", "dst", F.col(weight).alias("share")), "rw-edges") if weight else _spread(edges)
    ids = cut(ids.join(e.select(F.col("src").alias("id")).distinct().withColumn("moves", F.lit(1)), "id", "left"), "rw-ids")
    state = cut(ids.withColumn("rank", F.lit(1.0 / n)), "rw")
    total, done = 1.0, 0
    for _ in range(steps):
        lost = state.agg(F.sum(F.when(F.col("moves").isNull(), F.col("rank")).otherwise(0.0))).first()[0] or 0.0
        got = e.join(state.select(F.col("id").alias("src"), "rank"), "src").groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("rank") * F.col("share")).alias("got"))
        new = state.withColumnRenamed("rank", "old").join(got, "id", "left")
        new = new.withColumn("rank", (F.lit(1 - restart) * (F.coalesce("got", F.lit(0.0)) + F.lit(lost / n)) + bias) / F.lit(total))
        new = cut(new.select(*ids.columns, "old", "rank"), "rw")
        total, change = new.agg(F.sum("rank"), F.sum(F.abs(F.col("rank") - F.col("old")))).first()
        discard(state)
        state, done = new.drop("old"), done + 1
        state._scratch_path = new._scratch_path
        if done > 1 and change < tolerance:
            break
    return state.select("id", "rank"), done
