"""Deadlock detection on a wait-for graph with tagged requests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..graph import vertices
from ..plans.bsp import cut


def deadlock(edges: DataFrame, initiator: int) -> DataFrame:
    """id, notified, free for every vertex of edges(src, dst, tag).

    Vertices the initiator reaches are notified. A notified vertex is free if it waits for nothing, or if for
    some tag all it waits for is free; this is the least fixpoint the grants arrive at. The initiator is
    deadlocked if it is not free."""
    e = cut(edges.select("src", "dst", "tag").distinct(), "dl-edges")
    reached = cut(vertices(edges).select("id", (F.col("id") == initiator).alias("notified"), (F.col("id") == initiator).alias("active")), "dl")
    while True:
        told = e.join(reached.filter("active").select(F.col("id").alias("src")), "src").select(F.col("dst").alias("id")).distinct().withColumn("told", F.lit(True))
        reached = cut(reached.join(told, "id", "left").select("id", (F.col("notified") | F.coalesce("told", F.lit(False))).alias("notified"), (~F.col("notified") & F.coalesce("told", F.lit(False))).alias("active")), "dl")
        if reached.filter("active").isEmpty():
            break
    waits = e.join(reached.filter("notified").select(F.col("id").alias("src")), "src")
    need = cut(waits.groupBy("src", "tag").agg(F.count(F.lit(1)).alias("need")), "dl-need")
    waits = cut(waits, "dl-waits")
    first = reached.filter("notified").select("id").join(need.select(F.col("src").alias("id")), "id", "left_anti")
    free = cut(first, "dl-free")
    while True:
        got = waits.join(free.select(F.col("id").alias("dst")), "dst").groupBy("src", "tag").agg(F.count(F.lit(1)).alias("got"))
        more = got.join(need, ["src", "tag"]).filter("got = need").select(F.col("src").alias("id")).distinct().join(free, "id", "left_anti")
        more = cut(more, "dl-more")
        if more.isEmpty():
            break
        free = cut(free.union(more), "dl-free")
    return reached.select("id", "notified").join(free.withColumn("free", F.lit(True)), "id", "left").select("id", "notified", F.coalesce("free", F.lit(False)).alias("free"))
