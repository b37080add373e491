"""Graphs derived from the relational test tables; the SQL twin of each is in queries.py."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

PART_OFFSET = 1_000_000


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def supply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Supplier to part, bipartite and skewed."""
    return _table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("src"), (F.col("l_partkey") + PART_OFFSET).alias("dst")).distinct()


def orders_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's orders in time: disjoint paths."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("src"), F.lead("o_orderkey").over(w).alias("dst")).filter("dst IS NOT NULL")


def user_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From each event's user to the next one's: dense, with self-loops.

    The order is over all events; range partitions are ordered on their own and each one's last row is then
    joined to the next one's first, so no task sees all rows."""
    e = _table(spark, sf_dir, "events").select("ts", "event_id", "user_id")
    e = e.withColumn("bucket", F.date_trunc("hour", "ts"))
    w = Window.partitionBy("bucket").orderBy("ts", "event_id")
    inner = e.select("bucket", F.col("user_id").alias("src"), F.lead("user_id").over(w).alias("dst"))
    edge = e.groupBy("bucket").agg(F.min(F.struct("ts", "event_id", "user_id")).alias("first"), F.max(F.struct("ts", "event_id", "user_id")).alias("last"))
    # One row an hour: as many as the time span has hours, whatever the number of events.
    seam = edge.select(F.col("last.user_id").alias("src"), F.lead("first.user_id").over(Window.orderBy("bucket")).alias("dst"))
    return inner.filter("dst IS NOT NULL").select("src", "dst").union(seam.filter("dst IS NOT NULL")).distinct()


def geo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers and suppliers to nations to regions: a forest of depth 2."""
    nation = _table(spark, sf_dir, "nation").select((F.col("n_nationkey") + 100).cast("long").alias("src"), F.col("n_regionkey").cast("long").alias("dst"))
    customer = _table(spark, sf_dir, "customer").select((F.col("c_custkey") + 1000).cast("long").alias("src"), (F.col("c_nationkey") + 100).cast("long").alias("dst"))
    supplier = _table(spark, sf_dir, "supplier").select((F.col("s_suppkey") + 10_000_000).cast("long").alias("src"), (F.col("s_nationkey") + 100).cast("long").alias("dst"))
    return nation.union(customer).union(supplier)


def weighted(edges: DataFrame) -> DataFrame:
    """edges with value = 1 + (31 src + dst) mod 10."""
    return edges.withColumn("value", (1 + (F.col("src") * 31 + F.col("dst")) % 10).cast("double"))


def labels_mod(ids: DataFrame, k: int) -> DataFrame:
    """id, part = id mod k."""
    return ids.select("id", (F.col("id") % k).cast("int").alias("part"))
