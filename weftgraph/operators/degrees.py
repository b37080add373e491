"""Degree and frequency aggregations, messages with combiners."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..graph import both_ways, degrees


def out_degree(edges: DataFrame) -> DataFrame:
    """id, out_degree of every vertex, 0 for mere targets; both ends are counted in one aggregation."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("src").alias("id"), F.lit(1).alias("n")), F.struct(F.col("dst").alias("id"), F.lit(0).alias("n")))).alias("e"))
    return ends.groupBy("e.id").agg(F.sum("e.n").alias("out_degree"))


def in_degree(edges: DataFrame) -> DataFrame:
    return out_degree(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).withColumnRenamed("out_degree", "in_degree")


def totals(edges: DataFrame) -> DataFrame:
    """One row: edges, vertices, largest symmetric degree."""
    d = degrees(both_ways(edges))
    return d.agg(F.sum("out_deg").alias("n_edges"), F.count(F.lit(1)).alias("n_vertices"), F.max("sym_deg").alias("max_degree"))


def degree_distribution(edges: DataFrame) -> DataFrame:
    """degree (in + out), n; both ends of an edge are counted in one aggregation."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("degree"))
    return ends.groupBy("degree").agg(F.count(F.lit(1)).alias("n"))


def out_degree_frequency(edges: DataFrame, cap: int = 100) -> DataFrame:
    """degree, n: out-degrees with all above the cap in its bucket."""
    return out_degree(edges).groupBy(F.least(F.col("out_degree"), F.lit(cap)).alias("degree")).agg(F.count(F.lit(1)).alias("n"))


def combine_messages(messages: DataFrame) -> DataFrame:
    """id, total, received: the sum a vertex gets, and how many messages arrive after combining.

    A first aggregation combines, a second delivers and counts what it gets."""
    combined = messages.groupBy("dst").agg(F.sum("value").alias("value"))
    return combined.groupBy(F.col("dst").alias("id")).agg(F.sum("value").alias("total"), F.count(F.lit(1)).cast("int").alias("received"))


def deliver_messages(messages: DataFrame) -> DataFrame:
    """id, total, received: without a combiner every message arrives."""
    return messages.groupBy(F.col("dst").alias("id")).agg(F.sum("value").alias("total"), F.count(F.lit(1)).alias("received"))


def overwrite(values: DataFrame, group: str, order: str, value: str) -> DataFrame:
    """group, last_value: what an aggregator holds that each write replaces, writes taken in ascending order."""
    return values.groupBy(group).agg(F.max(F.struct(order, value))[value].alias("last_value"))


def merge_maps(maps: DataFrame, column: str) -> DataFrame:
    """key, total: maps(int to long) merged by adding the values of a key."""
    return maps.select(F.explode(column).alias("key", "v")).groupBy("key").agg(F.sum("v").alias("total"))


def aggregate_kinds(values: DataFrame, group: str, value: str) -> DataFrame:
    """Sum, least and largest of a value by group."""
    return values.groupBy(group).agg(F.sum(value).alias("sum_value"), F.min(value).alias("min_value"), F.max(value).alias("max_value"))
