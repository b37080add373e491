"""Schemas, and graphs from edges: vertex set, symmetric edges, degrees."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

EDGES = T.StructType([T.StructField("src", T.LongType(), False), T.StructField("dst", T.LongType(), False)])
VERTICES = T.StructType([T.StructField("id", T.LongType(), False), T.StructField("part", T.IntegerType(), True), T.StructField("value", T.DoubleType(), True)])


def validate(edges: DataFrame) -> DataFrame:
    """edges, if it has numeric src and dst."""
    types = dict(edges.dtypes)
    for c in ("src", "dst"):
        if types.get(c) not in ("bigint", "int", "smallint", "tinyint"):
            raise ValueError(f"edges need an integer column {c}, found {types.get(c)}")
    return edges


def vertices(edges: DataFrame) -> DataFrame:
    """id of every endpoint; a vertex that is only a target exists too."""
    return edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()


def dedup(edges: DataFrame) -> DataFrame:
    """One row for each (src, dst); parallel edges collapse. Self-loops stay."""
    return edges.select("src", "dst").distinct()


def symmetrize(edges: DataFrame) -> DataFrame:
    """src, dst, is_virtual: the real edges, and the reverse of each that has none, as a virtual edge.

    One aggregation over both directions instead of an anti-join: it shuffles once and combines before."""
    return both_ways(edges).select("src", "dst", "is_virtual")


def both_ways(edges: DataFrame) -> DataFrame:
    """As symmetrize, with is_back: whether the reverse edge is real."""
    both = edges.select("src", "dst", F.lit(1).alias("real")).union(edges.select("dst", "src", F.lit(0)))
    return both.groupBy("src", "dst").agg(F.max("real").alias("real"), F.min("real").alias("low")).select("src", "dst", (F.col("real") == 0).alias("is_virtual"), (F.col("low") == 0).alias("is_back"))


def degrees(sym: DataFrame) -> DataFrame:
    """id, out_deg, in_deg (real), deg = both, sym_deg (symmetric edges), from symmetric edges.

    A real edge in is a symmetric edge out whose reverse is real. Where the edges tell that (is_back), one
    aggregation counts all; else a second one over dst does."""
    if "is_back" in sym.columns:
        n = lambda c: F.sum(c.cast("long"))
        all_ = sym.groupBy(F.col("src").alias("id")).agg(n(~F.col("is_virtual")).alias("out_deg"), n(F.col("is_back")).alias("in_deg"), F.count(F.lit(1)).alias("sym_deg"))
        return all_.select("id", "out_deg", "in_deg", (F.col("out_deg") + F.col("in_deg")).alias("deg"), "sym_deg")
    out = sym.groupBy(F.col("src").alias("id")).agg(F.sum(F.when(F.col("is_virtual"), 0).otherwise(1)).alias("out_deg"), F.count(F.lit(1)).alias("sym_deg"))
    into = sym.filter(~F.col("is_virtual")).groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("in_deg"))
    both = out.join(into, "id", "left").withColumn("in_deg", F.coalesce("in_deg", F.lit(0)))
    return both.select("id", "out_deg", "in_deg", (F.col("out_deg") + F.col("in_deg")).alias("deg"), "sym_deg")
