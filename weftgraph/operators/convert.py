"""Conversion, set-style operators and mutation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..graph import vertices


def with_reverse(edges: DataFrame) -> DataFrame:
    """Every edge and its reverse; an edge that has a real reverse comes twice."""
    others = [c for c in edges.columns if c not in ("src", "dst")]
    return edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *others))


def adjacency(edges: DataFrame, sep: str = "\t") -> DataFrame:
    """id and its neighbours in ascending order as one delimited string; empty for a vertex without out-edges."""
    lists = edges.groupBy(F.col("src").alias("id")).agg(F.concat_ws(sep, F.transform(F.sort_array(F.collect_list("dst")), lambda x: x.cast("string"))).alias("neighbours"))
    return vertices(edges).join(lists, "id", "left").select("id", F.coalesce("neighbours", F.lit("")).alias("neighbours"))


def partitioned_adjacency(sym: DataFrame, labels: DataFrame, real_only: bool = False, plain_neighbours: bool = False) -> DataFrame:
    """line: ``id_part``, then neighbours in ascending order, as ``id_part`` or plain, tab-separated."""
    e = sym.filter(~F.col("is_virtual")) if real_only else sym
    name: Column = F.concat_ws("_", F.col("dst"), F.col("p"))
    e = e.join(labels.select(F.col("id").alias("dst"), F.col("part").alias("p")), "dst").select("src", F.struct(F.col("dst").alias("k"), (F.col("dst").cast("string") if plain_neighbours else name).alias("t")).alias("n"))
    lists = e.groupBy(F.col("src").alias("id")).agg(F.sort_array(F.collect_list("n"))["t"].alias("n"))
    return labels.join(lists, "id", "left").select("id", F.concat_ws("\t", F.concat_ws("_", "id", "part"), F.array_join("n", "\t")).alias("line"))


def friends(edges: DataFrame) -> DataFrame:
    """src, dst, friends: the neighbours of src, in ascending order, as sent to each neighbour dst."""
    lists = edges.groupBy("src").agg(F.sort_array(F.collect_set("dst")).alias("friends"))
    return edges.select("src", "dst").join(lists, "src")


def add_edges(edges: DataFrame, more: DataFrame) -> DataFrame:
    return edges.unionByName(more).distinct()


def remove_edges(edges: DataFrame, gone: DataFrame) -> DataFrame:
    return edges.join(gone.select("src", "dst"), ["src", "dst"], "left_anti")


def remove_vertices(vertex_ids: DataFrame, edges: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Vertices without those gone, and edges without theirs; edges into a vertex that is gone stay."""
    return vertex_ids.join(gone.select("id"), "id", "left_anti"), edges.join(gone.select(F.col("id").alias("src")), "src", "left_anti")


def identity(edges: DataFrame) -> DataFrame:
    return edges


def reset_labels(labels: DataFrame) -> DataFrame:
    """All vertices unassigned."""
    return labels.withColumn("part", F.lit(None).cast("int"))


def place_by_hash(ids: DataFrame, partitions: int, workers: int) -> DataFrame:
    """id, part = |id mod partitions|, worker = part mod workers."""
    part = F.abs(F.col("id") % partitions).cast("int")
    return ids.select("id", part.alias("part"), (part % workers).alias("worker"))


def place_by_label(labels: DataFrame, workers: int) -> DataFrame:
    """id, part, worker = |part| mod workers."""
    return labels.select("id", "part", (F.abs("part") % workers).alias("worker"))


def placed(df: DataFrame, partitions: int, part: str = "part") -> DataFrame:
    """df with the rows of label p in Spark partition p."""
    return df.repartitionById(partitions, F.col(part).cast("int"))
