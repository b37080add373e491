"""Readers of graph text files and synthetic graphs, all through Spark's text source.

Fields are split at tabs and blanks (edge lists and vertex values also at Ctrl-A). Ids are long; tokens
``id_part`` carry a label. Lines without a first field are skipped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.convert import with_reverse
from ..plans.bsp import cut

SEPARATOR = "[\t ]+"
WIDE_SEPARATOR = "[\u0001\t ]+"


def _fields(spark: SparkSession, path: str, separator: str) -> DataFrame:
    lines = spark.read.text(path).select(F.trim(F.col("value")).alias("value")).filter("value <> ''")
    return lines.select(F.split("value", separator).alias("f"))


def _id(token: Column, kind: str = "long") -> Column:
    return F.element_at(F.split(token, "_"), 1).cast(kind)


def _part(token: Column) -> Column:
    return F.try_element_at(F.split(token, "_"), F.lit(2)).cast("int")


def read_adjacency(spark: SparkSession, path: str, vertex_value=None, edge_value=None, vertex_type: str = "double", edge_type: str = "double", weight: int = 1, is_virtual: bool = False) -> tuple[DataFrame, DataFrame]:
    """(vertices(id, part, value), edges(src, src_part, dst, dst_part, weight, value, is_virtual)) from ``id n1 n2 ...``.

    Any id may be ``id_part``. A null vertex_value or edge_value leaves the column null; an array value
    (vertex_type ``array<long>``) starts empty. A line with an id alone is a vertex without edges."""
    f = _fields(spark, path, SEPARATOR)
    head = F.col("f")[0]
    value = F.array().cast(vertex_type) if vertex_type.startswith("array") else F.lit(vertex_value).cast(vertex_type)
    v = f.select(_id(head).alias("id"), _part(head).alias("part"), value.alias("value"))
    e = f.select(head.alias("h"), F.explode(F.slice("f", 2, F.greatest(F.size("f") - 1, F.lit(0)))).alias("t"))
    e = e.select(_id(F.col("h")).alias("src"), _part(F.col("h")).alias("src_part"), _id(F.col("t")).alias("dst"), _part(F.col("t")).alias("dst_part"), F.lit(weight).cast("tinyint").alias("weight"), F.lit(edge_value).cast(edge_type).alias("value"), F.lit(is_virtual).alias("is_virtual"))
    return v, e


#: The adjacency formats by name.
ADJACENCY = {
    "partition": {"weight": 2},
    "partition_default": {"weight": 1, "is_virtual": True},
    "double_double": {"vertex_value": 1.0, "edge_value": 1.0},
    "double_float": {"vertex_value": 1.0, "edge_value": 1.0, "edge_type": "float"},
    "double_null": {"vertex_value": 1.0},
    "long_double": {"vertex_value": 0, "edge_value": 1.0, "vertex_type": "long"},
    "labelled": {"vertex_value": 0.0, "edge_value": 1.0},
    "labelled_array": {"edge_value": 1.0, "vertex_type": "array<long>"},
    "labelled_head": {"edge_value": 1.0},
    "quality": {"weight": 2},
}


def read_vertex_values(spark: SparkSession, path: str) -> DataFrame:
    """id, part: ``id part`` or ``id_part``, or an id alone (part null)."""
    f = _fields(spark, path, WIDE_SEPARATOR)
    return f.select(_id(F.col("f")[0]).alias("id"), F.coalesce(F.try_element_at("f", F.lit(2)).cast("int"), _part(F.col("f")[0])).alias("part"))


def read_edge_list(spark: SparkSession, path: str, third: str | None = None, default=None, required: bool = False, tab_only: bool = False, reverse: bool = False, id_type: str = "long") -> DataFrame:
    """src, dst and, with third (a type), value from ``s d [x]``.

    A missing value takes the default, or fails the job if it is required. reverse adds each edge's
    reverse. With id_type ``string`` ids are names; densify() numbers them."""
    f = _fields(spark, path, "\t" if tab_only else WIDE_SEPARATOR)
    token = lambda i: F.col("f")[i] if id_type == "string" else _id(F.col("f")[i], id_type)
    columns = [token(0).alias("src"), token(1).alias("dst")]
    if third:
        x = F.try_element_at("f", F.lit(3))
        value = x.cast(third)
        if required:
            value = F.when(x.isNull(), F.raise_error(F.lit("an edge has no value"))).otherwise(value)
        elif default is not None:
            value = F.coalesce(value, F.lit(default).cast(third))
        columns.append(value.alias("value"))
    elif default is not None:
        columns.append(F.lit(default).alias("value"))
    e = f.select(*columns)
    return with_reverse(e) if reverse else e


#: The edge-list formats by name.
EDGE_LISTS = {
    "weight": {"third": "tinyint", "default": 1},
    "double_default": {"third": "double", "default": 0.0},
    "double": {"third": "double", "required": True},
    "zeros": {"default": 0.0},
    "zeros_reverse": {"default": 0.0, "reverse": True},
    "null": {"tab_only": True},
    "null_reverse": {"tab_only": True, "reverse": True},
    "text": {"tab_only": True, "id_type": "string"},
}


def densify(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges with long ids, dictionary(name, id)) of an edge list with names as ids.

    The names are written once, in partitions that each count from their own start, so ids are unique however
    many names there are and no task orders them all; the dictionary is joined to both ends."""
    names = edges.select(F.explode(F.array("src", "dst")).alias("name")).distinct()
    names = cut(names.withColumn("id", F.monotonically_increasing_id()), "names")
    one, two = names.select(F.col("name").alias("src"), F.col("id").alias("_s")), names.select(F.col("name").alias("dst"), F.col("id").alias("_d"))
    rest = [c for c in edges.columns if c not in ("src", "dst")]
    return edges.join(one, "src").join(two, "dst").select(F.col("_s").alias("src"), F.col("_d").alias("dst"), *rest), names


def generated_vertices(spark: SparkSession, n: int = 10, reverse: bool = False) -> DataFrame:
    """id 0 to n - 1; reversed, the ids run down along the rows."""
    ids = spark.range(n)
    return ids.select((F.lit(n - 1) - F.col("id")).alias("id")) if reverse else ids


def generated_edges(spark: SparkSession, n: int = 10) -> DataFrame:
    """src, dst: n edges from each of 0 to n - 1 to its successor."""
    return spark.range(n).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))


def ring(spark: SparkSession, n: int) -> tuple[DataFrame, DataFrame]:
    """Vertex i of value 10 i, edge i to (i + 1) mod n of value 100 i."""
    ids = spark.range(n)
    return ids.select("id", (F.col("id") * 10).cast("double").alias("value")), ids.select(F.col("id").alias("src"), ((F.col("id") + 1) % n).alias("dst"), (F.col("id") * 100).cast("float").alias("value"))
