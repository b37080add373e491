"""Triangle closing, clustering coefficients, top neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..graph import degrees


#: Neighbours of one vertex whose pairs one task looks at; those of a hub are dealt to more.
PART = 2_000


def triangle_closing(edges: DataFrame, exclude_existing: bool = False, least: int = 2) -> DataFrame:
    """id, candidate, common, rank: vertices that at least so many in-neighbours of id point to, most common first.

    Each pair of neighbours is looked at once, from its smaller end, and counts for both. A hub's pairs are dealt over
    tasks by the smaller end, ``PART`` of them each, and combined there before they are shuffled."""
    parts = edges.groupBy(F.col("src").alias("via")).agg(F.ceil(F.count(F.lit(1)) / PART).cast("int").alias("parts"))
    known = edges.select(F.col("src").alias("via"), "dst").join(parts, "via")
    one = known.select("via", F.col("dst").alias("a"), F.pmod(F.xxhash64("dst"), F.col("parts")).cast("int").alias("salt"))
    two = known.select("via", F.col("dst").alias("b"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("salt"))
    pairs = one.join(two, ["via", "salt"]).filter("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("common")).filter(F.col("common") >= least)
    ends = F.array(F.struct(F.col("a").alias("id"), F.col("b").alias("candidate")), F.struct(F.col("b").alias("id"), F.col("a").alias("candidate")))
    counts = pairs.select(F.explode(ends).alias("x"), "common").select("x.id", "x.candidate", "common")
    if exclude_existing:
        counts = counts.join(edges.select(F.col("src").alias("id"), F.col("dst").alias("candidate")), ["id", "candidate"], "left_anti")
    order = Window.partitionBy("id").orderBy(F.desc("common"), "candidate")
    return counts.withColumn("rank", F.row_number().over(order))


def oriented(sym: DataFrame) -> DataFrame:
    """Each symmetric edge between two vertices once, from the end of smaller (degree, id): no vertex keeps more than sqrt(2 E)."""
    d = degrees(sym).select("id", F.col("sym_deg").alias("n"))
    e = sym.filter("src < dst").select("src", "dst").join(d.select(F.col("id").alias("src"), F.col("n").alias("ns")), "src").join(d.select(F.col("id").alias("dst"), F.col("n").alias("nd")), "dst")
    low = (F.col("ns") < F.col("nd")) | ((F.col("ns") == F.col("nd")) & (F.col("src") < F.col("dst")))
    return e.select(F.when(low, F.col("src")).otherwise(F.col("dst")).alias("low"), F.when(low, F.col("dst")).otherwise(F.col("src")).alias("high"))


def clustering_coefficient(sym: DataFrame) -> DataFrame:
    """id, degree, links, cc = links / (d (d - 1)), where links sums |N(u) and N(v) in common| over neighbours v of u.

    Self-loops are in N as the symmetric edges hold them. Triangles are found on the oriented graph, so a hub
    is the low end of few edges; each adds 2 to its three corners. Loops add what the definition gives: a
    loop at u makes u a common neighbour of u and each v, and of u and itself; a loop at v adds one."""
    e = oriented(sym)
    wedge = e.select("low", F.col("high").alias("a")).join(e.select("low", F.col("high").alias("b")), "low").filter("a < b")
    closed = wedge.join(sym.select(F.col("src").alias("a"), F.col("dst").alias("b")), ["a", "b"], "left_semi")
    corner = closed.select(F.explode(F.array("low", "a", "b")).alias("id")).groupBy("id").agg((2 * F.count(F.lit(1))).alias("inner"))
    loops = sym.filter("src = dst").select(F.col("src").alias("id"), F.lit(1).alias("loop"))
    near = sym.filter("src <> dst").join(loops.select(F.col("id").alias("dst"), "loop"), "dst").groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("near_loops"))
    d = degrees(sym).select("id", F.col("sym_deg").alias("degree"))
    out = d.join(corner, "id", "left").join(loops, "id", "left").join(near, "id", "left").na.fill(0, ["inner", "loop", "near_loops"])
    # v = u: N(u) whole, degree; each other v: u itself is common, degree - 1; v's own loop makes v common.
    links = F.col("inner") + F.col("near_loops") + F.col("loop") * (2 * F.col("degree") - 1)
    cc = F.when(F.col("degree") > 1, F.col("links") / (F.col("degree") * (F.col("degree") - 1))).otherwise(0.0)
    return out.withColumn("links", links).select("id", "degree", "links", cc.alias("cc"))


def cc_histogram(cc: DataFrame) -> DataFrame:
    """bucket = cc * 1000 cut to an integer, n."""
    return cc.groupBy(F.floor(F.col("links") * 1000 / F.greatest(F.col("degree") * (F.col("degree") - 1), F.lit(1))).cast("int").alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def top_neighbours(sym: DataFrame, tau: int) -> DataFrame:
    """id, neighbour, deg, rank: the tau neighbours of largest in + out degree, ties to the smaller id."""
    d = degrees(sym).select(F.col("id").alias("dst"), "deg")
    order = Window.partitionBy("src").orderBy(F.desc("deg"), "dst")
    return sym.select("src", "dst").join(d, "dst").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= tau).select(F.col("src").alias("id"), F.col("dst").alias("neighbour"), "deg", "rank")
