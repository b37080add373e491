"""First labels: uniform, hubs, elastic repartition, and the seeds of the sampling initialisers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import uniform
from ..graph import degrees


def _label(k: int, seed: int, step: int, tag: str):
    return F.floor(uniform(seed, step, tag, F.col("id")) * k).cast("int")


def uniform_labels(ids: DataFrame, k: int, seed: int = 1) -> DataFrame:
    """id, part: at random in [0, k); a part that is already there stays."""
    kept = F.col("part") if "part" in ids.columns else F.lit(None).cast("int")
    return ids.select("id", F.coalesce(kept, _label(k, seed, 0, "init")).alias("part"))


def hub_threshold(edges: int, vertices: int) -> int:
    """ceil(E / V)."""
    return -(-edges // max(1, vertices))


def hub_labels(degree: DataFrame, k: int, threshold: int, seed: int = 1, sampled: DataFrame | None = None) -> DataFrame:
    """id, part: a random label for vertices of out-degree above the threshold (and for those sampled), null elsewhere."""
    hub = F.col("out_deg") > threshold
    if sampled is not None:
        degree = degree.join(sampled.select("id", F.lit(True).alias("s")), "id", "left")
        hub = hub | F.coalesce("s", F.lit(False))
    return degree.select("id", F.when(hub, _label(k, seed, 0, "hub")).alias("part"))


def repartition_labels(labels: DataFrame, k: int, change: int, seed: int = 1) -> DataFrame:
    """id, part for k + change parts. Shrinking redraws labels that go; growing moves a vertex to a new part with probability change / (k + change)."""
    u, v = uniform(seed, 0, "move", F.col("id")), uniform(seed, 0, "to", F.col("id"))
    if change < 0:
        part = F.when(F.col("part") >= k + change, F.floor(v * (k + change)).cast("int")).otherwise(F.col("part"))
    elif change > 0:
        part = F.when(u < F.lit(change / (k + change)), (k + F.floor(v * change)).cast("int")).otherwise(F.col("part"))
    else:
        part = F.col("part")
    return labels.select("id", part.alias("part"))


def top_share(values: DataFrame, value: str, wanted: int, seed: int = 1, tag: str = "seed") -> DataFrame:
    """The rows of values(id, value) among the ``wanted`` largest values.

    A descending cumulative histogram finds the value where the count is reached; rows above it are all
    taken, those at it with the probability that meets the count on average. The window runs over the
    distinct values, not the rows."""
    h = values.groupBy(value).agg(F.count(F.lit(1)).alias("n"))
    w = Window.orderBy(F.desc(value)).rowsBetween(Window.unboundedPreceding, -1)
    h = h.withColumn("before", F.coalesce(F.sum("n").over(w), F.lit(0)))
    cut = h.filter(F.col("before") < wanted).withColumn("chance", F.least(F.lit(1.0), (F.lit(wanted) - F.col("before")) / F.col("n"))).select(value, "chance")
    return values.join(cut, value).filter(uniform(seed, 0, tag, F.col("id")) < F.col("chance")).select("id", value)


def share_count(share: float, vertices: int) -> int:
    return int(share * vertices) + 1


def highest_degree_seeds(sym: DataFrame, sigma: float, seed: int = 1) -> DataFrame:
    """id, deg: about sigma V vertices of largest in + out degree."""
    d = degrees(sym).select("id", "deg")
    return top_share(d, "deg", share_count(sigma, d.count()), seed)


def clustering_seeds(cc: DataFrame, sigma: float, seed: int = 1) -> DataFrame:
    """id, bucket: about sigma V vertices of largest clustering coefficient, in thousandths."""
    pairs = F.greatest(F.col("degree") * (F.col("degree") - 1), F.lit(1))
    b = cc.select("id", F.floor(F.col("links") * 1000 / pairs).cast("int").alias("bucket"))
    return top_share(b, "bucket", share_count(sigma, b.count()), seed)


def distribution_probabilities(sym: DataFrame, sigma: float) -> DataFrame:
    """degree, n, p = n / V, seed_p = p sigma V / sum(n p), spread_p = p + (1 - max p) / 2. One row a degree."""
    h = degrees(sym).groupBy(F.col("deg").alias("degree")).agg(F.count(F.lit(1)).alias("n"))
    every = Window.partitionBy()
    h = h.withColumn("p", F.col("n") / F.sum("n").over(every))
    square = F.sum(F.col("n") * F.col("n")).over(every)
    total = F.sum("n").over(every)
    return h.select("degree", "n", "p", (F.col("p") * F.lit(float(sigma)) * total * total / square).alias("seed_p"), (F.col("p") + (1 - F.max("p").over(every)) / 2).alias("spread_p"))


def distribution_seeds(sym: DataFrame, sigma: float, seed: int = 1) -> DataFrame:
    """id, deg: each vertex with the probability of its degree."""
    d = degrees(sym).select("id", "deg")
    p = distribution_probabilities(sym, sigma).select(F.col("degree").alias("deg"), "seed_p")
    return d.join(p, "deg").filter(uniform(seed, 0, "seed", F.col("id")) < F.col("seed_p")).select("id", "deg")


def random_seeds(sym: DataFrame, sigma: float, seed: int = 1) -> DataFrame:
    """id, deg: each vertex with probability sigma."""
    return degrees(sym).select("id", "deg").filter(uniform(seed, 0, "seed", F.col("id")) < F.lit(float(sigma)))
