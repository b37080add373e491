"""Sampling initialisers: grow a sample from seeds along edges, then label it.

One cycle: the newly sampled ask their neighbours' degrees, each notifies its ``tau`` best unsampled ones (the
degree-distribution sampler draws instead), and a notified vertex joins with the probability that meets the
target size on average. If nobody joins, all sampled vertices ask again.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import uniform
from ..graph import degrees
from ..operators.triangles import clustering_coefficient
from ..plans.bsp import cut
from . import initial

#: Hash ranges in which sampled vertices are ranked on their own, to be dealt to the labels in turn.
RANGES = 1024
#: Cycles after which the tables of sampled vertices become one.
GATHER = 6
#: Vertices of which a list may be broadcast.
BROADCAST_ROWS = 1_000_000


@dataclass(frozen=True)
class Sampling:
    kind: str = "rd"  # rd, hd, cc or gd
    beta: float = 0.15
    sigma: float = 0.05
    tau: int = 3
    cycles: int = 50


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def seeds(sym: DataFrame, s: Sampling, seed: int = 1) -> DataFrame:
    if s.kind == "hd":
        found = initial.highest_degree_seeds(sym, s.sigma, seed)
    elif s.kind == "cc":
        found = initial.clustering_seeds(clustering_coefficient(sym), s.sigma, seed)
    elif s.kind == "gd":
        found = initial.distribution_seeds(sym, s.sigma, seed)
    elif s.kind == "rd":
        found = initial.random_seeds(sym, s.sigma, seed)
    else:
        raise ValueError(f"no sampler {s.kind}")
    return found.select("id")


def sample(sym: DataFrame, s: Sampling, k: int, seed: int = 1, degree: DataFrame | None = None) -> tuple[DataFrame, bool, dict]:
    """(id, cycle) of the sampled vertices, whether the target size was reached, and facts of the run."""
    began = time.time()
    d = degree if degree is not None else cut(degrees(sym), "sa-deg")
    n = d.count()
    target = max(k, initial.share_count(s.beta, n))
    taken = cut(seeds(sym, s, seed).withColumn("cycle", F.lit(0)), "sa")
    spread = initial.distribution_probabilities(sym, s.sigma).select(F.col("degree").alias("deg"), "spread_p") if s.kind == "gd" else None
    # Each edge once with the degree of the vertex that is asked, so a cycle joins no degrees.
    known = cut(sym.select(F.col("src").alias("by"), F.col("dst").alias("id")).join(_small(d.select("id", "deg"), n), "id").select("by", "id", "deg"), "sa-known")
    active, size, sent, cycles, extra, everyone, parts, worked = taken.select("id"), taken.count(), 0, 0, 0, True, 0, None
    asking = size
    for c in range(1, s.cycles + 1):
        if size >= target:
            worked = True
            break
        cycles = c
        asked_of = known.join(_small(active.select(F.col("id").alias("by")), asking), "by").join(_small(taken.select("id"), size), "id", "left_anti")
        if spread is not None:
            told = asked_of.join(spread, "deg").filter(uniform(seed, c, "spread", F.col("by"), F.col("id")) < F.col("spread_p"))
        else:
            order = Window.partitionBy("by").orderBy(F.desc("deg"), "id")
            told = asked_of.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= s.tau)
        told = told.groupBy("id").agg(F.count(F.lit(1)).alias("n")).persist()  # read twice, then gone
        notified = told.agg(F.sum("n")).first()[0] or 0
        sent += notified
        chance = min(1.0, (target - size) / notified) if notified else 0.0
        joined = cut(told.filter(uniform(seed, c, "join", F.col("id")) < F.lit(chance)).select("id", F.lit(c).alias("cycle")), "sa-new")
        new = joined.count()
        told.unpersist()
        if not new:
            if not notified and everyone:  # nobody is left to ask
                worked = False
                break
            active, asking, extra, everyone = taken.select("id"), size, extra + 1, True
            continue
        everyone = False
        taken, parts = taken.union(joined), parts + 1
        if parts % GATHER == 0:
            taken = cut(taken.coalesce(1) if size + new <= BROADCAST_ROWS else taken, "sa")
        size, active, asking = size + new, joined.select("id"), new
    if worked is None:
        worked = size >= target
    took = int((time.time() - began) * 1000)
    return taken, worked, {"Sampling time": took, "SAMPLING CYCLES": cycles, "Avg. Sampling cycle time": took / max(1, cycles), "SAMPLING MESSAGES": sent, "SAMPLING EXTRA": extra}


def sample_labels(sym: DataFrame, s: Sampling, k: int, seed: int = 1, degree: DataFrame | None = None) -> tuple[DataFrame, bool, dict]:
    """(id, part) with null for vertices outside the sample, whether sampling worked, and its facts; no label stays empty.

    The sampled are dealt to the labels in turn, in the order of a hash: ranked within ranges of the hash, each range
    going on where the one before ends."""
    taken, ok, facts = sample(sym, s, k, seed, degree)
    drawn = cut(taken.select("id", uniform(seed, 0, "sampled", F.col("id")).alias("u")).withColumn("range", F.floor(F.col("u") * RANGES).cast("int")), "sa-drawn")
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # over RANGES rows at most
    offsets = drawn.groupBy("range").agg(F.count(F.lit(1)).alias("n")).select("range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    ranked = drawn.withColumn("rank", F.row_number().over(Window.partitionBy("range").orderBy("u", "id"))).join(F.broadcast(offsets), "range")
    named = ranked.select("id", F.pmod(F.col("offset") + F.col("rank") - 1, F.lit(k)).cast("int").alias("part"))
    every = degree if degree is not None else degrees(sym)
    return every.select("id").join(named, "id", "left"), ok, facts
