"""The steps of label propagation, each a DataFrame step on a frozen snapshot of labels and loads.

The k loads are the driver's: k numbers a superstep. A vertex's neighbour counts by label are k conditional sums in
one aggregation, so no row is multiplied by k. In the loop these counts are part of the state, and a step ships only
the labels of vertices that moved: their edges add one to the new label's count at the neighbour and take one from
the old label's.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ceil3, uniform


DEGREES = ("out_deg", "sym_deg")
#: Vertices whose new labels may be broadcast, three numbers each.
BROADCAST_ROWS = 1_000_000


@dataclass(frozen=True)
class Objective:
    """kind: ``edge`` (loads are real out-edges), ``vertex`` (loads are vertices) or ``baseline`` (symmetric edges)."""

    kind: str = "edge"
    k: int = 8
    lam: float = 1.0
    kappa: float = 0.5
    slack: float = 0.05
    #: What a real edge counts in a neighbour's label; a virtual one counts 1.
    weight: int = 1
    #: Undirected, virtual edges are as good as real ones in capacities and local edges.
    directed: bool = True

    def capacity(self, edges: int, sym_edges: int, vertices: int) -> int:
        whole = {"edge": edges if self.directed else sym_edges, "vertex": vertices, "baseline": sym_edges}[self.kind]
        return int(whole * (1 + self.slack) / self.k + 0.5)

    @property
    def load(self) -> Column:
        return {"edge": F.col("out_deg"), "vertex": F.lit(1), "baseline": F.col("sym_deg")}[self.kind]


def label_counts(sym: DataFrame, labels: DataFrame, k: int) -> DataFrame:
    """id, total, real_total, s0.. (edges to neighbours of each label), r0.. (real ones), heard.

    Neighbours without a label count in total only. heard: some neighbour moved, if labels tell who did."""
    tells = "moved" in labels.columns
    e = sym.join(labels.select(F.col("id").alias("dst"), F.col("part").alias("pd"), *([F.col("moved").alias("m")] if tells else [])), "dst")
    heard = F.coalesce(F.max("m"), F.lit(False)) if tells else F.lit(True)
    real = ~F.col("is_virtual")
    n = lambda c: F.sum(F.when(c, 1).otherwise(0))
    return e.groupBy(F.col("src").alias("id")).agg(
        F.count(F.lit(1)).alias("total"), n(real).alias("real_total"), n(F.col("pd").isNotNull()).alias("labelled"), heard.alias("heard"),
        *[n(F.col("pd") == i).alias(f"s{i}") for i in range(k)], *[n(real & (F.col("pd") == i)).alias(f"r{i}") for i in range(k)],
    )


def count_columns(k: int) -> list[str]:
    return [f"{c}{i}" for c in "sr" for i in range(k)]


def count_changes(sym: DataFrame, changes: DataFrame, k: int, rows: int, weight: int = 1, directed: bool = True) -> DataFrame:
    """id and what changes(id, old, new) add to the counts s0.., r0.. of its neighbours; rows: of changes, at most.

    sym tells of each edge whether its reverse is real (is_back): that edge counts the vertex as a real neighbour. Few
    changes are broadcast, so the edges stay where they are; others join by shuffle."""
    moved = changes.select(F.col("id").alias("src"), "old", "new")
    e = sym.select("src", "dst", "is_back").join(F.broadcast(moved) if rows <= BROADCAST_ROWS else moved, "src")
    one = lambda c, i: F.when(F.col(c) == i, 1).otherwise(0)
    less = [(one("new", i) - one("old", i)) for i in range(k)]
    return e.groupBy(F.col("dst").alias("id")).agg(
        *[F.sum(x * F.when(F.col("is_back"), weight).otherwise(1) if weight != 1 else x).alias(f"s{i}") for i, x in enumerate(less)], *[F.sum(F.when(F.col("is_back"), x).otherwise(0) if directed else x).alias(f"r{i}") for i, x in enumerate(less)]
    )


def with_changes(state: DataFrame, changed: DataFrame, k: int, vertices: int) -> DataFrame:
    """state with the counts moved by count_changes, and heard: whether some neighbour moved."""
    names = count_columns(k)
    delta = changed.select("id", F.lit(True).alias("_heard"), *[F.col(c).alias(f"_{c}") for c in names])
    rows = state.join(F.broadcast(delta) if vertices * (2 * k + 1) <= BROADCAST_ROWS else delta, "id", "left")
    return rows.select(*[c for c in state.columns if c not in (*names, "heard")], F.coalesce("_heard", F.lit(False)).alias("heard"), *[(F.col(c) + F.coalesce(f"_{c}", F.lit(0))).alias(c) for c in names])


def histogram(sym: DataFrame, labels: DataFrame, weight: int = 1) -> DataFrame:
    """id, label, n: neighbours' labels over all symmetric edges, real ones counted by weight."""
    n = F.sum(F.when(F.col("is_virtual"), 1).otherwise(weight)).alias("n")
    return sym.join(labels.select(F.col("id").alias("dst"), F.col("part").alias("label")), "dst").filter("label IS NOT NULL").groupBy(F.col("src").alias("id"), "label").agg(n)


def score(o: Objective, i: int, loads: list[int], capacity: int, vertices: int) -> Column:
    """H of label i, rounded to 12 places so that no order of sums decides a tie. Frequencies are over labelled neighbours."""
    share = F.when(F.col("labelled") > 0, F.col(f"s{i}") / F.col("labelled")).otherwise(0.0)
    if o.kind == "vertex":
        real = F.when(F.col("real_total") > 0, F.col(f"r{i}") / F.col("real_total")).otherwise(0.0)
        h = F.lit(o.lam) + share + F.lit(o.lam) * (F.lit(o.kappa) * real - F.lit(1 - o.kappa) * ceil3(F.lit(loads[i]), vertices))
    else:
        h = F.lit(o.lam) + share - F.lit(o.lam) * ceil3(F.lit(loads[i]), capacity)
    return F.round(h, 12)


def scores(o: Objective, counts: DataFrame, loads: list[int], capacity: int, vertices: int) -> DataFrame:
    """id, label, score for every label."""
    one = [F.struct(F.lit(i).alias("label"), score(o, i, loads, capacity, vertices).alias("score")) for i in range(o.k)]
    return counts.select("id", F.explode(F.array(*one)).alias("x")).select("id", "x.label", "x.score")


def choose(o: Objective, counts: DataFrame, labels: DataFrame, loads: list[int], capacity: int, vertices: int, seed: int, step: int, labelled_only: bool = False) -> DataFrame:
    """id, cur, nxt, h_cur, heard: the label of largest score; ties keep the current one, else a hash draws.

    Degrees that labels carry go along. labelled_only: labels that no neighbour has are no choice, and without any there is none (first step)."""
    carried = [c for c in DEGREES if c in labels.columns]
    return choice(o, counts.join(labels.select("id", F.col("part").alias("cur"), *carried), "id"), loads, capacity, vertices, seed, step, labelled_only).select("id", "cur", "nxt", "h_cur", "heard", *carried)


def choice(o: Objective, rows: DataFrame, loads: list[int], capacity: int, vertices: int, seed: int, step: int, labelled_only: bool = False) -> DataFrame:
    """rows(id, cur, labelled, real_total, s0.., r0..) with nxt and h_cur, as choose says."""
    each = F.array(*[score(o, i, loads, capacity, vertices) for i in range(o.k)])
    # max of (score, is current, draw, -label)
    x = [F.struct(F.col("h")[i].alias("h"), F.coalesce(F.col("cur") == i, F.lit(False)).alias("own"), uniform(seed, step, "tie", F.col("id"), F.lit(i)).alias("u"), F.lit(-i).alias("neg")) for i in range(o.k)]
    best = F.array_max(F.array(*[F.when(F.col(f"s{i}") > 0, c) if labelled_only else c for i, c in enumerate(x)]))
    rows = rows.withColumn("h", each)
    return rows.withColumn("nxt", -best["neg"]).withColumn("h_cur", F.when(F.col("cur").isNull(), 0.0).otherwise(F.element_at("h", F.col("cur") + 1))).drop("h")


def demand(o: Objective, chosen: DataFrame) -> DataFrame:
    """label, requests, demand (in the unit of the loads) of vertices that want to move and heard something."""
    asks = chosen.filter("heard AND nxt IS NOT NULL AND (cur IS NULL OR nxt <> cur)")
    return asks.groupBy(F.col("nxt").alias("label")).agg(F.count(F.lit(1)).alias("requests"), F.sum(o.load).cast("long").alias("demand"))


def chances(loads: list[int], demands: dict[int, int], capacity: int) -> list[float]:
    """For each label the probability with which a request is admitted."""
    return [0.0 if not demands.get(i) or loads[i] >= capacity else min(1.0, (capacity - loads[i]) / demands[i]) for i in range(len(loads))]


def admit(chosen: DataFrame, chance: list[float], seed: int, step: int, carried: list[str] | None = None) -> DataFrame:
    """id, cur, nxt, h_cur, part (the label after migration), moved, and the degrees or other columns that are carried."""
    p = F.element_at(F.array(*[F.lit(float(c)) for c in chance]), F.col("nxt") + 1)
    asks = F.col("heard") & F.col("nxt").isNotNull() & (F.col("cur").isNull() | (F.col("nxt") != F.col("cur")))
    moved = F.coalesce(asks & (uniform(seed, step, "admit", F.col("id")) < p), F.lit(False))
    return chosen.withColumn("moved", moved).select("id", "cur", "nxt", "h_cur", F.when(moved, F.col("nxt")).otherwise(F.col("cur")).alias("part"), "moved", *([c for c in DEGREES if c in chosen.columns] if carried is None else carried))


def first_migration(chosen: DataFrame, k: int, seed: int) -> DataFrame:
    """id, part: the chosen label, else the one it has, else a random one; nobody is turned away."""
    return chosen.select("id", F.coalesce("nxt", "cur", F.floor(uniform(seed, 0, "left", F.col("id")) * k).cast("int")).alias("part"))
