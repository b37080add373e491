"""The partitioner: convert, label first, propagate until the score settles.

The state is a table of one row a vertex: its label, degrees and the counts of its neighbours' labels. A superstep
is a projection of that table (scores and choice), k sums of demand, and one join that moves the counts by the
edges of the vertices that moved. Its tables go as soon as the next step is written.
"""

from __future__ import annotations

import time
from collections import deque
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..graph import both_ways, dedup, degrees
from ..plans.bsp import cut, discard, kept, scratch
from . import initial
from . import propagation as lp
from .sampling import Sampling, sample_labels


@dataclass
class Result:
    """labels(id, part), the symmetric edges, and what a run report tells."""

    labels: DataFrame
    sym: DataFrame
    facts: dict = field(default_factory=dict)


def loads_of(o: lp.Objective, state: DataFrame) -> tuple[list[int], int, float]:
    """The k loads, and the moves and the score of the step that made this state. At most k + 1 rows come to the driver."""
    loads, moved, _, total = _sums(o, state)
    return loads, moved, total


def _sums(o: lp.Objective, state: DataFrame) -> tuple[list[int], int, int, float]:
    """Loads, vertices that moved, messages they send (one an edge), score."""
    tells = "moved" in state.columns
    moved = F.sum(F.col("moved").cast("long")) if tells else F.lit(0)
    sent = F.sum(F.when(F.col("moved"), F.col("sym_deg")).otherwise(0)) if tells else F.lit(0)
    score = F.sum("h_cur") if "h_cur" in state.columns else F.lit(0.0)
    rows = state.groupBy("part").agg(F.sum(o.load).cast("long").alias("load"), moved.alias("moved"), sent.alias("sent"), score.alias("score")).collect()
    found = {r.part: r.load for r in rows}
    return [found.get(i, 0) for i in range(o.k)], sum(r.moved for r in rows), sum(r.sent for r in rows), float(sum(r.score for r in sorted(rows, key=lambda r: (r.part is not None, r.part))))


def _first_labels(sym: DataFrame, degree: DataFrame, o: lp.Objective, init, seed: int, e: int, v: int, start: DataFrame | None, change: int) -> tuple[DataFrame, dict]:
    """(id, part) and facts of the initialiser."""
    if isinstance(init, Sampling):
        labels, worked, facts = sample_labels(sym, init, o.k, seed, degree)
        if not worked:
            labels = initial.hub_labels(degree, o.k, initial.hub_threshold(e, v), seed, labels.filter("part IS NOT NULL"))
        return labels, facts | {"SAMPLING_ERROR": not worked}
    if init == "hub":
        return initial.hub_labels(degree, o.k, initial.hub_threshold(e, v), seed), {}
    if init == "uniform":
        return initial.uniform_labels(degree.select("id"), o.k, seed), {}
    if init == "given":
        return degree.select("id").join(initial.repartition_labels(start, o.k - change, change, seed), "id", "left"), {}
    raise ValueError(f"no initialiser {init}")


def partition(edges: DataFrame, objective: lp.Objective, init: str | Sampling = "hub", seed: int = 1, limit: int = 290, window: int = 3, threshold: float = 0.001, start: DataFrame | None = None, change: int = 0) -> Result:
    """Partition directed edges into objective.k parts.

    init: ``uniform``, ``hub``, ``given`` (labels start, with change parts more or fewer: objective.k counts the
    parts after it) or a Sampling. Vertices act only if a neighbour moved in the step before."""
    with scratch(edges.sparkSession):
        return _partition(edges, objective, init, seed, limit, window, threshold, start, change)


def _partition(edges: DataFrame, o: lp.Objective, init, seed: int, limit: int, window: int, threshold: float, start: DataFrame | None, change: int) -> Result:
    began, k = time.time(), o.k
    sym = kept(both_ways(dedup(edges)), "lp-sym")
    degree = cut(degrees(sym), "lp-deg")
    e, s, v = degree.agg(F.sum("out_deg"), F.sum("sym_deg"), F.count(F.lit(1))).first()
    e, s = e or 0, s or 0
    capacity = o.capacity(e, s, v)
    labels, facts = _first_labels(sym, degree, o, init, seed, e, v, start, change)
    # Labelled vertices tell their neighbours; the counts begin there.
    zero = [F.lit(0).cast("long").alias(c) for c in lp.count_columns(k)]
    state = labels.join(degree.select("id", *lp.DEGREES), "id").select("id", "part", *lp.DEGREES, F.lit(True).alias("heard"), *zero)
    told = lp.count_changes(sym, labels.filter("part IS NOT NULL").select("id", F.lit(None).cast("int").alias("old"), F.col("part").alias("new")), k, v, o.weight, o.directed)
    state = cut(lp.with_changes(state, told, k, v).withColumn("heard", F.lit(True)), "lp-init")
    heard = sum(F.col(f"s{i}") for i in range(k)).alias("labelled"), F.col("out_deg" if o.directed else "sym_deg").alias("real_total")
    rows = lambda st: st.withColumnRenamed("part", "cur").select("*", *heard)
    messages, first_loads = 0, _sums(o, state)[0]
    if init != "uniform" and not state.filter("part IS NULL").isEmpty():
        chosen = lp.choice(o, rows(state), first_loads, capacity, v, seed, 0, labelled_only=True)
        state = _moved(sym, o, chosen.withColumn("part", F.coalesce("nxt", "cur", F.floor(lp.uniform(seed, 0, "left", F.col("id")) * k).cast("int"))), v, v, state, "lp-first").withColumn("heard", F.lit(True))
        first_loads = _sums(o, state.drop("moved", "h_cur"))[0]
    first, history, moves, steps, total, loads = time.time(), deque(maxlen=window), 0, 0, 0.0, first_loads
    for step in range(1, limit + 1):
        chosen = lp.choice(o, rows(state), loads, capacity, v, seed, step).persist()  # read three times; a lost part is computed again from the state
        wanted = lp.demand(o, chosen).collect()  # at most k
        chance = lp.chances(loads, {r.label: r.demand for r in wanted}, capacity)
        state = _moved(sym, o, lp.admit(chosen, chance, seed, step, [*lp.DEGREES, *lp.count_columns(k)]), v, sum(r.requests for r in wanted), state, "lp")
        chosen.unpersist()
        loads, n, sent, total = _sums(o, state)
        moves, steps, messages = moves + n, step, messages + sent
        if len(history) == window and max(history) > 0 and abs(1 - total / max(history)) < threshold or not n:
            break
        history.append(total)
    labels = kept(state.select("id", "part"), "lp-labels")
    end = time.time()
    spark = edges.sparkSession
    sampling, cycles, asks = facts.get("Sampling time", 0), facts.get("SAMPLING CYCLES", 0), facts.get("SAMPLING MESSAGES", 0)
    lp_time, start_of_lp = int((end - first) * 1000), 3 + 3 * cycles
    facts = {
        "JOB ID": spark.sparkContext.applicationId, "JOB NAME": f"partition {o.kind}", "WORKERS": spark.sparkContext.defaultParallelism, "ALGORITHM": init.kind if isinstance(init, Sampling) else init, "OBJECTIVE": o.kind,
        "VERTICES": v, "REAL EDGES": e, "VIRTUAL EDGES": s, "PARITIONS": k, "REAL SCORE": total, "SAMPLING START": 2, "SAMPLING END": 2 + 3 * cycles, "SAMPLING CYCLES": cycles, "SAMPLING EXTRA": 0,
        "LP START": start_of_lp, "LP END": start_of_lp + 2 * steps - 1, "LP CYCLES": steps, "TOT MIGRATIONS": moves, "INITIAL MESSAGES": e, "SAMPLING MESSAGES": asks, "LP MESSAGES": messages, "SHUTDOWN MESSAGES": 0, "TOTAL MESSAGES": e + asks + messages,
        "Initializing algorithm time": int((first - began) * 1000) - sampling, "LP time": lp_time, "Avg. LP cycle time": lp_time // max(1, steps), "Sampling time": sampling, "TOTAL TIME": int((end - began) * 1000),
        "OUT DEGREE THRESHOLD": initial.hub_threshold(e, v) if init == "hub" else 0, "BETA": init.beta if isinstance(init, Sampling) else "", "SIGMA": init.sigma if isinstance(init, Sampling) else "", "TAU": init.tau if isinstance(init, Sampling) else "", "SAMPLING_ERROR": False,
    } | facts
    return Result(labels, sym, facts)


def _moved(sym: DataFrame, o: lp.Objective, admitted: DataFrame, vertices: int, most: int, old: DataFrame, tag: str) -> DataFrame:
    """The state after admitted(id, cur, part, h_cur, ...): counts follow the at most so many vertices that moved. old goes."""
    k, moved = o.k, F.coalesce(F.col("part") != F.col("cur"), F.col("part").isNotNull())
    admitted = admitted.select("id", "part", F.col("cur").alias("old"), moved.alias("moved"), "h_cur", *lp.DEGREES, F.lit(False).alias("heard"), *lp.count_columns(k))
    changes = admitted.filter("moved").select("id", "old", F.col("part").alias("new"))
    state = cut(lp.with_changes(admitted.drop("old"), lp.count_changes(sym, changes, k, most, o.weight, o.directed), k, vertices), tag)
    discard(old)
    return state
