"""Partition quality: one pass over the labelled edges gives k rows, the rest is arithmetic on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import entropy_term


def vertex_stats(sym: DataFrame, labels: DataFrame, k: int) -> DataFrame:
    """By vertex: part, out_deg, sym_deg, local edges and distinct foreign parts (at most k) of both kinds."""
    e = sym.join(labels.select(F.col("id").alias("dst"), F.col("part").alias("pd")), "dst")
    real = ~F.col("is_virtual")
    g = e.groupBy("src").agg(
        F.count(F.lit(1)).alias("sym_deg"), F.sum(real.cast("long")).alias("out_deg"),
        F.collect_set("pd").alias("parts"), F.collect_set(F.when(real, F.col("pd"))).alias("real_parts"),
        *[F.sum((F.col("pd") == i).cast("long")).alias(f"s{i}") for i in range(k)], *[F.sum((real & (F.col("pd") == i)).cast("long")).alias(f"r{i}") for i in range(k)],
    )
    own = lambda kind: F.element_at(F.array(*[F.col(f"{kind}{i}") for i in range(k)]), F.col("part") + 1)
    foreign = lambda parts: (F.size(parts) - F.array_contains(parts, F.col("part")).cast("int")).cast("long")
    return g.join(labels.select(F.col("id").alias("src"), "part"), "src").select(
        F.col("src").alias("id"), "part", "out_deg", "sym_deg", own("r").alias("local_real"), own("s").alias("local_sym"), foreign("real_parts").alias("cv_real"), foreign("parts").alias("cv_sym")
    )


def part_stats(sym: DataFrame, labels: DataFrame, k: int) -> DataFrame:
    """k rows: part, vertices, loads, local edges, communication volumes and their bounds; empty parts too."""
    v = vertex_stats(sym, labels, k)
    names = ("vertices", "real_load", "sym_load", "local_real", "local_sym", "cv_real", "cv_sym", "cv_real_max", "cv_sym_max")
    sums = v.groupBy("part").agg(
        F.count(F.lit(1)).alias("vertices"), F.sum("out_deg").alias("real_load"), F.sum("sym_deg").alias("sym_load"), F.sum("local_real").alias("local_real"), F.sum("local_sym").alias("local_sym"),
        F.sum("cv_real").alias("cv_real"), F.sum("cv_sym").alias("cv_sym"), F.sum(F.least(F.lit(k), F.col("out_deg"))).alias("cv_real_max"), F.sum(F.least(F.lit(k), F.col("sym_deg"))).alias("cv_sym_max"),
    )
    every = labels.sparkSession.range(k).select(F.col("id").cast("int").alias("part"))
    return every.join(sums, "part", "left").na.fill(0, list(names))


def max_norm(x: Column, k: int, expected: Column | None = None) -> Column:
    return F.max(x) / (expected if expected is not None else F.sum(x) / k)


def max_min(x: Column) -> Column:
    return F.max(x) / F.min(x)


def _ratio(c: str, stats: DataFrame) -> DataFrame:
    return stats.withColumn("_p", F.col(c) / F.sum(c).over(_all()))


def _all():
    from pyspark.sql import Window

    return Window.partitionBy()  # over k rows


def divergences(stats: DataFrame, columns: list[str], k: int) -> DataFrame:
    """measure, jsd, kl_log_k, kl_abs: Jensen-Shannon and Kullback-Leibler divergence from uniform.

    kl_log_k is divided by ln k; kl_abs is the plain absolute value; both are -1 if a part is empty."""
    long = stats.select(F.explode(F.array(*[F.struct(F.lit(c).alias("measure"), F.col(c).cast("double").alias("x")) for c in columns])).alias("m")).select("m.*")
    from pyspark.sql import Window

    p = F.col("x") / F.sum("x").over(Window.partitionBy("measure"))
    long = long.withColumn("p", p)
    u = F.lit(1.0 / k)
    m = (F.col("p") + u) / 2
    out = long.groupBy("measure").agg(F.sum(entropy_term(F.col("p"), m) + entropy_term(u, m)).alias("j"), F.sum(entropy_term(F.col("p"), u)).alias("d"), F.min("p").alias("least"))
    empty = F.col("least") <= 0
    log_k = F.lit(float(k))
    return out.select("measure", (F.col("j") / (2 * F.log(F.lit(2.0)))).alias("jsd"), F.when(empty, -1.0).otherwise(F.col("d") / F.log(log_k)).alias("kl_log_k"), F.when(empty, -1.0).otherwise(F.abs("d")).alias("kl_abs"))


def with_average_degree(stats: DataFrame) -> DataFrame:
    """stats and the average degrees of each part, 0 for an empty one."""
    per = lambda c: F.when(F.col("vertices") > 0, F.col(c) / F.col("vertices")).otherwise(0.0)
    return stats.withColumn("avg_real", per("real_load")).withColumn("avg_sym", per("sym_load"))


def balance(stats: DataFrame, k: int) -> DataFrame:
    """One row: largest over expected and largest over smallest load, for edges, vertices and average degrees."""
    s = with_average_degree(stats)
    c = F.col
    return s.agg(
        max_norm(c("real_load"), k).alias("edge_max_norm"), max_min(c("real_load")).alias("edge_max_min"),
        max_norm(c("sym_load"), k).alias("sym_max_norm"), max_min(c("sym_load")).alias("sym_max_min"),
        max_norm(c("vertices"), k).alias("vertex_max_norm"), max_min(c("vertices")).alias("vertex_max_min"),
        max_norm(c("avg_real"), k, F.sum("real_load") / F.sum("vertices")).alias("avg_max_norm"), max_min(c("avg_real")).alias("avg_max_min"),
        max_norm(c("avg_sym"), k, F.sum("sym_load") / F.sum("vertices")).alias("avg_sym_max_norm"), max_min(c("avg_sym")).alias("avg_sym_max_min"),
    )


def cuts(stats: DataFrame) -> DataFrame:
    """One row: local and cut edges of both kinds with their shares."""
    s = stats.agg(*[F.sum(c).alias(c) for c in ("real_load", "sym_load", "local_real", "local_sym")])
    return s.select(
        "local_real", (F.col("real_load") - F.col("local_real")).alias("cut_real"), ((F.col("real_load") - F.col("local_real")) / F.col("real_load")).alias("cut_real_share"), (F.col("local_real") / F.col("real_load")).alias("local_real_share"),
        "local_sym", (F.col("sym_load") - F.col("local_sym")).alias("cut_sym"), ((F.col("sym_load") - F.col("local_sym")) / F.col("sym_load")).alias("cut_sym_share"), (F.col("local_sym") / F.col("sym_load")).alias("local_sym_share"),
    )


def communication(stats: DataFrame) -> DataFrame:
    """One row: communication volumes, their upper bounds and shares."""
    s = stats.agg(*[F.sum(c).alias(c) for c in ("cv_real", "cv_sym", "cv_real_max", "cv_sym_max")])
    return s.select("cv_real", "cv_real_max", (F.col("cv_real") / F.col("cv_real_max")).alias("cv_real_share"), "cv_sym", "cv_sym_max", (F.col("cv_sym") / F.col("cv_sym_max")).alias("cv_sym_share"))


#: Lines of a run report in their order, as fixed values of its format; an empty one is a blank line.
JOB = ("JOB ID", "JOB NAME", "WORKERS", "ALGORITHM", "GRAPH", "VERTICES", "REAL EDGES", "VIRTUAL EDGES", "PARITIONS", "REAL LOADS", "VIRTUAL LOADS", "VIRTUAL COUNTS", "REAL KLU", "VIRTUAL KLU", "VIRTUAL COUNT KLU", "REAL AVGD KLU", "VIRTUAL AVGD KLU", "")
REAL = (
    "REAL E MAXNORMLOAD", "REAL E MAXMINLOAD", "REAL EB JSD", "REAL E KLU", "REAL V MAXNORMLOAD", "REAL V MAXMINLOAD", "REAL VB JSD", "REAL V KLU", "REAL AVGD MAXNORM", "REAL AVGD MAXMIN", "REAL AVGDB JSD", "REAL AVGD KLU",
    "REAL EC PCT", "REAL COMMVOL PCT", "REAL LOCE PCT", "REAL EC", "REAL COMMVOL", "REAL LOCE", "REAL COMMVOL NORMF", "REAL SCORE",
)
VIRTUAL = (
    "VIRTUAL E MAXNORM LOAD", "VIRTUAL E MAXMIN LOAD", "VIRTUAL ED JSD", "VIRTUAL E KLU", "VIRTUAL V MAXNORM LOAD", "VIRTUAL V MAXMIN LOAD", "VIRTUAL VB JSD", "VIRTUAL V KLU", "VIRTUAL AVGD MAXNORM", "VIRTUAL AVGD MAXMIN", "VIRTUAL AVGDB JSD", "VIRTUAL AVGD KLU",
    "VIRTUAL EC PCT", "VIRTUAL COMMVOL PCT", "VIRTUAL LOCE PCT", "VIRTUAL EC", "VIRTUAL COMMVOL", "VIRTUAL LOCE", "VIRTUAL COMMVOL NORMF",
)
RUN = (
    "", "SAMPLING START", "SAMPLING END", "SAMPLING CYCLES", "SAMPLING EXTRA", "LP START", "LP END", "LP CYCLES", "TOT MIGRATIONS", "", "INITIAL MESSAGES", "SAMPLING MESSAGES", "LP MESSAGES", "SHUTDOWN MESSAGES", "TOTAL MESSAGES", "",
    "INPUT TIME (not included in total)", "INITIALIZE TIME", "SETUP TIME", "Initializing algorithm time", "LP time", "Avg. LP cycle time", "Sampling time", "Avg. Sampling cycle time", "TOTAL TIME", "OUT DEGREE THRESHOLD", "BETA", "SIGMA", "TAU", "SAMPLING_ERROR",
)
LINES = (*JOB, *REAL, *VIRTUAL, *RUN)


def report(sym: DataFrame, labels: DataFrame, k: int, facts: dict | None = None) -> DataFrame:
    """line, metric, value (strings) of a run report's 87 lines; facts tell of the run (algorithm, times, messages, parameters)."""
    stats = with_average_degree(part_stats(sym, labels, k)).orderBy("part").collect()  # k rows
    spark = sym.sparkSession
    kept = spark.createDataFrame(stats)
    b, c, v = balance(kept, k).first(), cuts(kept).first(), communication(kept).first()
    d = {r.measure: r for r in divergences(kept, ["real_load", "sym_load", "vertices", "avg_real", "avg_sym"], k).collect()}
    joined = lambda f: "".join(f"{s[f]}_" for s in stats)
    three, six, long = "{:.3f}".format, "{:.6f}".format, "{:.8f}".format
    values: dict[tuple[int, str], str] = {}

    def put(names: tuple[str, ...], first: int, found: list) -> None:
        values.update(((first + i, n), str(x)) for i, (n, x) in enumerate(zip(names, found, strict=True)))

    facts = facts or {}
    put(JOB[5:17], 5, [sum(s.vertices for s in stats), sum(s.real_load for s in stats), sum(s.sym_load for s in stats), k, joined("real_load"), joined("sym_load"), joined("vertices"),
        *(long(d[m].kl_log_k) for m in ("real_load", "sym_load", "vertices")), *(long(d[m].kl_abs) for m in ("avg_real", "avg_sym"))])
    for names, first, load, e, avg, s in ((REAL, len(JOB), "real_load", "edge", "avg", "real"), (VIRTUAL, len(JOB) + len(REAL), "sym_load", "sym", "avg_sym", "sym")):
        put(names[:19], first, [
            three(b[f"{e}_max_norm"]), three(b[f"{e}_max_min"]), six(d[load].jsd), six(d[load].kl_log_k), three(b.vertex_max_norm), three(b.vertex_max_min), six(d["vertices"].jsd), six(d["vertices"].kl_log_k),
            three(b[f"{avg}_max_norm"]), three(b[f"{avg}_max_min"]), six(d[f"avg_{s}"].jsd), six(d[f"avg_{s}"].kl_abs), three(c[f"cut_{s}_share"]), three(v[f"cv_{s}_share"]), three(c[f"local_{s}_share"]),
            c[f"cut_{s}"], v[f"cv_{s}"], c[f"local_{s}"], v[f"cv_{s}_max"],
        ])
    rows = [(i, n, values[i, n] if (i, n) in values else str(facts.get(n, "")) if n else None) for i, n in enumerate(LINES)]
    return spark.createDataFrame(rows, "line int, metric string, value string").orderBy("line")
