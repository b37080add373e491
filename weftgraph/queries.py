"""Queries over the test tables' graphs and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fixtures, format_queries
from .graph import dedup, degrees, symmetrize, vertices
from .operators import components, convert, deadlock, paths, ranks, triangles
from .operators import degrees as deg
from .partition import initial, loop, quality, sampling
from .partition import propagation as lp
from .plans.bsp import cut, discard, leaves_result
from .sources import readers

K = 4
EDGE, VERTEX, BASELINE = (lp.Objective(kind, K) for kind in ("edge", "vertex", "baseline"))


def _supply(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Symmetric edges, written once, and the labels id mod K."""
    sym = cut(symmetrize(fixtures.supply(spark, sf_dir)), "q-sym")
    return sym, fixtures.labels_mod(sym.select(F.col("src").alias("id")).distinct(), K)


def _r(df: DataFrame, *columns: str, places: int = 9) -> DataFrame:
    return df.withColumns({c: F.round(c, places) for c in columns})


def quality_partition_loads(s, d):
    return quality.part_stats(*_supply(s, d), K).select("part", "vertices", "real_load", "sym_load")


def quality_edge_cut(s, d):
    return _r(quality.cuts(quality.part_stats(*_supply(s, d), K)), "cut_real_share", "local_real_share", "cut_sym_share", "local_sym_share")


def quality_comm_volume(s, d):
    return _r(quality.communication(quality.part_stats(*_supply(s, d), K)), "cv_real_share", "cv_sym_share")


def quality_balance_ratios(s, d):
    b = quality.balance(quality.part_stats(*_supply(s, d), K).filter("vertices > 0"), K)
    return _r(b, *b.columns)


def quality_jsd(s, d):
    x = quality.divergences(quality.with_average_degree(quality.part_stats(*_supply(s, d), K)), ["real_load", "sym_load", "vertices", "avg_real", "avg_sym"], K)
    return _r(x.select("measure", "jsd"), "jsd")


def quality_kl(s, d):
    x = quality.divergences(quality.with_average_degree(quality.part_stats(*_supply(s, d), K)), ["real_load", "sym_load", "vertices", "avg_real", "avg_sym"], K)
    return _r(x.select("measure", "kl_log_k", "kl_abs"), "kl_log_k", "kl_abs")


def quality_avg_degree(s, d):
    return _r(quality.with_average_degree(quality.part_stats(*_supply(s, d), K)).select("part", "avg_real", "avg_sym"), "avg_real", "avg_sym")


def out_degree(s, d):
    return deg.out_degree(fixtures.supply(s, d))


def in_degree(s, d):
    return deg.in_degree(fixtures.supply(s, d))


def graph_totals(s, d):
    return deg.totals(fixtures.supply(s, d))


def degree_distribution(s, d):
    return deg.degree_distribution(fixtures.supply(s, d))


def out_degree_freq_capped(s, d):
    return deg.out_degree_frequency(fixtures.user_flow(s, d))


def symmetrize_flow(s, d):
    return symmetrize(fixtures.user_flow(s, d))


def reverse_duplicate(s, d):
    return convert.with_reverse(fixtures.user_flow(s, d))


def dedup_edges(s, d):
    li = s.read.parquet(f"{d}/lineitem.parquet")
    return dedup(li.select(F.col("l_suppkey").alias("src"), (F.col("l_partkey") + fixtures.PART_OFFSET).alias("dst")))


def adjacency_export(s, d):
    return convert.adjacency(fixtures.user_flow(s, d))


def adjacency_partitioned(s, d):
    sym = symmetrize(fixtures.user_flow(s, d))
    return convert.partitioned_adjacency(sym, fixtures.labels_mod(vertices(sym), K))


def adjacency_real_only(s, d):
    sym = symmetrize(fixtures.user_flow(s, d))
    return convert.partitioned_adjacency(sym, fixtures.labels_mod(vertices(sym), K), real_only=True, plain_neighbours=True)


def ring_generator(s, d):
    return readers.ring(s, 1000)[1]


def ring_vertices(s, d):
    return readers.ring(s, 1000)[0]


def combiner_sum(s, d):
    return deg.combine_messages(fixtures.weighted(fixtures.supply(s, d)))


def message_delivery(s, d):
    return deg.deliver_messages(fixtures.weighted(fixtures.supply(s, d)))


def aggregate_overwrite(s, d):
    return deg.overwrite(fixtures.weighted(fixtures.supply(s, d)), "src", "dst", "value")


def aggregate_map_merge(s, d):
    """Degree histograms of the vertices of each label, merged."""
    e = fixtures.supply(s, d)
    maps = deg.out_degree(e).groupBy((F.col("id") % K).alias("part"), "out_degree").count().groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("out_degree", "count"))).alias("m"))
    return deg.merge_maps(maps, "m")


def identity(s, d):
    return convert.identity(fixtures.user_flow(s, d))


def aggregate_kinds(s, d):
    return deg.aggregate_kinds(fixtures.weighted(fixtures.supply(s, d)), "src", "value")


def mutate_add_remove(s, d):
    e = fixtures.user_flow(s, d)
    added = convert.add_edges(e, e.select(F.col("dst").alias("src"), (F.col("src") + 1_000_000).alias("dst")).filter("src % 5 = 0"))
    fewer = convert.remove_edges(added, e.filter("(src + dst) % 7 = 0"))
    return convert.remove_vertices(vertices(added), fewer, vertices(added).filter("id % 11 = 0"))[1]


def mutate_vertices(s, d):
    e = fixtures.user_flow(s, d)
    return convert.remove_vertices(vertices(e), e, vertices(e).filter("id % 11 = 0"))[0]


def _shown(df: DataFrame, *columns: str) -> DataFrame:
    """Unassigned as -1."""
    return df.withColumns({c: F.coalesce(c, F.lit(-1)) for c in columns})


def reset_labels(s, d):
    return _shown(convert.reset_labels(fixtures.labels_mod(vertices(fixtures.user_flow(s, d)), K)), "part")


def friends_list(s, d):
    return convert.friends(fixtures.user_flow(s, d).filter("src <> dst")).select("src", "dst", F.array_join("friends", ",").alias("friends"))


def placement_hash(s, d):
    return convert.place_by_hash(vertices(fixtures.supply(s, d)), 16, 3)


def placement_label(s, d):
    return convert.place_by_label(fixtures.labels_mod(vertices(fixtures.supply(s, d)), K), 3)


def pagerank_simple(s, d):
    return _r(ranks.pagerank(fixtures.supply(s, d)), "rank")


def pagerank_walk(s, d):
    return _r(ranks.random_walk(fixtures.supply(s, d))[0], "rank")


def rwr(s, d):
    e = fixtures.user_flow(s, d)
    return _r(ranks.random_walk(e, sources=vertices(e).filter("id % 10 = 1"))[0], "rank")


def connected_components(s, d):
    return components.connected_components(fixtures.orders_chain(s, d))


def connected_components_geo(s, d):
    return components.connected_components(fixtures.geo(s, d))


def sssp(s, d):
    e = fixtures.weighted(fixtures.orders_chain(s, d))
    return paths.shortest_paths(e, 1, "value")


def sssp_hops(s, d):
    return paths.shortest_paths(convert.with_reverse(fixtures.supply(s, d)), 1)


def max_propagation(s, d):
    return paths.max_propagation(fixtures.geo(s, d))


def triangle_closing(s, d):
    return triangles.triangle_closing(fixtures.user_flow(s, d))


def clustering_coefficient(s, d):
    return _r(triangles.clustering_coefficient(cut(symmetrize(fixtures.user_flow(s, d)), "q-sym")), "cc")


def cc_histogram(s, d):
    return triangles.cc_histogram(triangles.clustering_coefficient(cut(symmetrize(fixtures.user_flow(s, d)), "q-sym")))


def topk_neighbors(s, d):
    return triangles.top_neighbours(cut(symmetrize(fixtures.user_flow(s, d)), "q-sym"), 3)


def init_uniform(s, d):
    return initial.uniform_labels(vertices(fixtures.supply(s, d)), K)


def _hub(s, d):
    sym, _ = _supply(s, d)
    g = cut(degrees(sym), "q-deg")
    e, n = g.agg(F.sum("out_deg"), F.count(F.lit(1))).first()
    return sym, g, initial.hub_labels(g, K, initial.hub_threshold(e, n)), (e, n)


def init_hub(s, d):
    return _shown(_hub(s, d)[2], "part")


def repartition_grow(s, d):
    return initial.repartition_labels(_supply(s, d)[1], K, 2)


def repartition_shrink(s, d):
    return initial.repartition_labels(_supply(s, d)[1], K, -2)


def seeds_hd(s, d):
    return initial.highest_degree_seeds(symmetrize(fixtures.supply(s, d)), 0.05)


def seeds_cc(s, d):
    return initial.clustering_seeds(triangles.clustering_coefficient(cut(symmetrize(fixtures.user_flow(s, d)), "q-sym")), 0.05)


def seeds_gd_prob(s, d):
    return _r(initial.distribution_probabilities(symmetrize(fixtures.supply(s, d)), 0.05), "p", "seed_p", "spread_p")


def seeds_rd(s, d):
    return initial.random_seeds(symmetrize(fixtures.supply(s, d)), 0.05)


def lp_label_histogram(s, d):
    return lp.histogram(*_supply(s, d))


def lp_label_histogram_weighted(s, d):
    return lp.histogram(*_supply(s, d), weight=2)


def _first(s, d, o):
    sym, labels = _supply(s, d)
    g = cut(degrees(sym), "q-deg")
    e, m, n = g.agg(F.sum("out_deg"), F.sum("sym_deg"), F.count(F.lit(1))).first()
    state = labels.join(g.select("id", *lp.DEGREES), "id")
    return lp.label_counts(sym, state, K), state, loop.loads_of(o, state)[0], o.capacity(e, m, n), n


def _scores(s, d, o):
    counts, _, loads, capacity, n = _first(s, d, o)
    return _r(lp.scores(o, counts, loads, capacity, n), "score")


def lp_score_edge(s, d):
    return _scores(s, d, EDGE)


def lp_score_vertex(s, d):
    return _scores(s, d, VERTEX)


def lp_score_baseline(s, d):
    return _scores(s, d, BASELINE)


def _chosen(s, d, o=EDGE):
    counts, state, loads, capacity, n = _first(s, d, o)
    return cut(lp.choose(o, counts, state, loads, capacity, n, 1, 1), "q-choice"), loads, capacity


def lp_argmax(s, d):
    return _chosen(s, d)[0].select("id", "cur", "nxt")


def lp_demand(s, d):
    return lp.demand(EDGE, _chosen(s, d)[0])


def _admitted(s, d):
    chosen, loads, capacity = _chosen(s, d)
    wanted = {r.label: r.demand for r in lp.demand(EDGE, chosen).collect()}
    return lp.admit(chosen, lp.chances(loads, wanted, capacity), 1, 1)


def lp_admission(s, d):
    return _admitted(s, d).select("id", "nxt", "moved")


def lp_migrate(s, d):
    return _admitted(s, d).select("id", "cur", "part")


def _first_partition(s, d):
    sym, g, labels, (e, n) = _hub(s, d)
    m = g.agg(F.sum("sym_deg")).first()[0]
    loads = loop.loads_of(EDGE, labels.join(g.select("id", *lp.DEGREES), "id"))[0]
    return lp.choose(EDGE, lp.label_counts(sym, labels, K), labels, loads, EDGE.capacity(e, m, n), n, 1, 0, labelled_only=True)


def lp_first_partition(s, d):
    return _shown(_first_partition(s, d).select("id", "cur", "nxt"), "cur", "nxt")


def lp_first_migration(s, d):
    return lp.first_migration(_first_partition(s, d), K, 1)


def _partition(s, d, objective, init):
    return loop.partition(fixtures.supply(s, d), objective, init).labels


def partition_edge(s, d):
    return _partition(s, d, EDGE, "hub")


def partition_vertex(s, d):
    return _partition(s, d, VERTEX, "hub")


def partition_baseline(s, d):
    return _partition(s, d, BASELINE, "uniform")


def partition_hybrid(s, d):
    return _partition(s, d, BASELINE, "hub")


def partition_sampled(s, d):
    return _partition(s, d, EDGE, sampling.Sampling("rd"))


def partition_regrow(s, d):
    e = fixtures.supply(s, d)
    start = fixtures.labels_mod(vertices(e), K)
    return loop.partition(e, lp.Objective("edge", K + 2), "given", start=start, change=2).labels


def _steps(s, d, objective, init, limit, **more):
    return loop.partition(fixtures.supply(s, d), objective, init, limit=limit, **more).labels


def partition_edge_cycles(s, d):
    """The first two cycles, which SQL can follow; likewise the others."""
    return _steps(s, d, EDGE, "hub", 2)


def partition_vertex_cycles(s, d):
    return _steps(s, d, VERTEX, "hub", 2)


def partition_baseline_cycles(s, d):
    return _steps(s, d, BASELINE, "uniform", 3)


def partition_hybrid_cycles(s, d):
    return _steps(s, d, BASELINE, "hub", 2)


def partition_weighted_cycles(s, d):
    """Real edges count twice and the graph is undirected."""
    return _steps(s, d, lp.Objective("edge", K, weight=2, directed=False), "uniform", 2)


def partition_regrow_cycles(s, d):
    start = fixtures.labels_mod(vertices(fixtures.supply(s, d)), K)
    return _steps(s, d, lp.Objective("edge", K + 2), "given", 2, start=start, change=2)


def partition_report(s, d):
    sym, labels = _supply(s, d)
    return quality.report(sym, labels, K, {"ALGORITHM": "given"})


def _sample(s, d, kind):
    sym = cut(symmetrize(fixtures.user_flow(s, d)), "q-sym")
    return sampling.sample(sym, sampling.Sampling(kind, cycles=6), K)[0]


def sample_rd(s, d):
    return _sample(s, d, "rd")


def sample_hd(s, d):
    return _sample(s, d, "hd")


def sample_cc(s, d):
    return _sample(s, d, "cc")


def sample_gd(s, d):
    return _sample(s, d, "gd")


def deadlock_detection(s, d):
    """Customers wait for nations, nations for regions, the regions 0 and 1 for their even nations, and 99 for all nations."""
    e = fixtures.geo(s, d).withColumn("tag", F.col("src") % 3)
    nation = s.read.parquet(f"{d}/nation.parquet").select((F.col("n_nationkey") + 100).cast("long").alias("id"), F.col("n_regionkey").cast("long").alias("region"))
    back = nation.filter("region < 2 AND id % 2 = 0").select(F.col("region").alias("src"), F.col("id").alias("dst"), F.lit(0).cast("long").alias("tag"))
    every = nation.select(F.lit(99).cast("long").alias("src"), F.col("id").alias("dst"), (F.col("id") % 3).alias("tag"))
    return deadlock.deadlock(e.unionByName(back).unionByName(every), 99)


def master_accumulate(s, d):
    """A value the driver keeps adds step / 2 + 1 each superstep; what it is before each."""
    total, rows = 0.0, []
    for step in range(11):
        rows.append((step, total))
        total += step / 2 + 1
    return s.createDataFrame(rows, "step int, total double")


def checkpoint_supersteps(s, d):
    """Six supersteps that change vertex and edge values, each written and read back."""
    v, e = readers.ring(s, 10)
    v, e = v.select("id", F.col("id").alias("value")), e.select("src", "dst", F.lit(0.0).alias("w"))
    for _ in range(6):
        e = cut(e.join(v.select(F.col("id").alias("src"), "value"), "src").select("src", "dst", (F.col("w") + F.col("value")).alias("w")), "ck-e")
        got = e.groupBy(F.col("dst").alias("id")).agg(F.sum("w").alias("got"))
        v = cut(v.join(got, "id", "left").select("id", (F.col("value") + F.coalesce("got", F.lit(0.0)).cast("long")).alias("value")), "ck-v")
    return v


QUERIES = {
    name: leaves_result(f)
    for name, f in {**globals(), **format_queries.QUERIES}.items()
    if callable(f) and getattr(f, "__module__", "") in (__name__, format_queries.__name__) and not name.startswith("_")
}
