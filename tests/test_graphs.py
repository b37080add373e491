"""Small graphs with known answers, invariants, published load vectors."""

import random

import pytest
from pyspark.sql import functions as F

from weftgraph.graph import degrees, symmetrize, validate, vertices
from weftgraph.operators import components, convert, deadlock, paths, ranks, triangles
from weftgraph.partition import initial, loop, quality
from weftgraph.partition import propagation as lp
from weftgraph.partition.sampling import Sampling, sample_labels


def graph(spark, pairs, columns="src long, dst long"):
    return spark.createDataFrame(pairs, columns)


def as_dict(df):
    return {r[0]: r[1] for r in df.collect()}


def test_symmetric_edges(spark):
    loop_ = graph(spark, [(1, 1), (1, 2)])
    assert sorted(map(tuple, symmetrize(loop_).collect())) == [(1, 1, False), (1, 2, False), (2, 1, True)]
    assert symmetrize(graph(spark, [(1, 2), (2, 1)])).filter("is_virtual").count() == 0
    assert as_dict(vertices(graph(spark, [(1, 9)])).withColumn("x", F.lit(0))).keys() == {1, 9}
    d = {r.id: (r.out_deg, r.in_deg, r.sym_deg) for r in degrees(symmetrize(graph(spark, [(1, 9), (2, 9), (9, 2)]))).collect()}
    assert d == {1: (1, 0, 1), 2: (1, 1, 1), 9: (1, 2, 2)}
    with pytest.raises(ValueError):
        validate(spark.createDataFrame([("a", "b")], "src string, dst string"))


def test_components_paths_and_maxima(spark):
    path = graph(spark, [(1, 2), (2, 3), (3, 4), (10, 11)])
    assert as_dict(components.connected_components(path)) == {1: 1, 2: 1, 3: 1, 4: 1, 10: 10, 11: 10}
    found = as_dict(paths.shortest_paths(path, 1))
    assert found[4] == 3 and found[10] == paths.UNREACHED
    long_path = graph(spark, [(i, i + 1) for i in range(200)])
    assert set(as_dict(components.connected_components(long_path)).values()) == {0}
    rng = random.Random(1)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)]
    label = {v: v for p in pairs for v in p}
    for _ in range(300):
        for x, y in pairs:
            label[x] = label[y] = min(label[x], label[y])
    assert as_dict(components.connected_components(graph(spark, pairs))) == label
    assert as_dict(paths.max_propagation(graph(spark, [(1, 2), (1, 3), (2, 3), (3, 4)]))) == {1: 2, 2: 2, 3: 2, 4: 2}
    empty = graph(spark, [])
    assert components.connected_components(empty).count() == 0 and paths.shortest_paths(empty, 1).count() == 0


def test_clustering_by_definition(spark):
    rng = random.Random(3)
    pairs = {(rng.randrange(12), rng.randrange(12)) for _ in range(50)}
    near = {v: set() for v in range(12)}
    for a, b in pairs:
        near[a].add(b)
        near[b].add(a)
    got = {r.id: r.links for r in triangles.clustering_coefficient(symmetrize(graph(spark, sorted(pairs)))).collect()}
    assert got == {u: sum(len(near[u] & near[v]) for v in near[u]) for u in got}
    clique = [(a, b) for a in range(1, 5) for b in range(1, 5) if a != b]
    assert {r.cc for r in triangles.clustering_coefficient(symmetrize(graph(spark, clique))).collect()} == {1.0}


def test_triangle_closing(spark):
    e = graph(spark, [(1, 2), (1, 3), (4, 2), (4, 3), (2, 3)])
    assert [(r.id, r.candidate, r.common) for r in triangles.triangle_closing(e).orderBy("id").collect()] == [(2, 3, 2), (3, 2, 2)]
    assert [(r.id, r.candidate) for r in triangles.triangle_closing(e, exclude_existing=True).collect()] == [(3, 2)]


def test_walks(spark):
    e = graph(spark, [(1, 2), (2, 1), (2, 3), (3, 1)])
    r = as_dict(ranks.pagerank(e, 40))
    r2, steps = ranks.random_walk(e, 60)
    assert abs(sum(r.values()) - 1) < 0.02 and abs(sum(as_dict(r2).values()) - 1) < 1e-9 and steps < 60
    with pytest.raises(ValueError):
        ranks.random_walk(e, sources=spark.createDataFrame([(99,)], "id long"))


def test_mutation(spark):
    e = graph(spark, [(1, 2), (2, 3), (3, 1)])
    v, left = convert.remove_vertices(vertices(e), e, spark.createDataFrame([(2,)], "id long"))
    assert sorted(r.id for r in v.collect()) == [1, 3]
    assert sorted(map(tuple, left.collect())) == [(1, 2), (3, 1)]
    assert convert.add_edges(e, e).count() == 3
    assert convert.remove_edges(e, e).count() == 0


def test_deadlock(spark):
    t = "src long, dst long, tag long"
    ring = graph(spark, [(1, 2, 0), (2, 3, 0), (3, 1, 0)], t)
    assert not any(r.free for r in deadlock.deadlock(ring, 1).collect())
    out = {r.id: (r.notified, r.free) for r in deadlock.deadlock(graph(spark, [(1, 2, 0), (1, 3, 1), (2, 1, 0), (5, 1, 0)], t), 1).collect()}
    assert out == {1: (True, True), 2: (True, True), 3: (True, True), 5: (False, False)}
    both = {r.id: r.free for r in deadlock.deadlock(graph(spark, [(1, 2, 0), (1, 3, 0), (2, 1, 0)], t), 1).collect()}
    assert both == {1: False, 2: False, 3: True}


LOADS = [427998, 755261, 601051, 1203314]
COUNTS = [263480, 287152, 287062, 297196]


def test_published_vectors(spark):
    rows = [(i, n, m, m) for i, (n, m) in enumerate(zip(COUNTS, LOADS, strict=True))]
    s = quality.with_average_degree(spark.createDataFrame(rows, "part int, vertices long, real_load long, sym_load long"))
    b = quality.balance(s, 4).first()
    d = {r.measure: r for r in quality.divergences(s, ["real_load", "vertices", "avg_real"], 4).collect()}
    assert [round(x, 3) for x in (b.edge_max_norm, b.edge_max_min, b.vertex_max_norm, b.vertex_max_min, b.avg_max_norm, b.avg_max_min)] == [1.611, 2.811, 1.047, 1.128, 1.538, 2.493]
    assert [round(d[m].jsd, 6) for m in ("real_load", "vertices", "avg_real")] == [0.025512, 0.000350, 0.020828]
    assert [round(x, 6) for x in (d["real_load"].kl_log_k, d["vertices"].kl_log_k, d["avg_real"].kl_abs)] == [0.051513, 0.000696, 0.058575]


def test_empty_part(spark):
    sym = symmetrize(graph(spark, [(1, 2), (2, 3)]))
    stats = quality.with_average_degree(quality.part_stats(sym, spark.createDataFrame([(1, 0), (2, 0), (3, 1)], "id long, part int"), 3))
    d = quality.divergences(stats, ["vertices"], 3).first()
    assert d.kl_log_k == -1 and 0 < d.jsd < 1


def two_cliques(spark, n=12):
    return graph(spark, [(a + s, b + s) for s in (0, 100) for a in range(n) for b in range(n) if a != b] + [(0, 100)])


@pytest.mark.parametrize(("objective", "init"), [("edge", "hub"), ("edge", Sampling("rd", beta=0.3, sigma=0.2)), ("vertex", "uniform"), ("baseline", "hub")])
def test_partition_invariants(spark, objective, init):
    e = two_cliques(spark)
    r = loop.partition(e, lp.Objective(objective, 2, slack=0.2), init, limit=5)
    labels = r.labels.collect()
    assert len(labels) == 24 and {x.part for x in labels} <= {0, 1}
    stats = quality.part_stats(r.sym, r.labels, 2).collect()
    assert sum(s.vertices for s in stats) == 24 and sum(s.real_load for s in stats) == e.count()
    c = quality.cuts(quality.part_stats(r.sym, r.labels, 2)).first()
    assert c.local_real + c.cut_real == e.count()
    assert r.facts["LP CYCLES"] >= 1


def test_repartition(spark):
    labels = spark.createDataFrame([(i, i % 4) for i in range(400)], "id long, part int")
    grown = initial.repartition_labels(labels, 4, 2).groupBy("part").count().collect()
    assert {r.part for r in grown} == set(range(6)) and all(30 < r["count"] < 110 for r in grown)
    shrunk = as_dict(initial.repartition_labels(labels, 4, -2))
    assert set(shrunk.values()) == {0, 1} and all(shrunk[i] == i % 4 for i in range(400) if i % 4 < 2)


@pytest.mark.parametrize("kind", ["rd", "hd", "cc", "gd"])
def test_sampling_reaches_its_size(spark, kind):
    sym = symmetrize(two_cliques(spark, 30))
    labels, ok, _ = sample_labels(sym, Sampling(kind, beta=0.3, sigma=0.1), 3)
    named = labels.filter("part IS NOT NULL").collect()
    assert ok and len(named) >= 18 and {r.part for r in named} == {0, 1, 2}
