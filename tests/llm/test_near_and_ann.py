"""Near-duplicates and nearest neighbours against brute force."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftgraph.llm import ann, near_dedup


def shingles(text):
    w = (text or "").split()
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def jaccard(a, b):
    both = sum((a & b).values())
    return both / max(1, sum(a.values()) + sum(b.values()) - both)


def brute_classes(rows):
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    bags = [shingles(t) for _, t in rows]
    for a in range(len(rows)):
        for b in range(a):
            if bags[a] and bags[b] and rows[a][0] is not None and rows[b][0] is not None and jaccard(bags[a], bags[b]) >= 0.8:
                parent[find(a)] = find(b)
    groups = defaultdict(list)
    for k, (i, _) in enumerate(rows):
        groups[find(k)].append(i)
    return sorted(sorted(g, key=repr) for g in groups.values())


def corpus(n=60, copies=8, seed=0):
    """Texts of which some are changed copies at many degrees."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 8)))
    rows = []
    for i in range(n):
        w = [word() for _ in range(rng.randrange(6, 120))]
        rows.append(w)
        if i % 6 == 0:
            for _ in range(copies):
                c = list(w)
                for _ in range(rng.randrange(0, max(2, len(w) // 12))):
                    c[rng.randrange(len(c))] = word()
                rows.append(c)
    return [(k + 1, " ".join(w)) for k, w in enumerate(rows)]


def classes_of(df):
    out = defaultdict(list)
    for r in df.collect():
        out[r.class_id, None if r.class_id is not None else repr(r)].append(r.doc_id)
    return sorted(sorted(g, key=repr) for g in out.values())


def test_similarity_is_exact():
    rows = corpus(30)
    left, right = [t for _, t in rows[:-1]], [t for _, t in rows[1:]]
    want = [jaccard(shingles(a), shingles(b)) for a, b in zip(left, right, strict=True)]
    assert np.allclose(near_dedup.similarities(left, right), want)


def test_signatures_estimate_similarity():
    rng = random.Random(5)
    texts = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(n)) for n in (1, 3, 20, 200, 900)]
    half = [t.rsplit(" ", max(1, len(t.split()) // 2))[0] if " " in t else t for t in texts]
    s = near_dedup.dart_signatures(*near_dedup.elements_of(*near_dedup.words_of(texts + half)), k=600)
    none = np.uint64(2**64 - 1)
    assert (s != none).all()
    for k in range(5):
        want = jaccard(shingles(texts[k]), shingles(half[k]))
        assert abs((s[k] == s[k + 5]).mean() - want) < 0.08
    again = near_dedup.dart_signatures(*near_dedup.elements_of(*near_dedup.words_of([texts[3]])), k=600)
    assert (again[0] == s[3]).all()  # whatever stands beside it


def test_weights_count():
    a, b = "p q r s t " * 6, "p q r s t " * 5
    s = near_dedup.dart_signatures(*near_dedup.elements_of(*near_dedup.words_of([a, b])), k=2000)
    assert abs((s[0] == s[1]).mean() - jaccard(shingles(a), shingles(b))) < 0.05


def test_classes_by_brute_force(spark):
    rows = corpus()
    got = near_dedup.classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))
    assert classes_of(got) == brute_classes(rows)
    sizes = {r.class_id: r.class_size for r in got.collect()}
    assert sum(sizes.values()) == len(rows)


def test_blocks_by_brute_force(spark):
    """Groups in which hardly any two texts are linked, in blocks smaller than the groups."""
    rng = random.Random(11)
    rows = []
    for g in range(3):
        base = [f"g{g}w{k}" for k in range(100)]
        for i in range(60):
            c = list(base)
            for _ in range(rng.randrange(0, 5)):
                c[rng.randrange(100)] = f"x{g}-{i}-{rng.randrange(9)}"
            rows.append((1000 * g + i, " ".join(c)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_classes(rows)
    assert len(want) > 5
    for rounds, block in ((1, 8), (2, 1000), (1, 25)):
        assert classes_of(near_dedup.classes(df, rounds=rounds, block=block)) == want


def test_links_in_memory():
    rows = corpus(40)
    texts = [t for _, t in rows]
    bags = [shingles(t) for t in texts]
    i, j = near_dedup.linked(texts, 0.8)
    assert sorted(zip(i.tolist(), j.tolist(), strict=True)) == [(a, b) for a in range(len(texts)) for b in range(a + 1, len(texts)) if jaccard(bags[a], bags[b]) >= 0.8]


def test_large_group_of_near_copies(spark):
    rng = random.Random(9)
    base = [f"w{k}" for k in range(150)]
    rows = [(0, " ".join(base))]
    for i in range(1, 400):
        c = list(base)
        c[rng.randrange(150)] = f"x{i}"
        rows.append((i, " ".join(c)))
    got = near_dedup.classes(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.class_id for r in got.collect()} == {0}


def test_odd_documents(odd, odd_rows, none):
    got = near_dedup.classes(odd).collect()
    assert len(got) == len(odd_rows)
    by = defaultdict(set)
    for r in got:
        by[r.doc_id].add(r.class_id)
    assert by[1] == by[2] == by[3] == by[4] == {1}
    assert by[5] == {5} and by[6] == {6} and by[7] == {7} and by[15] == {15} and by[None] == {None}
    text = {r[0]: r[1] for r in odd_rows}
    kept = near_dedup.keep_one(odd)
    bags = [shingles(r.text) for r in kept.collect() if r.doc_id is not None and shingles(r.text)]
    assert all(jaccard(a, b) < 0.8 for i, a in enumerate(bags) for b in bags[:i])
    assert {r.doc_id for r in kept.collect() if r.doc_id not in (2, 3, 4)} == set(text) - {2, 3, 4}
    assert kept.schema == odd.schema and {r.doc_id for r in kept.collect()} & {1, 2, 3, 4} == {1}
    assert near_dedup.classes(none).count() == 0 and near_dedup.keep_one(none).count() == 0


def test_one_id_of_several_texts(spark):
    """Rows are classed by their texts: a doc_id that repeats neither loses links nor merges texts."""
    rng = random.Random(6)
    a, b = ([f"{x}{rng.randrange(10**6)}" for _ in range(100)] for x in "ab")
    near = lambda w: " ".join([*w[:50], "changed", *w[51:]])
    rows = [(9, " ".join(a)), (9, " ".join(b)), (10, near(a)), (11, near(b)), (9, " ".join(a)), (12, "alone"), (12, "by itself")]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "doc_id long, text string, __gone string, k1 string")
    got = near_dedup.classes(df)
    assert classes_of(got) == brute_classes(rows) == [[10, 9, 9], [11, 9], [12], [12]]
    assert {r.doc_id: r.class_size for r in got.collect() if r.doc_id in (10, 11)} == {10: 3, 11: 2}
    kept = near_dedup.keep_one(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id, r.text) for r in kept.collect()) == sorted([(9, " ".join(a)), (9, " ".join(b)), (12, "alone"), (12, "by itself")])


def brute_nearest(ids, x, asked, k):
    out = {}
    for q in asked:
        s = x.astype(np.float64) @ x[ids.index(q)].astype(np.float64)
        order = sorted((-s[i], ids[i]) for i in range(len(ids)) if ids[i] != q)[:k]
        out[q] = [(i, -v) for v, i in order]
    return out


def frame(spark, ids, x):
    return spark.createDataFrame([(i, [float(v) for v in r]) for i, r in zip(ids, x, strict=True)], "vec_id long, embedding array<float>")


@pytest.mark.parametrize("shard", [120, 5000])
def test_recall(spark, shard):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(12, 24))
    x = (centres[rng.integers(12, size=900)] + 0.5 * rng.normal(size=(900, 24))).astype(np.float32)
    ids = list(range(900))
    got = defaultdict(list)
    for r in ann.nearest(frame(spark, ids, x), F.col("vec_id") % 20 == 0, shard=shard).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    want = brute_nearest(ids, x, range(0, 900, 20), 20)
    assert got.keys() == want.keys() and all(len(v) == 20 for v in got.values())
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits >= 0.9 * 20 * len(want)
    for q, found in got.items():
        assert found == sorted(found, key=lambda p: (-p[1], p[0]))
        assert all(abs(s - float(x[i].astype(float) @ x[q].astype(float))) < 1e-9 for i, s in found)


@pytest.mark.parametrize("scale", [1e25, 1e-25, 1e140, 1e200])
def test_recall_at_any_scale(spark, scale):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, 12)) * scale
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    got = defaultdict(list)
    for r in ann.nearest(df, F.col("vec_id") % 20 == 0, block=7, shard=150).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    assert got.keys() == set(range(0, 400, 20)) and all(len(v) == 20 for v in got.values())
    if scale < 1e150:  # beyond, inner products leave double precision and most are infinite
        hits = sum(len({i for i, _ in got[q]} & {i for i, _ in v}) for q, v in brute_nearest(list(range(400)), x, got, 20).items())
        assert hits >= 0.95 * 20 * len(got)


def test_one_id_of_several_vectors(spark):
    rows = [(0, [1.0, 0.0]), (1, [9.0, 0.0]), (1, [2.0, 0.0]), (2, [3.0, 0.0]), (0, [0.5, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert [(r.vec_id, r.score) for r in ann.nearest(df, F.col("vec_id") == 0).orderBy("rank").collect()] == [(2, 1.5), (1, 1.0)]


def test_copies_ties_and_bad_vectors(spark):
    rng = np.random.default_rng(2)
    same = rng.normal(size=6).astype(np.float32)
    x = [same] * 60 + [rng.normal(size=6).astype(np.float32) for _ in range(10)]
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    bad = [(200, None), (220, [0.0] * 6), (240, [1.0, float("nan"), 0.0, 0.0, 0.0, 0.0]), (260, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (280, [float("inf")] + [0.0] * 5), (300, [1.0, 2.0]), (None, [1.0] * 6), (0, rows[0][1])]
    df = spark.createDataFrame([(*r, "s", 7) for r in rows + bad], "vec_id long, embedding array<float>, score string, shard int")
    got = defaultdict(list)
    for r in ann.nearest(df, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect():
        got[r.query_id].append(r.vec_id)
    want = brute_nearest(list(range(70)), np.array(x), [0, 20, 40, 60], 20)
    assert {q: v for q, v in got.items()} == {q: [i for i, _ in v] for q, v in want.items()}
    few = ann.nearest(df.filter("vec_id < 3"), F.col("vec_id") == 0).collect()
    assert [(r["rank"], r.vec_id) for r in few] == [(1, 1), (2, 2)]
    assert ann.nearest(df.filter("vec_id < 0"), F.lit(True)).count() == 0
