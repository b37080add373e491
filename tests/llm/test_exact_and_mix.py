"""Exact de-duplication and mixing, against SQL and plain Python."""

import hashlib
import os
import re
from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from weftgraph.llm import exact_dedup, mixing
from weftgraph.llm.queries import QUERIES, SQL

SPACE = re.compile(r"[\x20\x09-\x0D]+")


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(spark, tables, name):
    c = duckdb.connect()
    for f in os.listdir(tables):
        c.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{tables}/{f}')")
    got, want = QUERIES[name](spark, tables), c.sql(SQL[name])
    order = want.columns
    assert sorted(got.columns) == sorted(order)
    assert sorted(map(repr, map(tuple, got.select(*order).collect()))) == sorted(map(repr, want.fetchall()))


def test_exact_by_hand(odd, odd_rows):
    groups = defaultdict(list)
    for r in odd_rows:
        groups[SPACE.sub(" ", r[1] or "")].append(r[0])
    want = []
    for text, ids in groups.items():
        keep = min((i for i in ids if i is not None), default=None)
        want += [(i, keep, len(ids), i == keep, hashlib.sha256(text.encode()).hexdigest()) for i in ids]
    for salts in (1, 64):
        assert sorted(map(repr, map(tuple, exact_dedup.duplicate_report(odd, salts=salts).collect()))) == sorted(map(repr, want))


def one_of_each(rows):
    """Of each normalised text the row of smallest doc_id, those without one last; which of rows alike in both does not matter here."""
    best = {}
    for r in rows:
        key, rank = SPACE.sub(" ", r[1] or ""), (r[0] is None, r[0] or 0)
        best[key] = min(best.get(key, rank), rank)
    return sorted((key, None if unnamed else i) for key, (unnamed, i) in best.items())


def told(df):
    return sorted((SPACE.sub(" ", r.text or ""), r.doc_id) for r in df.collect())


def test_exact_keeps_one_row_of_each_text(spark, odd, odd_rows, none):
    kept = exact_dedup.drop_exact_duplicates(odd)
    assert kept.schema == odd.schema
    assert told(kept) == one_of_each(odd_rows)
    assert exact_dedup.duplicate_report(none).count() == 0 and exact_dedup.drop_exact_duplicates(none).count() == 0
    rows = [(3, "a b", 1), (5, "c d", 2), (5, "a b", 3), (5, "c d", 2), (None, "c  d", 4), (None, "e", 5), (None, "e", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, __gone int")
    assert told(exact_dedup.drop_exact_duplicates(docs)) == [("a b", 3), ("c d", 5), ("e", None)]
    maps = docs.withColumn("m", F.create_map(F.lit("k"), "__gone"))
    assert told(exact_dedup.drop_exact_duplicates(maps)) == [("a b", 3), ("c d", 5), ("e", None)]


def test_digests_that_stand_for_several_texts(odd, odd_rows):
    """With digests of one sign the texts themselves decide."""
    short = lambda norm: F.substring(F.sha2(norm, 256), 1, 1)
    assert sorted(map(repr, exact_dedup.duplicate_report(odd, digest=short).collect())) == sorted(map(repr, exact_dedup.duplicate_report(odd).collect()))
    assert told(exact_dedup.drop_exact_duplicates(odd, digest=short)) == one_of_each(odd_rows)


def fill(sizes, weights, most):
    """Water-filling as the contract words it."""
    target, open_, left = {}, dict(weights), float(sum(sizes.values()))
    while open_:
        share = {s: left * w / sum(open_.values()) for s, w in open_.items()}
        over = [s for s in open_ if share[s] > most * sizes[s]]
        if not over:
            return target | share
        for s in over:
            target[s] = float(most * sizes[s])
            left -= target[s]
            del open_[s]
    return target


def test_mix_by_hand(spark, odd, odd_rows):
    rows = [r.asDict() for r in mixing.mix_report(odd).collect()]
    sizes = defaultdict(int)
    for r in odd_rows:
        sizes[r[3]] += len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or ""))
    names = sorted(s for s in sizes if s is not None) + [None] * (None in sizes)
    want = fill(sizes, {s: (1, 2, 3)[i % 3] for i, s in enumerate(names)}, 3)
    assert len(rows) == len(odd_rows)
    source = {r[0]: r[3] for r in odd_rows}
    for r in rows:
        assert r["taken"] == r["copies"] * r["size"] and 0 <= r["copies"] <= 3
        if r["doc_id"] is not None:
            assert abs(r["target"] - want[source[r["doc_id"]]]) < 1e-6
    assert sorted(map(repr, rows)) == sorted(repr(r.asDict()) for r in mixing.mix_report(odd.repartition(1)).collect())


def test_mix_meets_targets(spark):
    import random

    rng = random.Random(1)
    docs = [(i, "w " * rng.randrange(1, 60), rng.choice("aaaabcd")) for i in range(6000)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    rows = mixing.mix_report(df).collect()
    taken, target = defaultdict(int), {}
    for r, (_, _, s) in zip(sorted(rows, key=lambda r: r.doc_id), docs, strict=True):
        taken[s] += r.taken
        target[s] = r.target
    assert all(abs(taken[s] - target[s]) <= 60 for s in target)
    mixed = mixing.mix(df)
    assert mixed.schema == df.schema
    assert sum(len(r.text.split()) for r in mixed.collect()) == sum(taken.values())


def test_mix_clashing_names(spark, odd):
    docs = odd.withColumns({c: F.lit("c") for c in ("mix_source", "mix_plan", "mix_copies", "__mix_source", "a.b", "it`s")})
    got = mixing.mix(docs)
    assert got.columns == docs.columns
    assert sorted(map(repr, (r.doc_id for r in got.collect()))) == sorted(map(repr, (r.doc_id for r in mixing.mix(odd).collect())))


def test_mix_odd_tables(odd, none):
    assert mixing.mix(odd).columns == odd.columns and mixing.mix(odd).count() > 0
    assert mixing.mix_report(none).count() == 0 and mixing.mix(none).count() == 0
