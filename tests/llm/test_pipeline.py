"""The pipeline's stages against brute force and SQL, on the tables and on odd rows."""

import hashlib
import re
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F
from test_exact_and_mix import one_of_each, told
from test_near_and_ann import jaccard, shingles

import corpus_pipeline
from weftgraph.llm import quality
from weftgraph.llm.common import materialize
from weftgraph.llm.queries import SQL
from weftgraph.plans import bsp


def near_kept(rows):
    """Of each group linked by similarity the row of smallest doc_id; rows without words or id stay, like ones once."""
    rows = sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))
    bags = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders = {}
    for i, bag in enumerate(bags):
        for s in bag:
            holders.setdefault(s, []).append(i)
    for i, j in {(i, j) for at in holders.values() for i in at for j in at if i < j}:
        if rows[i][0] is not None and rows[j][0] is not None and jaccard(bags[i], bags[j]) >= 0.8:
            parent[max(find(i), find(j))] = min(find(i), find(j))
    return Counter(rows[i][0] for i in range(len(rows)) if find(i) == i)


def copies(rows):
    """(doc_id, copies) by the SQL of the mix."""
    c = duckdb.connect()
    c.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, source VARCHAR)")
    c.executemany("INSERT INTO documents VALUES (?, ?, ?)", rows)
    out = Counter()
    for doc_id, n in c.sql(f"SELECT doc_id, copies FROM ({SQL['op6_pareto_mix']})").fetchall():
        out[doc_id] += n
    return +out


def run_stages(spark, docs, sf_dir):
    import base64

    import public_tokenizers
    import tiktoken

    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "exact_dedup", "near_dedup", "mixing", "encoding"]
    seen, before = {}, docs
    for name, stage in corpus_pipeline.STAGES:
        after = materialize(stage(spark, before, sf_dir), name)
        seen[name] = (before.collect(), after.collect())
        assert after.columns == docs.columns or name == "encoding"
        before = after
    a, b = seen["quality"]
    model = quality.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    assert sorted(map(repr, b)) == sorted(repr(r) for r in a if model.score([quality.features(r.text)])[0] >= quality.CUT)
    a, b = seen["exact_dedup"]
    kept = sorted((re.sub(r"[\x20\x09-\x0D]+", " ", r.text or ""), r.doc_id) for r in b)
    assert kept == one_of_each([(r.doc_id, r.text) for r in a])
    a, b = seen["near_dedup"]
    assert Counter(r.doc_id for r in b) == near_kept([(r.doc_id, r.text) for r in a])
    a, b = seen["mixing"]
    assert Counter(r.doc_id for r in b) == copies([(r.doc_id, r.text, r.source) for r in a])
    a, b = seen["encoding"]
    ranks = {base64.b64decode(x): int(y) for x, y in map(bytes.split, open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = [(r.doc_id, len(ids := library.encode_ordinary(r.text or "")), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()) for r in a]
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in b)
    return seen


def test_stages(spark, tables):
    seen = run_stages(spark, spark.read.parquet(f"{tables}/documents.parquet"), tables)
    assert len(seen["encoding"][1]) > 50


def test_odd_rows(spark, tmp_path, odd, none, monkeypatch):
    """Nulls in any column, empty and very long texts, ties, repeated rows, clashing names, an empty table."""
    monkeypatch.setattr(quality.Ranker, "score", lambda self, rows: __import__("numpy").full(len(rows), 0.9))  # all odd rows go on
    spark.createDataFrame([(1, 1), (4, 0)], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    extra = odd.withColumns({c: F.lit("c") for c in ("k1", "row", "__gone", "mix_plan", "digest", "first", "a.b")})
    seen = run_stages(spark, extra, str(tmp_path))
    assert Counter(r.doc_id for r in seen["exact_dedup"][1])[14] == 2 and Counter(r.doc_id for r in seen["exact_dedup"][1])[15] == 1
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, str(tmp_path)).count() == 0, name


def test_leaves_only_its_result(spark, tables, tmp_path, monkeypatch):
    monkeypatch.setattr(bsp, "shared_dir", lambda spark: str(tmp_path))
    n = corpus_pipeline.run(spark, tables).count()
    left = [p.name for p in tmp_path.iterdir()]
    assert n and len(left) == 1, left


def test_a_shared_folder_is_required(spark):
    class Session:
        def __init__(self, master):
            self.conf = type("Conf", (), {"get": staticmethod(lambda key, default: default)})
            self.sparkContext = type("Context", (), {"master": master})

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        bsp.shared_dir(Session("spark://host:7077"))
    with pytest.raises(RuntimeError):
        bsp.shared_dir(Session("local-cluster[2,1,1024]"))
    assert bsp.shared_dir(Session("local[4]"))
