"""Token table and BPE against the libraries' own output, and round trips."""

import base64
import hashlib
import random
import struct
import time
import zlib

import pytest

from weftgraph.llm import bpe, sstable, token_output

public_tokenizers = pytest.importorskip("public_tokenizers")
TABLE = public_tokenizers.path("byte_bpe_50k.json")
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN

TRICKY = ["", " ", "a", " lead", "tail ", "a  b", "a\n\nb", "a\nb c\n d", "it's they'll  x y　 ", "\n", "x.\nThe\n", "12 ab3, c_d !!\t\r\n z", "<|endoftext|> hi", "é" * 300, "né...ça ?! ok\x1f z", "don't'x 'S '\n'", "A.\n\nB", "a \nb", "a\n b"]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(TABLE)


@pytest.fixture(scope="module")
def coder():
    return bpe.Coder(RANKS, PATTERN)


@pytest.fixture(scope="module")
def plain():
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def random_texts(n, seed=0):
    rng = random.Random(seed)
    signs = ["a", "bc", "The", " ", " ", "\n", "  ", ".", ",", "1", "é", "'s", "$$", "\t", " ", "漢", "_"]
    return ["".join(rng.choice(signs) for _ in range(rng.randrange(60))) for _ in range(n)]


def test_pieces_are_what_the_library_gives(library):
    encoder = token_output.PieceEncoder(TABLE)
    for _ in range(2):  # the second time from the cache
        texts = TRICKY + random_texts(3000)
        for t, ids in zip(texts, encoder.encode(texts), strict=True):
            assert list(struct.unpack(f"<{len(ids) // 2}H", ids)) == library.encode(t, add_special_tokens=False).ids, repr(t)


def test_special_tokens_as_text(library):
    texts = ["<|endoftext|> hi", "a <|endoftext|>b\n<|endoftext|>", *TRICKY]
    found = dict(zip(texts, token_output.PieceEncoder(TABLE).encode(texts), strict=True))
    assert struct.unpack("<2H", found["<|endoftext|> hi"]) == (50256, 23105)
    plain = type(library).from_file(TABLE)
    plain.encode_special_tokens = True
    for t, ids in zip(texts, token_output.PieceEncoder(TABLE, special_as_text=True).encode(texts), strict=True):
        assert list(struct.unpack(f"<{len(ids) // 2}H", ids)) == plain.encode(t, add_special_tokens=False).ids


def test_full_cache(library, monkeypatch):
    monkeypatch.setattr(token_output, "CACHE", 5)
    encoder = token_output.PieceEncoder(TABLE)
    for t in TRICKY:
        assert struct.unpack(f"<{len(x := encoder.encode([t])[0]) // 2}H", x) == tuple(library.encode(t, add_special_tokens=False).ids)


def test_token_report(spark, odd, odd_rows, none, library):
    want, start = [], 0
    for doc_id, text, *_ in sorted(odd_rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = library.encode(text or "", add_special_tokens=False).ids + [0]
        want.append((doc_id, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
    got = sorted(token_output.token_report(odd, TABLE).collect(), key=lambda r: r.start)
    assert sorted(map(repr, ((r.doc_id, r.n_tokens, r.ids_crc32) for r in got))) == sorted(map(repr, want))
    assert [r.doc_id for r in got] == [w[0] for w in want]
    for r in got:
        assert r.start == start
        start += r.n_tokens
    assert token_output.token_report(none, TABLE).count() == 0


def test_small_files_and_lookup(spark, tmp_path, odd, odd_rows, library):
    path, ranges = str(tmp_path / "sst"), str(tmp_path / "ranges")
    token_output.write_shards(odd, path, TABLE, file_bytes=100)
    assert len(list((tmp_path / "sst").glob("part-*"))) >= 2
    token_output.write_ranges(spark, path, ranges)
    assert sum(r.entries for r in spark.read.parquet(ranges).collect()) == len(odd_rows)
    got = sorted((repr(r.doc_id), r.ids) for r in token_output.lookup(spark, ranges, [1, 10, 14, 999, None]).collect())
    want = sorted((repr(r[0]), library.encode(r[1] or "", add_special_tokens=False).ids + [0]) for r in odd_rows if r[0] in (1, 10, 14, None))
    assert got == want
    assert token_output.lookup(spark, ranges, [999_999]).count() == 0
    assert token_output.read_shards(spark, path).count() == odd.count()


def test_rows_of_one_id_are_dealt_out(spark, tmp_path):
    """A third of the rows without id and a third of one id go to several tasks."""
    rows = [(None if i % 3 == 0 else 7 if i % 3 == 1 else i, f"text {i} " * 50) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        token_output.write_shards(docs, str(tmp_path / "sst"), TABLE)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    report = token_output.read_shards(spark, str(tmp_path / "sst")).groupBy("file").count().collect()
    assert len(report) >= 3 and max(r["count"] for r in report) < 2000
    assert token_output.token_report(docs, TABLE).agg({"n_tokens": "count"}).first()[0] == 3000


def test_sorted_string_table():
    rng = random.Random(2)
    ids = sorted(rng.sample(range(-(10**12), 10**12), 4000))
    w = sstable.Writer()
    for i in [None, *ids]:
        w.add(sstable.key_of(i), str(i).encode() * rng.randrange(1, 40))
    with pytest.raises(ValueError):
        w.add(sstable.key_of(ids[0]), b"")
    data = w.finish() + b"\n"
    r = sstable.Reader(data)
    assert r.entries == 4001 and len(r.last_keys) > 1
    assert [sstable.id_of(k) for k, _ in r.scan()] == [None, *ids]
    assert all(r.get(i).startswith(str(i).encode()) for i in [None, *ids[::50]])
    assert [len(list(r.get_all(i))) for i in [None, *ids[::50]]] == [1] * (1 + len(ids[::50]))
    absent = [i + 1 for i in ids if i + 1 not in set(ids)]
    assert all(r.get(i) is None for i in absent[:500])
    assert sum(r.may_hold(sstable.key_of(i)) for i in absent) < 0.05 * len(absent)
    with pytest.raises(ValueError):
        list(sstable.Reader(bytes([data[0] ^ 255]) + data[1:]).scan())
    with pytest.raises(ValueError):
        sstable.Reader(data + b"x")


def test_chunks_give_whole_pretokens(coder):
    for t in TRICKY + random_texts(500, 1):
        for chunk, overlap in ((7, 3), (16, 16), (5, 1)):
            assert bpe.chunked_pretokens(coder.pattern, t, chunk, overlap) == coder.pattern.findall(t), repr(t)
    long = "word " * 30 + "x" * 200 + " 12" * 40 + " " * 100 + "end"
    assert bpe.chunked_pretokens(coder.pattern, long, 20, 5) == coder.pattern.findall(long)


def test_stitching_is_linear(coder):
    """Tens of millions of characters, with and without boundaries in common, stitch in seconds."""
    for text, most in (("word and 12345 more, " * 1_000_000, 25), ("x" * 10_000_000, 15), ("1234567890" * 200_000, 15)):
        parts = [bpe.boundaries(coder.pattern, text[s : s + bpe.CHUNK + bpe.OVERLAP], s, s + bpe.CHUNK + bpe.OVERLAP >= len(text)) for s in range(0, len(text), bpe.CHUNK)]
        began = time.thread_time()
        cuts = bpe.stitch(coder.pattern, text, parts, bpe.CHUNK)
        assert time.thread_time() - began < most
        assert cuts == sorted(set(cuts)) and cuts[-1] <= len(text)


def test_bpe_round_trip(coder, plain):
    for t in TRICKY + random_texts(500, 3):
        ids = coder.encode(coder.pattern.findall(t))
        assert ids == plain.encode_ordinary(t) and coder.decode(ids) == t.encode()


@pytest.mark.parametrize("sizes", [{}, {"chunk": 64, "overlap": 16}])
def test_bpe_report(odd, odd_rows, none, plain, sizes):
    want = []
    for doc_id, text, *_ in odd_rows:
        ids = plain.encode_ordinary(text or "")
        want.append(repr((doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest())))
    assert sorted(map(repr, map(tuple, bpe.encode_report(odd, RANKS, PATTERN, **sizes).collect()))) == sorted(want)
    assert bpe.encode_report(none, RANKS, PATTERN).count() == 0
