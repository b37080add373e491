"""Byte-level BPE over whole texts by overlapping chunk encoding, and decoding by concatenating raw bytes.

A long text is cut into chunks that overlap to the right. Each chunk is pre-tokenised on its own, as a row
of its own, so chunks of one text run in parallel. Neighbouring chunks are stitched at the first position
where both have a pre-token boundary: the pattern looks only forward, so two scans that stand at one
position go on alike. A match that touches the end of its chunk may be cut short and is not trusted. If the
overlap holds no common boundary, the left scan goes on over the next chunk, which is slower but exact.
The pre-tokens are then merged by rank, each on its own, with a cache per Python worker. A text of one chunk
has nothing to stitch and is encoded where it is read.

Defined results: null counts as empty and gives 0 tokens; a text of any length is stitched in time linear in it;
repeated rows are encoded each; an empty table gives an empty result; other columns, whatever their names, are
not read.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from itertools import chain

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, named, text_slices, worker_cache

CHUNK = 16_384
OVERLAP = 256
#: Pre-tokens a worker remembers before it starts anew.
CACHE = 300_000
RESULT = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


class Coder:
    """Encodes pre-tokens by a rank file and decodes ids."""

    def __init__(self, ranks_path: str, pattern: str):
        import base64

        import regex
        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.pattern = regex.compile(pattern)
        self.raw = {i: b for b, i in ranks.items()}
        self.decimal = {i: str(i) for i in self.raw}
        self.cache: dict[str, tuple[int, ...]] = {}

    @classmethod
    def of(cls, ranks_path: str, pattern: str) -> Coder:
        own = worker_cache("bpe")
        if (ranks_path, pattern) not in own:
            own[ranks_path, pattern] = cls(ranks_path, pattern)
        return own[ranks_path, pattern]

    def encode(self, pretokens: list[str]) -> list[int]:
        cache = self.cache
        new = set(pretokens).difference(cache)
        if len(cache) + len(new) > CACHE:
            cache.clear()
            new = set(pretokens)
        for p in new:
            cache[p] = tuple(self.encoding.encode_ordinary(p))
        return list(chain.from_iterable(map(cache.__getitem__, pretokens)))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.raw.__getitem__, ids))

    def digest(self, ids: list[int]) -> tuple[int, str, str]:
        import hashlib

        text = ",".join(map(self.decimal.__getitem__, ids))
        return len(ids), hashlib.sha256(text.encode()).hexdigest(), hashlib.sha256(self.decode(ids)).hexdigest()


def boundaries(pattern, text: str, start: int = 0, complete: bool = True) -> list[int]:
    """Where the pre-tokens of text begin, and after the last where it ends, all moved by start.

    Unless complete, a match that reaches the end of text is left out, with all after it."""
    out = [start]
    for m in pattern.finditer(text):
        if not complete and m.end() == len(text):
            break
        out.append(start + m.end())
    return out


def stitch(pattern, text: str, parts: list[list[int]], chunk: int) -> list[int]:
    """The boundaries of text from those of its chunks, each chunk's list beginning at its own start."""
    out = list(parts[0])
    for k in range(1, len(parts)):
        part = parts[k]
        if len(part) == 1 and out[-1] < part[0]:  # a match over the whole chunk: its end is in a later one
            continue
        here = set(part)
        at = next((i for i in range(bisect_left(out, k * chunk), len(out)) if out[i] in here), None)
        if at is None:  # no common boundary: go on from the last sure one, over this chunk
            end = part[-1]
            if end > out[-1]:
                out += boundaries(pattern, text[out[-1] : end], out[-1], end == len(text))[1:]
        else:
            b = out[at]
            del out[at + 1 :]
            out += part[bisect_left(part, b + 1) :]
    return out


def chunked_pretokens(pattern, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> list[str]:
    """What pattern.findall(text) gives, by way of overlapping chunks."""
    parts = [boundaries(pattern, text[s : s + chunk + overlap], s, s + chunk + overlap >= len(text)) for s in range(0, max(1, len(text)), chunk)]
    cuts = stitch(pattern, text, parts, chunk)
    if cuts[-1] < len(text):
        cuts += boundaries(pattern, text[cuts[-1] :], cuts[-1])[1:]
    return [text[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]


def _encode_short(ranks_path: str, pattern: str):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        coder = Coder.of(ranks_path, pattern)
        for batch in batches:
            for part in text_slices(batch, "text", 4_000_000):
                rows = [coder.digest(coder.encode(coder.pattern.findall(t))) for t in part.column("text").to_pylist()]
                n, ids, raw = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids), pa.array(raw)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def _scan_chunks(pattern: str):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import regex

        compiled = regex.compile(pattern)
        for batch in batches:
            cuts = [boundaries(compiled, t, s, last) for t, s, last in zip(*(batch.column(c).to_pylist() for c in ("piece", "start", "last")), strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("row", "doc_id", "start", "piece")), pa.array(cuts, pa.list_(pa.int32()))], ["row", "doc_id", "start", "piece", "cuts"])

    return run


def _encode_long(ranks_path: str, pattern: str, chunk: int):
    def run(table):
        import pyarrow as pa

        coder = Coder.of(ranks_path, pattern)
        rows = sorted(zip(*(table.column(c).to_pylist() for c in ("start", "piece", "cuts")), strict=True))
        text = "".join(p[:chunk] for _, p, _ in rows)
        cuts = stitch(coder.pattern, text, [c for _, _, c in rows], chunk)
        if cuts[-1] < len(text):
            cuts += boundaries(coder.pattern, text[cuts[-1] :], cuts[-1])[1:]
        n, ids, raw = coder.digest(coder.encode([text[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]))
        return pa.table({"doc_id": table.column("doc_id").slice(0, 1), "n_tokens": pa.array([n], pa.int64()), "ids_sha256": [ids], "decoded_sha256": [raw]})

    return run


def encode_report(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 for every row."""
    texts = docs.select(named(id_col).cast("long").alias("doc_id"), F.coalesce(named(text_col), F.lit("")).alias("text"))
    is_long = F.length("text") > chunk
    short = texts.filter(~is_long).mapInArrow(_encode_short(ranks_path, pattern), RESULT)
    starts = F.explode(F.sequence(F.lit(0), F.length("text") - 1, F.lit(chunk)))
    chunks = texts.filter(is_long).withColumn("row", F.monotonically_increasing_id()).select("row", "doc_id", "text", starts.alias("start"))
    chunks = chunks.select("row", "doc_id", "start", F.substring(F.col("text"), F.col("start") + 1, F.lit(chunk + overlap)).alias("piece"), (F.col("start") + chunk + overlap >= F.length("text")).alias("last"))
    chunks = materialize(chunks, "bpe-chunks")  # the numbers of rows must not change when a task runs again
    scanned = chunks.repartition("row", "start").mapInArrow(_scan_chunks(pattern), "row long, doc_id long, start int, piece string, cuts array<int>")
    return short.unionByName(scanned.groupBy("row").applyInArrow(_encode_long(ranks_path, pattern, chunk), RESULT))
