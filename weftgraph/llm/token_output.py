"""Token ids of all documents as sorted-string-table shards, written and read back.

Documents are range-partitioned by id; each task encodes its range in order and cuts it into files of at
most ``FILE_BYTES`` (a single larger document has a file of its own), so memory does not follow the range.

Encoding asks the tokenizers library only for pieces not met before: a byte-level BPE never merges across
pre-tokens, and just before a space that a non-space follows there always is a pre-token boundary, so the
text may be cut there, and around a lone line feed, and each piece be encoded once per worker. A text in which
white space meets white space is encoded as a whole.

Strings of special tokens in a text are encoded as the library does by default, that is, as those tokens; with
``special_as_text`` they are ordinary text. A text that holds one is encoded as a whole.

Rows of one id (or without any) are dealt over tasks by the hash of their texts and by the partition they come
from, so none is hot.

Defined results: null text counts as empty (the end id alone); a null doc_id comes first; repeated rows
follow one another, each with its own start; a very long text is one entry; an empty table gives an empty
result; other columns, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import sstable
from .common import broadcast_if_small, kept, materialize, named, new_path, scratch, small_batches, text_slices, worker_cache

END_ID = 0
FILE_BYTES = 8_000_000
CACHE = 350_000
#: Signs that never join a word before them: no letter, number, space or low line.
SIGNS = "!\"#$%&'()*+,-./:;<=>?@[\\]^`{|}~"


class PieceEncoder:
    """Ids of whole texts as little-endian u16."""

    def __init__(self, tokenizer_path: str, special_as_text: bool = False):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import numpy as np
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(tokenizer_path)
        self._tokenizer.encode_special_tokens = special_as_text
        self._special = [] if special_as_text else [t.content for t in self._tokenizer.get_added_tokens_decoder().values()]
        if hasattr(self._tokenizer.model, "_resize_cache"):
            self._tokenizer.model._resize_cache(0)  # new words only come here, so its own cache can't help
        space, feed = (self._tokenizer.encode(x, add_special_tokens=False).tokens[0][0] for x in (" x", "\nx"))
        #: By id: tokens that begin with a space or a line feed.
        self._begins = np.array([(self._tokenizer.id_to_token(i) or "").startswith((space, feed)) for i in range(self._tokenizer.get_vocab_size())])
        self._sign: dict[str, bytes] = {}
        self._cache: dict[str, bytes] = {}

    @classmethod
    def of(cls, tokenizer_path: str, special_as_text: bool = False) -> PieceEncoder:
        own = worker_cache("pieces")
        if (tokenizer_path, special_as_text) not in own:
            own[tokenizer_path, special_as_text] = cls(tokenizer_path, special_as_text)
        return own[tokenizer_path, special_as_text]

    def _pieces(self, text: str) -> list[str]:
        """The text cut before each space and line feed; a piece has lost its space. The first has nothing before it and is marked by a space."""
        parts = text.replace("\n", " \n").split(" ")
        parts[0] = " " + parts[0]
        return parts

    @staticmethod
    def _unsure(piece: str) -> bool:
        """Whether white space meets white space at an end of this piece, so that its cut may be no boundary."""
        return not piece or piece[-1:].isspace() and piece != " " or piece[piece[0] in " \n" :][:1].isspace()

    def _encode(self, texts: list[str]) -> list[bytes]:
        import numpy as np

        return [np.array(e.ids, "<u2").tobytes() for e in self._tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, pieces: list[str]) -> dict[str, bytes]:
        """Encode new pieces. A space or a line feed and the letters after it always begin a token, so many such words
        go as one text whose ids are cut again before those tokens. Signs after a word are one pre-token of their own."""
        import numpy as np

        known, out, words, signed, rest = self._cache.get, {}, [], [], []
        for p in pieces:
            if p.isalpha():
                words.append(p)
                continue
            w = p.rstrip(SIGNS)
            if not (w.isalpha() or w[:1] == "\n" and w[1:].isalpha()):
                rest.append(p)
            elif len(w) == len(p):
                words.append(p)
            else:
                signed.append((p, w, known(w)))
        words += {w for _, w, ids in signed if ids is None}.difference(words)
        for glue, some in ((" ", [w for w in words if w[0] != "\n"]), ("", [w for w in words if w[0] == "\n"])):
            for k in range(0, len(some), 500):
                part = some[k : k + 500]
                ids = np.array(self._tokenizer.encode_batch_fast([glue + glue.join(part)], add_special_tokens=False)[0].ids, "<u2")
                starts = (np.flatnonzero(self._begins[ids]) * 2).tolist()
                raw = ids.tobytes()
                out.update(zip(part, map(raw.__getitem__, map(slice, starts, [*starts[1:], len(raw)])), strict=True))
        new = list({p[len(w) :] for p, w, _ in signed}.difference(self._sign))
        self._sign.update(zip(new, self._encode(new), strict=True))
        for p, w, ids in signed:
            out[p] = (ids or out[w]) + self._sign[p[len(w) :]]
        out.update(zip(rest, self._encode([p[1:] if p[:1] == " " else p if p[:1] == "\n" else " " + p for p in rest]), strict=True))
        return out

    def encode(self, texts: list[str | None]) -> list[bytes]:
        from itertools import chain

        if held := {i for i, t in enumerate(texts) if t and any(x in t for x in self._special)}:
            some = iter(self._encode([texts[i] for i in sorted(held)]))
            rest = iter(self.encode([t for i, t in enumerate(texts) if i not in held]))
            return [next(some if i in held else rest) for i in range(len(texts))]
        cache, cut = self._cache, [self._pieces(t or "") for t in texts]
        flat = list(chain.from_iterable(cut))
        found = list(map(cache.get, flat))
        missing, at = [], -1
        for _ in range(found.count(None)):
            at = found.index(None, at + 1)
            missing.append(at)
        new = {flat[i] for i in missing}
        unsure = {p for p in new if not p.isalpha() and self._unsure(p)}
        learned = self._learn(list(new - unsure))
        for i in missing:
            found[i] = learned.get(flat[i], b"")
        if len(cache) + len(learned) <= CACHE:  # what came first stays: the frequent pieces are among it
            cache.update(learned)
        out, at = [], 0
        for i, parts in enumerate(cut):
            to = at + len(parts)
            whole = unsure and not unsure.isdisjoint(parts)
            out.append(self._encode([texts[i]])[0] if whole else b"".join(found[at:to]))
            at = to
        if len(self._sign) > 10_000:
            self._sign.clear()
        return out


def _images(tokenizer_path: str, file_bytes: int, special_as_text: bool):
    def run(batches: Iterator) -> Iterator:
        import struct

        import pyarrow as pa

        encoder, end = PieceEncoder.of(tokenizer_path, special_as_text), struct.pack("<H", END_ID)
        writer = sstable.Writer()
        image = lambda w: pa.RecordBatch.from_arrays([pa.array([w.finish()], pa.binary())], ["image"])
        empty = True
        for batch in batches:
            for part in text_slices(batch, "text", 300_000):
                for doc_id, ids in zip(part.column("doc_id").to_pylist(), encoder.encode(part.column("text").to_pylist()), strict=True):
                    if writer.size >= file_bytes:
                        yield image(writer)
                        writer = sstable.Writer()
                    writer.add(sstable.key_of(doc_id), ids + end)
                    empty = False
        if not empty:
            yield image(writer)

    return run


def write_shards(docs: DataFrame, path: str, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", file_bytes: int = FILE_BYTES, special_as_text: bool = False) -> None:
    """Write all documents' ids under path, in ascending order of id within and across files."""
    texts = docs.select(named(id_col).cast("long").alias("doc_id"), named(text_col).alias("text"))
    dealt = texts.repartitionByRange("doc_id", F.xxhash64("text"), F.spark_partition_id())
    images = dealt.sortWithinPartitions("doc_id").mapInArrow(_images(tokenizer_path, file_bytes, special_as_text), "image binary")
    images.select(F.col("image").cast("string").alias("value")).write.option("maxRecordsPerFile", 1).text(path)


def _files(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    return spark.read.format("binaryFile").load(paths)


def _scan(batches: Iterator) -> Iterator:
    import zlib

    import numpy as np
    import pyarrow as pa

    for batch in batches:
        worker_cache("pieces").clear()  # the encoder's work is done
        for path, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
            if not content.as_buffer().size:  # a task without documents may leave an empty file
                continue
            ids, starts, sizes, sums, start = [], [], [], [], 0
            for key, value in sstable.Reader(content.as_buffer()).scan():
                found = np.frombuffer(value, "<u2")
                ids.append(sstable.id_of(key))
                starts.append(start)
                sizes.append(len(found))
                sums.append(zlib.crc32(found.astype("<u4").tobytes()))
                start += len(found)
            yield pa.RecordBatch.from_arrays([pa.array([path] * len(ids)), *(pa.array(x, pa.int64()) for x in (ids, starts, sizes, sums))], ["file", "doc_id", "start", "n_tokens", "ids_crc32"])


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 from the files under path."""
    return _files(spark, path).select("path", "content").mapInArrow(_scan, "file string, doc_id long, start long, n_tokens long, ids_crc32 long")


#: What a null doc_id counts as where files are compared by their ids.
NO_ID = -(1 << 63)


def write_ranges(spark: SparkSession, path: str, to: str) -> None:
    """Write a table of the files under path to the folder ``to``: file, first and last doc_id, number of entries."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for file, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                if content.as_buffer().size:
                    reader = sstable.Reader(content.as_buffer())
                    first, last = (NO_ID if i is None else i for i in (sstable.id_of(next(reader.block(0))[0]), sstable.id_of(reader.last_keys[-1])))
                    yield pa.RecordBatch.from_pydict({"file": [file], "first": [first], "last": [last], "entries": [reader.entries]})

    _files(spark, path).select("path", "content").mapInArrow(run, "file string, first long, last long, entries long").write.parquet(to)


def lookup(spark: SparkSession, ranges: str, doc_ids: list[int | None]) -> DataFrame:
    """doc_id and ids (array<int>) of the wanted documents, by a table of write_ranges: only files whose range holds a
    wanted id are opened, and in each a binary search leads to one block (to several where an id repeats)."""
    wanted = sorted({NO_ID if i is None else i for i in doc_ids})
    schema = "doc_id long, ids array<int>"

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for content in batch.column("content"):
                reader = sstable.Reader(content.as_buffer())
                found = [(i, v) for i in wanted for v in reader.get_all(None if i == NO_ID else i)]
                ids = [np.frombuffer(v, "<u2").tolist() for _, v in found]
                yield pa.RecordBatch.from_arrays([pa.array([None if i == NO_ID else i for i, _ in found], pa.int64()), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    asked = spark.createDataFrame([(i,) for i in wanted], "wanted long")  # as long as the caller's list
    files = spark.read.parquet(ranges).join(F.broadcast(asked), F.col("wanted").between(F.col("first"), F.col("last")), "left_semi").select("file")
    paths = [r.file for r in files.collect()]  # a few files an id
    return _files(spark, paths).select("content").mapInArrow(run, schema) if paths else spark.createDataFrame([], schema)


def token_report(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", special_as_text: bool = False) -> DataFrame:
    """Write the shards to the shared folder, read them back: doc_id, start, n_tokens, ids_crc32."""
    spark = docs.sparkSession
    with scratch(spark):
        path = new_path(spark, "sstable")
        with small_batches(spark):
            write_shards(docs, path, tokenizer_path, id_col, text_col, special_as_text=special_as_text)
        with small_batches(spark, 1):
            rows = kept(read_shards(spark, path), "sstable-rows")
    key = F.coalesce("doc_id", F.lit(NO_ID))
    files = rows.groupBy("file").agg(F.min(key).alias("first"), F.max(key).alias("last"), F.sum("n_tokens").alias("n"))
    before = Window.orderBy("first", "last", "file").rowsBetween(Window.unboundedPreceding, -1)
    files = materialize(files.select(F.col("file").alias("__file"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")), "sstable-files")
    out = rows.join(broadcast_if_small(files, files.count()), F.col("file") == F.col("__file"))
    return out.select("doc_id", (F.col("start") + F.col("base")).alias("start"), "n_tokens", "ids_crc32")
