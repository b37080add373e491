"""What the operators share: table access, scratch tables, row keys, text helpers."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.bsp import cut as materialize
from ..plans.bsp import discard, kept, leaves_result, new_path, scratch

__all__ = ["SPACE", "WORD", "broadcast_if_small", "discard", "fold", "fresh", "keep_rows", "kept", "leaves_result", "materialize", "named", "new_path", "row_key", "sampled", "scratch", "small_batches", "table", "text_slices", "worker_cache"]

#: White space of the contracts.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
#: A table of at most this many rows may be broadcast; callers count it first, and its rows are narrow.
BROADCAST_ROWS = 100_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def broadcast_if_small(df: DataFrame, rows: int) -> DataFrame:
    """df, hinted for broadcast only where its counted rows are few."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def named(name: str) -> Column:
    """The column of just this name, whatever signs it holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def row_key(df: DataFrame) -> tuple[Column, Column]:
    """128 bits of a whole row, as two longs; rows that are alike in all columns have one key."""
    values = [F.to_json(F.struct(named(c))) if "map<" in kind or "variant" in kind else named(c) for c, kind in df.dtypes]
    # Each value stands beside whether it is null, so that nulls of neighbouring columns differ.
    nulls = F.concat(F.lit(""), *[F.when(named(c).isNull(), "0").otherwise("1") for c in df.columns])
    return F.xxhash64(*values, nulls), F.xxhash64(F.lit(1), nulls, *reversed(values))


def keep_rows(df: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows of df whose row_key is in keys(k1, k2), each different row once, all columns.

    Repeated rows fold where they are read, before the shuffle, so none is hot in the join."""
    k1, k2 = row_key(df)
    rows = df.select(k1.alias("k1"), k2.alias("k2"), F.struct(*map(named, df.columns)).alias("row"))
    once = rows.groupBy("k1", "k2").agg(F.first("row").alias("row"))
    return once.join(keys.select("k1", "k2"), ["k1", "k2"], "left_semi").select("row.*")


def fold(c: Column, mod: int) -> Column:
    """crc32 of an id's decimal text, modulo mod."""
    return F.pmod(F.crc32(c.cast("string")), F.lit(mod))


def sampled(c: Column, share: float, seed: int) -> Column:
    """Whether the hash of c falls into so large a share of all hashes, however small it is."""
    return F.lit(True) if share >= 1 else F.shiftrightunsigned(F.xxhash64(c, F.lit(seed)), 1) < F.lit(max(1, int(share * 2.0**63)))


def text_slices(batch, column: str, max_chars: int = 8_000_000):
    """Split an Arrow batch where its texts exceed max_chars, so that Python holds a bounded part at once."""
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if i > start and total + n > max_chars:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if len(sizes) > start:
        yield batch.slice(start)


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1_000) -> Iterator[None]:
    """Inside, what is written reaches Python in Arrow batches of so many rows, which bounds memory on both sides."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, rows)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def worker_cache(name: str) -> dict:
    """A dict that outlives the task within its Python worker."""
    import sys
    import types

    module = sys.modules.setdefault("_weftgraph_worker", types.ModuleType("_weftgraph_worker"))
    return module.__dict__.setdefault(name, {})
