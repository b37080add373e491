"""Exact de-duplication by skew-safe combining, in DataFrame operations only.

Texts are equal when identical after replacing each run of white space by one space; null counts as
empty. Three stages compare the whole normalised text, never the digest alone:

1. local: the map-side half of the salted aggregation folds copies that meet in one task;
2. salted: (digest, salt, text) groups merge, so a hot group is dealt over ``salts`` tasks;
3. global: at most ``salts`` winners of each text merge into one.

Every row then finds its winner. Stage 3 also tells whether any digest stands for two texts: if none does, a
digest is as good as its text and the rows join by it, else by digest and text. A hot digest on the row side
of this join is split by AQE.

The report names the row that stays by doc_id. drop_exact_duplicates() decides by rows: of each text exactly
one stays, that of smallest doc_id (rows without one come last), ties by the hash of the whole row.

Defined results: an empty table gives an empty report; in the report rows whose doc_id is null never stay
unless the whole group has none (keep_id is then null and all its rows stay), and repeated rows of one doc_id
and text each carry that row's decision and count in group_size; rows of one doc_id with different texts are
decided each by its text; a very long text is compared whole, its digest is what the last join ships; other
columns, whatever their names, are not read by the report and decide ties in drop_exact_duplicates.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, keep_rows, materialize, named, row_key

SALTS = 64


def normalised(text: Column) -> Column:
    text = F.coalesce(text, F.lit(""))
    plain = ~text.rlike(r"[\x09-\x0D]|\x20\x20")
    return F.when(plain, text).otherwise(F.regexp_replace(text, SPACE, " "))


def sha256(norm: Column) -> Column:
    return F.sha2(norm, 256)


def _winners(keyed: DataFrame, first: Column, salts: int) -> DataFrame:
    """digest, norm, first, n: of each text of keyed(digest, norm, spread, ...) the least ``first`` and the number of rows."""
    salted = keyed.withColumn("salt", F.pmod(F.xxhash64("spread"), F.lit(salts))).groupBy("digest", "salt", "norm").agg(F.min(first).alias("first"), F.count(F.lit(1)).alias("n"))
    return salted.groupBy("digest", "norm").agg(F.min("first").alias("first"), F.sum("n").alias("n"))


def duplicate_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row. digest is what texts are grouped by beside themselves."""
    keyed = docs.select(named(id_col).alias("doc_id"), normalised(named(text_col)).alias("norm")).select("doc_id", "norm", digest(F.col("norm")).alias("digest"), F.col("doc_id").alias("spread"))
    texts = _winners(keyed, F.col("doc_id"), salts)
    by_digest = texts.groupBy("digest").agg(F.min("first").alias("keep_id"), F.sum("n").alias("group_size"), F.count(F.lit(1)).alias("texts"))
    winners = materialize(by_digest, "exact-winners")
    if winners.filter("texts > 1").isEmpty():
        rows, on = keyed.select("doc_id", "digest", (F.col("digest") if digest is sha256 else sha256(F.col("norm"))).alias("text_sha256")), ["digest"]
    else:  # some digest stands for several texts: compare the texts as well
        winners = materialize(texts.select("digest", "norm", F.col("first").alias("keep_id"), F.col("n").alias("group_size")), "exact-winners")
        rows, on = keyed.select("doc_id", "digest", "norm", sha256(F.col("norm")).alias("text_sha256")), ["digest", "norm"]
    return rows.join(winners, on).select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """The rows of docs that stay, one of each text, all columns."""
    k1, k2 = row_key(docs)
    keyed = docs.select(named(id_col).alias("doc_id"), normalised(named(text_col)).alias("norm"), k1.alias("k1"), k2.alias("k2"))
    keyed = keyed.select("doc_id", "norm", digest(F.col("norm")).alias("digest"), "k1", "k2", F.col("k1").alias("spread"))
    first = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "k1", "k2")
    return keep_rows(docs, materialize(_winners(keyed, first, salts).select("first.k1", "first.k2"), "exact-kept"))
