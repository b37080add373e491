"""A corpus in five stages: quality, exact copies, near copies, mixing, encoding. Each stage is written and read again.

Defined results: stages decide by rows, not by doc_id, so rows of one doc_id with different texts are documents of
their own, and rows alike in all columns count once after the second stage. A null text is an empty one; an empty
or wordless text is scored like any, has one exact representative and takes no words in the mix, so it is in the
result as often as its source is copied. A null doc_id comes last among equals and is not linked to near copies;
a null source is a source; a null lang, like any other column, goes along unread. Very long texts are read whole.
Columns may have any names beside those of documents, also ones that operators use inside. An empty table gives an
empty result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from weftgraph.llm import bpe, exact_dedup, mixing, near_dedup, quality
from weftgraph.llm.common import discard, kept, leaves_result, scratch, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ranking predicts to be good; it learns from the labelled ones among its input."""
    return quality.keep_good(docs, quality.learn(docs, table(spark, sf_dir, "labels")))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each normalised text, the one with the smallest doc_id."""
    return exact_dedup.drop_exact_duplicates(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate class, the one with the smallest doc_id."""
    return near_dedup.keep_one(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mix(docs)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """For each row its number of tokens and the digests of its ids and of the bytes they decode to."""
    import public_tokenizers

    return bpe.encode_report(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [("quality", quality_stage), ("exact_dedup", exact_stage), ("near_dedup", near_stage), ("mixing", mixing_stage), ("encoding", encoding_stage)]

#: The learned quality score can't be expressed in SQL; tests hold each stage against a plain version.
ORACLE_SQL = None


@leaves_result
def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        before = docs
        with scratch(spark):
            docs = kept(stage(spark, before, sf_dir), f"pipeline-{name}")
        discard(before)
    return docs
