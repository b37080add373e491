"""The thin opN queries over the test tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, exact_dedup, html_text, lang_id, mixing, near_dedup, pii, quality, token_output
from .common import fold, leaves_result, table


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.duplicate_report(table(spark, sf_dir, "documents"))


def op6_pareto_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(table(spark, sf_dir, "documents"))


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def held_out(mod: int, rest: int):
    return F.coalesce(fold(F.col("doc_id"), mod) == rest, F.lit(False)).alias("held_out")


def op3_bradley_terry_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = quality.score_report(docs, quality.learn(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(4, 2), "score", "predicted")


def op1_semi_markov_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.span_report(table(spark, sf_dir, "documents"), pii.train())


def op2_pruned_graph_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op4_dart_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.classes(table(spark, sf_dir, "documents"))


def op8_site_template_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.text_report(table(spark, sf_dir, "pages"))


def op9_chain_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return lang_id.language_report(docs, lang_id.learn(docs)).select("doc_id", held_out(5, 0), "lang_pred", "score")


def op5_sorted_token_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output.token_report(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"))


def op7_chunked_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.encode_report(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


QUERIES = {
    f.__name__: leaves_result(f)
    for f in (
        op1_semi_markov_pii, op2_pruned_graph_neighbours, op3_bradley_terry_quality, op4_dart_near_dedup, op5_sorted_token_table,
        op6_pareto_mix, op7_chunked_bpe, op8_site_template_text, op9_chain_language, op10_exact_dedup,
    )
}

SQL = {
    "op10_exact_dedup": r"""
        WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
        SELECT doc_id, min(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
               doc_id IS NOT DISTINCT FROM min(doc_id) OVER (PARTITION BY norm) AS kept, sha256(norm) AS text_sha256
        FROM t""",
    "op6_pareto_mix": r"""
        WITH d AS (
            SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
                   (('0x' || substr(md5('mix1:' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0::DOUBLE AS u
            FROM documents),
        s AS (
            SELECT source, sum(size)::BIGINT AS source_size,
                   ([1.0, 2.0, 3.0])[((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS w
            FROM d GROUP BY source),
        r AS (SELECT *, source_size * 3.0::DOUBLE AS cap, source_size * 3.0::DOUBLE / w AS ratio FROM s),
        l AS (
            SELECT *, ((SELECT sum(source_size) FROM r)::DOUBLE - coalesce(sum(cap) OVER before, 0.0)) / ((SELECT sum(w) FROM r) - coalesce(sum(w) OVER before, 0.0)) AS lam
            FROM r WINDOW before AS (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
        f AS (SELECT lam AS water FROM l WHERE lam <= ratio ORDER BY ratio, source NULLS LAST LIMIT 1),
        t AS (SELECT source, source_size, CASE WHEN water IS NULL OR ratio < water THEN cap ELSE water * w END AS target FROM l LEFT JOIN f ON true),
        p AS (
            SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS rate, floor(CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END)::BIGINT AS whole FROM t),
        q AS (
            SELECT d.doc_id, d.source, d.size, p.source_size, p.target, p.whole, p.rate - p.whole AS pi, p.target - p.whole * p.source_size AS due,
                   CASE WHEN p.rate > p.whole THEN (u / (1.0 - u)) / ((p.rate - p.whole) / (1.0 - (p.rate - p.whole))) END AS q
            FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source),
        g AS (SELECT source, q, doc_id, sum(size) AS words, max(due) AS due FROM q WHERE pi > 0 GROUP BY source, q, doc_id),
        c AS (
            SELECT source, q, doc_id, sum(words) OVER (PARTITION BY source ORDER BY q, doc_id NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - words + words / 2 <= due AS drawn FROM g)
        SELECT q.doc_id, q.size, q.source_size, q.target, q.whole + coalesce(c.drawn, false)::BIGINT AS copies,
               ((q.whole + coalesce(c.drawn, false)::BIGINT) * q.size)::BIGINT AS taken
        FROM q LEFT JOIN c ON q.source IS NOT DISTINCT FROM c.source AND q.q = c.q AND q.doc_id IS NOT DISTINCT FROM c.doc_id""",
}
