"""Verdicts over matchers that give their hits as a table, on texts that share ids.

The first matcher is a user matcher on DataFrames (the words of ``benchmark`` by an equi-join of
grams), the second one the e-mail rule. Two documents have one id each time (doc_id div 2).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tamis.operators.keyword import match_keywords
from tamis.operators.policy import moderate, redact_hits
from tamis.operators.registry import dataframe_matcher
from tamis.plans.bench_queries import derived_bank
from tamis.plans.fixtures import DOC_BANK
from tamis.plans.queries import email_matcher, read, verdict_columns

SIX = 6


def _moderated(spark, d, mode: str):
    words = dataframe_matcher("keyword", lambda texts, bank: match_keywords(texts, bank, plan="join"), bank=derived_bank(spark, d, letters=SIX), register=False)
    texts = read(spark, d, "documents").select(F.expr("doc_id div 2").alias("doc_id"), "text")
    return moderate(texts, [words, email_matcher(spark)], mode=mode, id_col="doc_id")


def matcher_table_chain(spark, d):
    return verdict_columns(_moderated(spark, d, "chain"))


def matcher_table_parallel(spark, d):
    return _moderated(spark, d, "parallel").select(
        F.col("id").alias("doc_id"), "flagged", "action", "n_hits",
        F.array_join(F.array_sort(F.transform("hits", lambda h: h["word"])), ",").alias("words"),
        F.aggregate("hits", F.lit(0).cast("long"), lambda a, h: a + h["idx"]).alias("idx_sum"))


def matcher_table_weighted(spark, d):
    return _moderated(spark, d, "weighted").select(F.col("id").alias("doc_id"), "flagged", "action", "score")


def redact_table(spark, d):
    """The texts masked from a flat HITS table with overlapping and nested spans."""
    texts = read(spark, d, "documents").select("doc_id", "text")
    r = redact_hits(texts, match_keywords(texts, DOC_BANK, id_col="doc_id", plan="join"), id_col="doc_id")
    return r.select(F.col("id").alias("doc_id"), "n_masked", "n_islands", F.length("text_masked").cast("int").alias("masked_len"), F.md5("text_masked").alias("masked_md5"))


QUERIES = {f.__name__: f for f in (matcher_table_chain, matcher_table_parallel, matcher_table_weighted, redact_table)}


def sql(base: dict[str, str]) -> dict[str, str]:
    """The oracles of the same verdicts over documents with ids of their own, each row under its shared id."""
    of = {"matcher_table_chain": "chain_verdict_1000", "matcher_table_parallel": "parallel_verdict_1000", "matcher_table_weighted": "weighted_verdict_1000"}
    return {"redact_table": base["redact_counts"]} | {k: f"SELECT * REPLACE (doc_id // 2 AS doc_id) FROM ({base[v]})" for k, v in of.items()}
