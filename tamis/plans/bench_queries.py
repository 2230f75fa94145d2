"""Extra bench-only queries: keyword match with a 1,000-word bank.

The bank is derived by Spark from the ``benchmark`` table (its 1,000 most frequent
words of 4+ letters, ties by word), fetched behind a row limit, so it is a bounded,
config-size input that still comes from the given tables.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tamis.operators.keyword import match_keywords
from tamis.plans.queries import read, docs


def derived_bank(spark, d, n: int = 1000, letters: int = 4) -> list[tuple]:
    words = (read(spark, d, "benchmark")
             .select(F.explode(F.split(F.lower("text"), "[^\\p{L}]+")).alias("w"))
             .filter(F.length("w") >= letters)
             .groupBy("w").agg(F.count(F.lit(1)).alias("n"))
             .orderBy(F.col("n").desc(), F.col("w")).limit(n).collect())
    sev = ("low", "medium", "high")
    act = ("review", "mask", "block", "pass")
    return [(r["w"], "derived", sev[i % 3], act[i % 4]) for i, r in enumerate(words)]


def keyword_hits_1000(spark, d):
    bank = derived_bank(spark, d)
    return (match_keywords(docs(spark, d), bank, id_col="doc_id")
            .select(F.col("id").alias("doc_id"), "word", "type", "severity", "idx", "len"))


def corpus_stats(spark, d) -> dict:
    r = docs(spark, d).agg(F.count(F.lit(1)).alias("texts"), F.sum(F.length("text")).alias("chars")).first()
    return {"texts": int(r["texts"]), "chars": int(r["chars"] or 0)}


def queries() -> dict:
    return {"keyword_hits_1000": keyword_hits_1000, "line_verdicts": line_verdicts}


def line_texts(spark, d):
    """Every line of every document as its own short text (id = doc_id * 1e6 + line)."""
    from tamis.sources.texts import spread
    doc = spread(read(spark, d, "documents").select("doc_id", "text"))
    return doc.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("ln", "line")) \
        .select((F.col("doc_id") * 1_000_000 + F.col("ln")).alias("id"), F.col("line").alias("text"))


def line_verdicts(spark, d):
    """Chain verdict (10-word bank + e-mail rule) per line: the service's request shape."""
    from tamis.operators.policy import moderate
    from tamis.plans.queries import doc_matchers
    r = moderate(line_texts(spark, d), doc_matchers(spark), mode="chain")
    return r.select("id", "flagged", "action", "n_hits")


def line_stats(spark, d) -> dict:
    r = line_texts(spark, d).agg(F.count(F.lit(1)).alias("n"), F.avg(F.length("text")).alias("avg")).first()
    return {"lines": int(r["n"]), "avg_chars": float(r["avg"] or 0)}
