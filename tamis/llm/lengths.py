"""Exact length histogram of encoded documents (operator 3).

Every document is encoded once; only its length leaves the task. Lengths are counted with
map-side combine, so the shuffle carries one row per distinct length and task, however many
documents share a length. Suffix sums over the distinct lengths then answer, for every
context limit at once: how many documents and tokens fit, how many tokens are left after
truncation, and every quantile, all exactly.

The suffix sums go over ranges of 1,024 lengths: totals per range first (one row per range),
then a window inside each range, so no task holds more than 1,024 lengths besides the range
totals.

Edge cases. Null and empty texts have length 0. Repeated rows count each time. An empty
table gives an empty histogram. Extra columns are ignored. Special tokens' strings in a text
are ordinary text.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tamis.llm.encodings import encoding, vocabulary_path
from tamis.llm.frames import materialize, ship

_SPAN = 1024


def token_lengths(docs: DataFrame, *, text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """``n_tokens`` of every document (one column, one row per document)."""
    ship(docs.sparkSession)
    path = vocabulary or vocabulary_path("byte_bpe_50k.tiktoken")

    def run(batches):
        encode = encoding(path).encode_ordinary
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([len(encode(t.as_py())) if t.is_valid else 0 for t in b.column(0)], pa.int64())], names=["n_tokens"])

    return docs.select(docs["`" + text_col + "`"].cast("string").alias("text")).mapInArrow(run, "n_tokens long")


def length_histogram(lengths: DataFrame, col: str = "n_tokens") -> DataFrame:
    """One row per distinct length L, read as the context limit L.

    n_docs: documents of exactly L tokens; docs_within, tokens_within: documents of at most L
    and their tokens; docs_over, tokens_over: those longer; truncated_total: tokens left when
    every document is cut at L; share_within: docs_within over all documents.
    """
    n = F.col("n_tokens")
    h = (lengths.groupBy(F.col(col).cast("long").alias("n_tokens")).agg(F.count(F.lit(1)).alias("n_docs"))
         .where(n.isNotNull()).withColumn("_span", F.expr(f"n_tokens div {_SPAN}")))
    h = materialize(lengths.sparkSession, h, "lengths")  # read twice below; the documents are encoded once
    spans = h.groupBy("_span").agg(F.sum("n_docs").alias("d"), F.sum(n * F.col("n_docs")).alias("t"))
    later = Window.orderBy(F.col("_span").desc()).rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.select("_span", F.coalesce(F.sum("d").over(later), F.lit(0)).alias("_d"), F.coalesce(F.sum("t").over(later), F.lit(0)).alias("_t"),
                         F.sum("d").over(Window.partitionBy()).alias("_n"), F.sum("t").over(Window.partitionBy()).alias("_all"))
    after = Window.partitionBy("_span").orderBy(n.desc()).rowsBetween(Window.unboundedPreceding, -1)
    over = F.col("_d") + F.coalesce(F.sum("n_docs").over(after), F.lit(0))
    tokens = F.col("_t") + F.coalesce(F.sum(n * F.col("n_docs")).over(after), F.lit(0))
    return (h.join(spans, "_span").withColumn("docs_over", over).withColumn("tokens_over", tokens)
            .select("n_tokens", "n_docs", (F.col("_n") - F.col("docs_over")).alias("docs_within"),
                    (F.col("_all") - F.col("tokens_over")).alias("tokens_within"), "docs_over", "tokens_over",
                    (F.col("_all") - F.col("tokens_over") + n * F.col("docs_over")).alias("truncated_total"),
                    ((F.col("_n") - F.col("docs_over")) / F.col("_n")).alias("share_within")))


def truncated_totals(histogram: DataFrame, limits: list[int]) -> DataFrame:
    """For any context limits, also lengths that no document has: documents, tokens, truncated total."""
    n, d = F.col("n_tokens"), F.col("n_docs")
    aggs = [F.struct(F.lit(int(x)).cast("long").alias("limit"), F.coalesce(F.sum(F.when(n <= x, d)), F.lit(0)).alias("docs_within"),
                     F.coalesce(F.sum(F.least(n, F.lit(int(x))) * d), F.lit(0)).alias("truncated_total")).alias(f"l{i}") for i, x in enumerate(limits)]
    return histogram.agg(F.array(*aggs).alias("a")).select(F.inline("a"))


def length_quantiles(histogram: DataFrame, shares: list[float]) -> DataFrame:
    """The exact quantiles: the smallest length within which at least that share of the documents is."""
    q = [F.struct(F.lit(float(s)).alias("share"), F.min(F.when(F.col("share_within") >= s, F.col("n_tokens"))).alias("n_tokens")).alias(f"q{i}")
         for i, s in enumerate(shares)]
    return histogram.agg(F.array(*q).alias("a")).select(F.inline("a"))


def token_counts(docs: DataFrame, **how) -> DataFrame:
    return length_histogram(token_lengths(docs, **how))
