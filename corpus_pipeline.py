"""Documents to packed training sequences: toxicity, near-dedup, substring dedup, packing.

Each stage reads all that its predecessor kept. Stages are written as Parquet under the
shared folder and read again, so a lost executor costs the running stage only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tamis.llm.frames import materialize, table
from tamis.llm.minmax import link_near_duplicates
from tamis.llm.packing import packing
from tamis.llm.substring import remove_repeats
from tamis.llm.toxicity import fit_toxicity, held_out, score_documents

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the toxicity threshold. The model is fitted on the labelled rows not held out."""
    model = fit_toxicity(docs, table(spark, sf_dir, "labels"), train_on=lambda i: ~held_out(i))
    return score_documents(docs, model, score_col="_toxicity").where(F.col("_toxicity") < 0.3).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the smallest doc_id.

    Where a doc_id is null or occurs again, rows are numbered and linked by their texts only. The row
    kept has the smallest doc_id of its group (null after all others), then the smallest hash of its
    text, then the smallest number; different texts under one doc_id both stay.
    """
    n, ids = docs.agg(F.count(F.lit(1)), F.countDistinct("doc_id")).first()
    if n == ids:
        kept = link_near_duplicates(docs).where("kept").select("doc_id")
        return docs.join(kept, "doc_id", "left_semi").select(*COLUMNS)
    rows = materialize(spark, docs.withColumn("_row", F.monotonically_increasing_id()), "rows")
    linked = link_near_duplicates(rows, id_col="_row").select(F.col("doc_id").alias("_row"), "component_id")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", F.xxhash64("text"), "_row")
    least = rows.join(linked, "_row").groupBy("component_id").agg(F.min(order)["_row"].alias("_row"))
    return rows.join(least, "_row", "left_semi").select(*COLUMNS)


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the 13-word windows that an earlier document has; documents of which nothing is left go."""
    out = remove_repeats(docs)
    text = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text"))
    out = out.where("n_removed = 0 or n_removed < n_words").withColumn("text", text)
    n = F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("n_chars"))
    return out.withColumn("n_chars", n.cast(docs.schema["n_chars"].dataType)).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences."""
    return packing(docs)


STAGES = [("toxicity", drop_toxic), ("minhash_near_dedup", drop_near_duplicates),
          ("substring_dedup", drop_repeats), ("packing", pack)]

ORACLE_SQL = None  # a trained classifier and a tokenizer are not SQL; tests hold a brute-force version against it


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(spark, stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
