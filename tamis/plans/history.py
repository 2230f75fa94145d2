"""A bank that changes over time: verdicts of a stream of texts, each by the bank of its own time.

The change log holds the words of ``benchmark`` (six letters or more, by frequency): a word enters on day 1, 8 or 15, every
third one gets another severity on day 15, every fifth one leaves on day 22. Documents are texts of
28 days, streamed in parts that mix all days.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, functions as F

from tamis.operators.history import BankHistory, moderate_as_of
from tamis.plans.bench_queries import derived_bank
from tamis.plans.large_bank import SIX
from tamis.plans.queries import read
from tamis.session import scratch_path
from tamis.streaming.moderate import moderate_stream_history

START = datetime(2024, 1, 1)
PARTS = 4
#: Bytes of text in a file of the stream, about.
FILE_BYTES = 32 << 20


def _on(day) -> F.Column:
    return F.lit(START).cast("timestamp_ntz") + F.make_dt_interval(day)


def change_log(spark, d) -> DataFrame:
    """(at, word, type, severity, action, removed), from the words' ranks."""
    words = spark.createDataFrame([(i, *w) for i, w in enumerate(derived_bank(spark, d, letters=SIX))], "i int, word string, type string, severity string, action string")
    row = lambda day, severity, removed: F.struct(_on(day).alias("at"), "word", "type", severity.alias("severity"), "action", F.lit(removed).alias("removed"))
    enters = row(F.lit(1) + 7 * (F.col("i") % 3), F.col("severity"), False)
    changes = F.when(F.col("i") % 3 == 0, row(F.lit(15), F.lit("critical"), False))
    leaves = F.when(F.col("i") % 5 == 0, row(F.lit(22), F.col("severity"), True))
    return words.select(F.explode(F.array_compact(F.array(enters, changes, leaves))).alias("c")).select("c.*")


def dated(spark, d) -> DataFrame:
    return read(spark, d, "documents").select("doc_id", "text", (_on((F.col("doc_id") % 28).cast("int")) + F.expr("INTERVAL '12' HOUR")).alias("ts"))


def _columns(r: DataFrame) -> DataFrame:
    critical = F.size(F.filter("hits", lambda h: h["severity"] == "critical")).cast("long")
    return r.select(F.col("id").alias("doc_id"), "bank_version", "flagged", "action", "n_hits", critical.alias("n_critical"))


def as_of_verdict(spark, d):
    return _columns(moderate_as_of(dated(spark, d), BankHistory(change_log(spark, d)), id_col="doc_id"))


def files_per_part(texts: DataFrame, file_bytes: int = FILE_BYTES) -> int:
    """Files that a part is written in, so that a file has about ``file_bytes`` of text however large the table is."""
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(1, -(-size // (PARTS * file_bytes)))


def stream_as_of(spark, d):
    """The same from a stream of parts, with the log read from its table at every micro-batch."""
    texts, log = scratch_path(spark, "dated"), scratch_path(spark, "bank_log")
    files = files_per_part(dated(spark, d))
    dated(spark, d).repartition(PARTS * files).write.parquet(texts)
    change_log(spark, d).write.parquet(log)
    stream = spark.readStream.schema(dated(spark, d).schema).option("maxFilesPerTrigger", files).parquet(texts)
    sink, ck = scratch_path(spark, "as_of"), scratch_path(spark, "as_of-ck")
    moderate_stream_history(stream, lambda: spark.read.parquet(log), sink, ck, id_col="doc_id").awaitTermination()
    return _columns(spark.read.parquet(sink))


QUERIES = {f.__name__: f for f in (as_of_verdict, stream_as_of)}


def sql(base: dict[str, str], bank_sql: str) -> dict[str, str]:
    text = f"""WITH {bank_sql},
w AS (SELECT w AS word, CAST(row_number() OVER (ORDER BY n DESC, w) - 1 AS INTEGER) AS i FROM words),
log AS (SELECT word, 1 + 7 * (i % 3) AS day, ['low', 'medium', 'high'][i % 3 + 1] AS severity, false AS removed FROM w
        UNION ALL SELECT word, 15, 'critical', false FROM w WHERE i % 3 = 0
        UNION ALL SELECT word, 22, NULL, true FROM w WHERE i % 5 = 0),
ranges AS (SELECT *, coalesce(lead(day) OVER (PARTITION BY word ORDER BY day), 1000) AS until FROM log),
versions AS (SELECT day, row_number() OVER (ORDER BY day) AS v FROM (SELECT DISTINCT day FROM log)),
h AS ({base["keyword_hits_1000"]}),
n AS (SELECT h.doc_id, count(*) AS n, count(*) FILTER (r.severity = 'critical') AS c FROM h JOIN ranges r ON r.word = h.word AND NOT r.removed
      AND r.day <= h.doc_id % 28 + 0.5 AND h.doc_id % 28 + 0.5 < r.until GROUP BY h.doc_id)
SELECT d.doc_id, CAST(coalesce((SELECT max(v) FROM versions WHERE day <= d.doc_id % 28 + 0.5), 0) AS INTEGER) AS bank_version, coalesce(n.n, 0) > 0 AS flagged,
       CASE WHEN coalesce(n.n, 0) > 0 THEN 'block' ELSE 'pass' END AS action, CAST(coalesce(n.n, 0) AS BIGINT) AS n_hits, CAST(coalesce(n.c, 0) AS BIGINT) AS n_critical
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id"""
    return {"as_of_verdict": text, "stream_as_of": text}
