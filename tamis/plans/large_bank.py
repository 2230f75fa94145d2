"""The verdict queries again with a bank of up to 1,000 words derived from ``benchmark``.

The bank is the table's most frequent words of six letters or more (ties by word), fetched
behind a row limit, so it is a bounded, config-size input that comes from the given tables.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tamis.operators.keyword import KeywordMatcher, match_keywords, match_literal
from tamis.operators.policy import declared_action, moderate, redact
from tamis.plans.bench_queries import derived_bank
from tamis.plans.queries import rule_file, docs, email_matcher, hit_columns, read, read_stream, render_bodies, standard_requests, stream_verdicts, verdict_columns

SIX = 6


def _bank(spark, d):
    return derived_bank(spark, d, letters=SIX)


def _matchers(spark, d):
    return [KeywordMatcher(_bank(spark, d)), email_matcher(spark)]


def keyword_hits_1000(spark, d):
    return hit_columns(match_keywords(docs(spark, d), _bank(spark, d), id_col="doc_id"))


def keyword_first_1000(spark, d):
    return hit_columns(match_literal(docs(spark, d), _bank(spark, d), id_col="doc_id"))


def chain_verdict_1000(spark, d):
    return verdict_columns(moderate(docs(spark, d), _matchers(spark, d), mode="chain", id_col="doc_id"))


def parallel_verdict_1000(spark, d):
    r = moderate(docs(spark, d), _matchers(spark, d), mode="parallel", id_col="doc_id")
    return r.select(F.col("id").alias("doc_id"), "flagged", "action", F.size("hits").cast("long").alias("n_hits"),
                    F.array_join(F.array_sort(F.transform("hits", lambda h: h["word"])), ",").alias("words"),
                    F.aggregate("hits", F.lit(0).cast("long"), lambda a, h: a + h["idx"]).alias("idx_sum"))


def weighted_verdict_1000(spark, d):
    r = moderate(docs(spark, d), _matchers(spark, d), mode="weighted", id_col="doc_id")
    return r.select(F.col("id").alias("doc_id"), "flagged", "action", "score")


def declared_action_1000(spark, d):
    ms = _matchers(spark, d)
    acts = {w: a for m in ms for w, a in m.actions().items()}
    r = moderate(docs(spark, d), ms, mode="chain", id_col="doc_id")
    return r.select(F.col("id").alias("doc_id"), declared_action(F.col("hits"), acts).alias("declared"))


def redact_1000(spark, d):
    r = moderate(docs(spark, d), [KeywordMatcher(_bank(spark, d))], mode="chain", id_col="doc_id", keep=("text",))
    m = redact(F.col("text"), F.col("hits"))
    return r.select(F.col("id").alias("doc_id"), m["n_masked"].alias("n_masked"), m["n_islands"].alias("n_islands"),
                    F.length(m["text"]).cast("int").alias("masked_len"), F.md5(m["text"]).alias("masked_md5"))


def render_standard_1000(spark, d):
    return render_bodies(standard_requests(spark, d), [KeywordMatcher(_bank(spark, d))])


def stream_moderate_1000(spark, d):
    return stream_verdicts(spark, d, _matchers(spark, d), "stream_moderate_1000")


def stream_reload_1000(spark, d):
    from tamis.session import scratch_path
    from tamis.streaming.moderate import moderate_stream_reload
    stream = read_stream(spark, d, "documents").select("doc_id", "text")
    sink, ck = scratch_path(spark, "stream_reload_1000"), scratch_path(spark, "stream_reload_1000-ck")
    moderate_stream_reload(stream, lambda: _bank(spark, d), lambda rows: [KeywordMatcher(rows)], sink, ck, mode="chain", id_col="doc_id").awaitTermination()
    return spark.read.parquet(sink).select(F.col("id").alias("doc_id"), "flagged", "action", "n_hits")


def bank_words(spark, d):
    from tamis.operators.bank import words
    from tamis.sources.wordbank import bank_from_rows
    return words(bank_from_rows(spark, _bank(spark, d)))


def severity_weights(spark, d):
    from tamis.functions.text import severity_weight
    s = F.element_at(F.array(*[F.lit(x) for x in ("low", "medium", "high", "critical")]), (F.col("event_id") % 4 + 1).cast("int"))
    return (read(spark, d, "events").select(s.alias("severity")).groupBy("severity")
            .agg(F.count(F.lit(1)).alias("n"), F.sum((severity_weight("severity") * 10).cast("long")).alias("tenths")))


def null_text_fallback(spark, d):
    from tamis.plans.fixtures import DOC_BANK
    t = docs(spark, d).withColumn("text", F.when(F.col("doc_id") % 3 != 0, F.col("text")))
    return moderate(t, [KeywordMatcher(DOC_BANK)], fallback="block", id_col="doc_id").select(F.col("id").alias("doc_id"), "flagged", "action")


def derived_rules(spark, d) -> list[tuple]:
    """Two patterns for each word of the bank: the word with a longer ending, and the word closing a phrase."""
    out = []
    for word, kind, severity, action in _bank(spark, d):
        out.append((word + "+", word + "[a-z]{1,3}", kind, severity, action))
        out.append((word + ".", "[[:alpha:]]+ " + word + "[.,]", kind, severity, action))
    return out


def rule_pack_2000(spark, d):
    """A rule file of up to 2,000 patterns; each text runs only those whose required literal it holds."""
    from tamis.operators.regex import match_rules
    hits = match_rules(spark, docs(spark, d), rule_file(spark, derived_rules(spark, d)), id_col="doc_id", all=True)
    return hits.select(F.col("id").alias("doc_id"), F.col("word").alias("rule"), "type", "severity", "idx", "len", "n_matches")


QUERIES = {f.__name__: f for f in (keyword_hits_1000, keyword_first_1000, chain_verdict_1000, parallel_verdict_1000, weighted_verdict_1000,
                                   declared_action_1000, redact_1000, render_standard_1000, stream_moderate_1000, stream_reload_1000,
                                   rule_pack_2000, bank_words, severity_weights, null_text_fallback)}

#: The same bank as a DuckDB common table expression.
BANK_SQL = r"""words AS (SELECT w, count(*) AS n FROM (SELECT unnest(regexp_split_to_array(lower(text), '[^\p{L}]+')) AS w FROM benchmark)
          WHERE length(w) >= 6 GROUP BY w ORDER BY n DESC, w LIMIT 1000),
bank AS (SELECT w AS word, 'derived' AS type, ['low', 'medium', 'high'][i % 3 + 1] AS severity,
                ['review', 'mask', 'block', 'pass'][i % 4 + 1] AS action
         FROM (SELECT w, CAST(row_number() OVER (ORDER BY n DESC, w) - 1 AS INTEGER) AS i FROM words))"""


def sql(base: dict[str, str], small_bank: str) -> dict[str, str]:
    """The oracles of the ten-word queries over the larger bank."""
    of = {"keyword_hits_1000": "keyword_hits", "keyword_first_1000": "keyword_first", "chain_verdict_1000": "chain_verdict",
          "parallel_verdict_1000": "parallel_verdict", "weighted_verdict_1000": "weighted_verdict", "declared_action_1000": "declared_action",
          "redact_1000": "redact_counts", "render_standard_1000": "render_standard", "stream_moderate_1000": "chain_verdict"}
    out = {k: base[v].replace(small_bank, BANK_SQL) for k, v in of.items()}
    out["stream_reload_1000"] = f"SELECT doc_id, flagged, action, CASE WHEN decided_by = 'rules' THEN 0 ELSE n_hits END AS n_hits FROM ({out['chain_verdict_1000']})"
    out["stream_reload_1000"] = f"""SELECT doc_id, n_hits > 0 AS flagged, CASE WHEN n_hits > 0 THEN 'block' ELSE 'pass' END AS action, n_hits
FROM ({out['stream_reload_1000']})"""
    out["rule_pack_2000"] = f"""WITH {BANK_SQL},
r AS (SELECT word, word || '+' AS name, word || '[a-z]{{1,3}}' AS pattern, type, severity FROM bank
      UNION ALL SELECT word, word || '.', '[[:alpha:]]+ ' || word || '[.,]', type, severity FROM bank)
SELECT t.doc_id, r.name AS rule, r.type, r.severity, CAST(length(regexp_extract(t.text, '^((?s:.*?))(?:' || r.pattern || ')', 1)) AS INTEGER) AS idx,
       CAST(length(regexp_extract(t.text, r.pattern, 0)) AS INTEGER) AS len, CAST(len(regexp_extract_all(t.text, r.pattern)) AS INTEGER) AS n_matches
FROM documents t JOIN r ON contains(t.text, r.word) AND regexp_matches(t.text, r.pattern)"""
    return out
