"""Driver queries: Spark plans over the generated tables.

Each entry takes (spark, sf_dir) and returns a DataFrame with flat scalar columns;
``oracle_sql()`` in ``tamis.plans.sql`` gives the DuckDB form of each.
"""

from __future__ import annotations

import os
from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession, functions as F

from tamis import fixed
from tamis.functions import text as T
from tamis.operators.grams import inlined
from tamis.operators.keyword import KeywordMatcher, match_keywords, match_literal
from tamis.operators.regex import RegexMatcher, match_rules
from tamis.operators.policy import moderate, redact, declared_action
from tamis.operators.bank import lookup, is_listed, bank_size
from tamis.operators.matchers import bank_rows
from tamis.plans.fixtures import DOC_BANK, EMAIL_RULE, REGEX_BANK
from tamis.sources.wordbank import load_word_bank, bank_from_rows, by_type
from tamis.sources.texts import spread

DATA_DIR = os.path.join(os.path.dirname(os.path.dirname(__file__)), "data")
DOC_BANK_CSV = os.path.join(DATA_DIR, "doc_bank.csv")
# fixed probe of wide characters appended to every text for normalize_text
NORMALIZE_PROBE = "Ａｂｃ１！～　x​y"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def read_stream(spark: SparkSession, sf_dir: str, name: str, files_per_batch: int | None = None) -> DataFrame:
    """The table as a stream, be it a single file or a folder of parts.

    The dot is written as a glob: a stream takes a plain path for a folder only. All that is there
    is one micro-batch unless ``files_per_batch`` is given.
    """
    stream = spark.readStream.schema(read(spark, sf_dir, name).schema)
    if files_per_batch:
        stream = stream.option("maxFilesPerTrigger", files_per_batch)
    return stream.parquet(f"{sf_dir.rstrip('/')}/{name}[.]parquet")


def docs(spark, d) -> DataFrame:
    return spread(read(spark, d, "documents").select("doc_id", "text"))


def email_matcher(spark):
    return RegexMatcher.from_rules(spark, EMAIL_RULE, name="rules")


def doc_matchers(spark):
    return [KeywordMatcher(DOC_BANK), email_matcher(spark)]


def hit_columns(hits) -> DataFrame:
    return hits.select(F.col("id").alias("doc_id"), "word", "type", "severity", "idx", "len")


def verdict_columns(r) -> DataFrame:
    return r.select(F.col("id").alias("doc_id"), "flagged", "action", F.size("hits").cast("long").alias("n_hits"),
                    F.get(F.col("hits"), 0)["matcher"].alias("decided_by"))


# ----------------------------------------------------------------------- matchers

def keyword_hits(spark, d):
    return (match_keywords(docs(spark, d), DOC_BANK, id_col="doc_id")
            .select(F.col("id").alias("doc_id"), "word", "type", "severity", "idx", "len"))


def keyword_first(spark, d):
    return (match_literal(docs(spark, d), DOC_BANK, id_col="doc_id")
            .select(F.col("id").alias("doc_id"), "word", "type", "severity", "idx", "len"))


def regex_bank_hits(spark, d):
    m = RegexMatcher.from_bank(spark, REGEX_BANK)
    return (m.flat_hits(docs(spark, d).withColumnRenamed("doc_id", "id"), 0)
            .select(F.col("id").alias("doc_id"), "word", "type", "severity", "idx", "len"))


def rule_file(spark, rules) -> DataFrame:
    """The rules written as a YAML pack to the shared folder, and loaded from it."""
    import yaml
    from tamis.session import scratch_path
    from tamis.sources.wordbank import load_rules
    path = scratch_path(spark, "rules") + ".yaml"
    pack = yaml.safe_dump({"patterns": [dict(zip(("name", "pattern", "type", "severity", "action"), r)) for r in rules]}, allow_unicode=True)
    spark.createDataFrame([(pack,)], "value string").coalesce(1).write.text(path)
    return load_rules(spark, path)


def rule_hits(spark, d):
    return (match_rules(spark, docs(spark, d), rule_file(spark, fixed.DEFAULT_RULES), id_col="doc_id", all=True)
            .select(F.col("id").alias("doc_id"), F.col("word").alias("rule"), "type", "severity", "idx", "len",
                    "n_matches"))


def rule_hits_pages(spark, d):
    pages = spread(read(spark, d, "pages").select("page_id", "html"))
    return (match_rules(spark, pages, rule_file(spark, fixed.DEFAULT_RULES), id_col="page_id", text_col="html", all=True)
            .select(F.col("id").alias("page_id"), F.col("word").alias("rule"), "type", "severity", "idx", "len",
                    "n_matches"))


# ----------------------------------------------------------------------- policies

def chain_verdict(spark, d):
    return verdict_columns(moderate(docs(spark, d), doc_matchers(spark), mode="chain", id_col="doc_id"))


def parallel_verdict(spark, d):
    r = moderate(docs(spark, d), doc_matchers(spark), mode="parallel", id_col="doc_id")
    return r.select(F.col("id").alias("doc_id"), "flagged", "action",
                    F.size("hits").cast("long").alias("n_hits"),
                    F.array_join(F.array_sort(F.transform("hits", lambda h: h["word"])), ",").alias("words"),
                    F.aggregate("hits", F.lit(0).cast("long"), lambda a, h: a + h["idx"]).alias("idx_sum"))


def weighted_verdict(spark, d):
    r = moderate(docs(spark, d), doc_matchers(spark), mode="weighted", id_col="doc_id")
    return r.select(F.col("id").alias("doc_id"), "flagged", "action", "score")


def declared(spark, d):
    ms = doc_matchers(spark)
    acts = {}
    for m in ms:
        acts.update(m.actions())
    r = moderate(docs(spark, d), ms, mode="chain", id_col="doc_id")
    return r.select(F.col("id").alias("doc_id"), declared_action(F.col("hits"), acts).alias("declared"))


def redact_counts(spark, d):
    r = moderate(docs(spark, d), [KeywordMatcher(DOC_BANK)], mode="chain", id_col="doc_id", keep=("text",))
    m = redact(F.col("text"), F.col("hits"))
    return r.select(F.col("id").alias("doc_id"), m["n_masked"].alias("n_masked"),
                    m["n_islands"].alias("n_islands"), F.length(m["text"]).cast("int").alias("masked_len"), F.md5(m["text"]).alias("masked_md5"))


def conversation_points(spark, d):
    from tamis.operators.policy import moderate_conversations
    turns = read(spark, d, "conversations").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("turn_id"), "role", "text")
    r = moderate_conversations(turns, [KeywordMatcher(DOC_BANK)], id_col="turn_id", mode="chain")
    return (r.groupBy("point")
            .agg(F.count(F.lit(1)).alias("n_turns"),
                 F.count_if(F.col("flagged")).alias("n_flagged"),
                 F.sum(F.size("hits").cast("long")).alias("n_hits")))


# ----------------------------------------------------------------------- text functions

def normalize_text(spark, d):
    t = F.concat(F.col("text"), F.lit(NORMALIZE_PROBE))
    n = T.normalize(t)
    return docs(spark, d).select("doc_id", F.md5(n).alias("h"), F.length(n).cast("int").alias("n"))


def is_ascii_q(spark, d):
    return docs(spark, d).select("doc_id", T.is_ascii("text").alias("is_ascii"))


def mask_bounds():
    s = (F.col("doc_id") % 7 - 2).cast("int")
    e = ((F.col("doc_id") % 13) * 3 - 1).cast("int")
    return s, e


def mask_head(spark, d):
    s, e = mask_bounds()
    m = T.mask("text", s, e)
    return docs(spark, d).select("doc_id", F.md5(m).alias("h"), F.length(m).cast("int").alias("n"))


RARE = ["token", "license", "zzqx"]


def contains_any_q(spark, d):
    words = [r[0] for r in DOC_BANK]
    return docs(spark, d).select("doc_id", T.contains_any("text", words).alias("any_word"),
                                 T.contains_any("text", RARE).alias("any_rare"))


def first_match_q(spark, d):
    words = [r[0] for r in DOC_BANK]
    fm = T.first_match("text", words)
    return docs(spark, d).select("doc_id", fm["idx"].alias("idx"), fm["word"].alias("word"))


# ----------------------------------------------------------------------- word bank

def tokens(spark, d) -> DataFrame:
    return (read(spark, d, "documents")
            .select("doc_id", F.explode(F.split("text", " ", -1)).alias("token"))
            .filter(F.col("token") != ""))


def doc_bank(spark):
    return bank_from_rows(spark, DOC_BANK)


def bank_lookup(spark, d):
    j = lookup(tokens(spark, d), "token", doc_bank(spark))
    return j.groupBy("doc_id", "type").agg(F.count(F.lit(1)).alias("n"))


def bank_semi(spark, d):
    listed = is_listed(tokens(spark, d), "token", doc_bank(spark)).select("doc_id")
    return read(spark, d, "documents").select("doc_id", "lang").join(listed.distinct(), "doc_id", "left_semi")


def bank_anti(spark, d):
    listed = is_listed(tokens(spark, d), "token", doc_bank(spark)).select("doc_id")
    return read(spark, d, "documents").select("doc_id", "lang").join(listed.distinct(), "doc_id", "left_anti")


def _docs_per_word(spark, d, bank_rows):
    km = KeywordMatcher(bank_rows)
    return (docs(spark, d).select("doc_id", F.inline(km.first_hits(F.col("text"), 0)))
            .select("doc_id", "word", "type"))


def bank_by_type(spark, d):
    bank = doc_bank(spark)
    per = _docs_per_word(spark, d, DOC_BANK).groupBy("type").agg(F.countDistinct("doc_id").alias("n_docs"))
    return (by_type(bank).join(per, "type", "left")
            .select("type", F.col("n_words").cast("long").alias("n_words"),
                    F.array_join("words", ",").alias("words"),
                    F.coalesce("n_docs", F.lit(0).cast("long")).alias("n_docs")))


def bank_size_q(spark, d):
    n_words = bank_size(doc_bank(spark)).first()["n_words"]  # one config-size number
    return docs(spark, d).agg(F.lit(n_words).cast("long").alias("n_words"),
                              F.count_if(T.contains_any("text", [r[0] for r in DOC_BANK])).alias("n_docs_any"))


def word_bank_csv(spark, d):
    bank, n_bad = load_word_bank(spark, DOC_BANK_CSV, mode="drop", with_bad_count=True)
    rows = bank_rows(bank)  # config-size bank behind a row limit, already deduped
    per = _docs_per_word(spark, d, rows).groupBy("word").agg(F.countDistinct("doc_id").alias("n_docs"))
    return (bank.join(per, "word", "left")
            .select("word", "type", "severity", "action",
                    F.coalesce("n_docs", F.lit(0).cast("long")).alias("n_docs"),
                    F.lit(n_bad).cast("long").alias("n_bad")))


# ----------------------------------------------------------------------- requests / responses

def standard_requests(spark, d) -> DataFrame:
    """Request bodies built from conversation turns: good ones, a bad point, a missing
    text and a text of the wrong JSON type (the shape varies with the turn)."""
    c = read(spark, d, "conversations")
    v = F.col("turn") % 5
    t = F.col("text")
    req = (F.when(v == 0, F.to_json(F.struct(t.alias("text"), F.lit("input").alias("point"),
                                             F.concat(F.lit("app-"), F.col("conv_id")).alias("app_id"))))
           .when(v == 1, F.to_json(F.struct(t.alias("text"), F.lit("output").alias("point"))))
           .when(v == 2, F.to_json(F.struct(t.alias("text"), F.col("role").alias("point"))))
           .when(v == 3, F.to_json(F.struct(F.lit("input").alias("point"))))
           .otherwise(F.to_json(F.struct(F.length(t).alias("text")))))
    return c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), req.alias("request"))


def dify_requests(spark, d) -> DataFrame:
    c = read(spark, d, "conversations")
    v = F.col("turn") % 5
    t = F.col("text")
    app = F.concat(F.lit("app-"), F.col("conv_id"))
    req = (F.when(v == 0, F.to_json(F.struct(F.lit(fixed.DIFY_POINT_INPUT).alias("point"),
                                             F.struct(app.alias("app_id"), t.alias("query")).alias("params"))))
           .when(v == 1, F.to_json(F.struct(F.lit(fixed.DIFY_POINT_OUTPUT).alias("point"),
                                            F.struct(t.alias("text")).alias("params"))))
           .when(v == 2, F.to_json(F.struct(F.concat(F.lit("app.moderation."), F.col("role")).alias("point"))))
           .when(v == 3, F.to_json(F.struct(F.struct(t.alias("query")).alias("params"))))
           .otherwise(F.to_json(F.struct(F.lit(fixed.DIFY_POINT_INPUT).alias("point"),
                                         F.struct(t.alias("text")).alias("params")))))
    return c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), req.alias("request"))


def parse_standard_q(spark, d):
    from tamis.sources.requests import parse_standard
    return parse_standard(standard_requests(spark, d)).drop("request")


def parse_dify_q(spark, d):
    from tamis.sources.requests import parse_dify
    return parse_dify(dify_requests(spark, d)).drop("request")


def render_dify_q(spark, d, style: str = "code"):
    from tamis.sources.requests import parse_dify
    from tamis.sources.render import render_dify
    p = parse_dify(dify_requests(spark, d))
    r = moderate(p, [KeywordMatcher(DOC_BANK)], mode="chain", keep=("error",))
    body = F.when(F.col("error").isNotNull(), F.to_json(F.struct(F.col("error").alias("error")))) \
        .otherwise(render_dify(F.col("flagged"), style=style))
    return r.select("id", body.alias("response"))


def render_dify_documented(spark, d):
    return render_dify_q(spark, d, style="documented")


def render_standard_q(spark, d):
    return render_bodies(standard_requests(spark, d), [KeywordMatcher(DOC_BANK)])


def render_bodies(requests, matchers) -> DataFrame:
    from tamis.sources.requests import parse_standard
    from tamis.sources.render import render_standard
    r = moderate(parse_standard(requests), matchers, mode="chain", keep=("error",))
    body = F.when(F.col("error").isNotNull(), F.to_json(F.struct(F.col("error").alias("error")))) \
        .otherwise(render_standard(F.col("flagged"), F.col("action"), F.col("hits")))
    return r.select("id", body.alias("response"))


# ----------------------------------------------------------------------- reports

def _kw_hits_flat(spark, d):
    return match_keywords(docs(spark, d), DOC_BANK, id_col="doc_id")


def hit_counts_q(spark, d):
    from tamis.operators.report import hit_counts
    return hit_counts(_kw_hits_flat(spark, d), by=("type", "severity"))


def hit_counts_rollup(spark, d):
    from tamis.operators.report import hit_counts
    return hit_counts(_kw_hits_flat(spark, d), by=("type", "word"), subtotals="rollup")


def top_words_q(spark, d):
    from tamis.operators.report import top_words
    return top_words(_kw_hits_flat(spark, d), k=2, by="type").select("type", "word", "n", "rk")


def gauge_last(spark, d):
    from tamis.operators.report import last_value
    ev = read(spark, d, "events")
    return last_value(ev, "user_id", "ts", "value", tiebreak="event_id").select(
        "user_id", "last_value", "n_events")


def gauge_level(spark, d):
    from tamis.operators.report import running_level
    ev = read(spark, d, "events")
    return running_level(ev, "user_id", "ts", "value", tiebreak="event_id", keep=("event_type",), scale=9).select(
        "event_id", "user_id", "event_type", F.col("level").cast("double").alias("level"))


def value_histogram(spark, d):
    from tamis.operators.report import histogram
    from tamis.plans.fixtures import VALUE_BUCKETS
    return histogram(read(spark, d, "events"), "value", VALUE_BUCKETS, by=("event_type",), scale=9)


def _epoch(c: str):
    """Seconds since 1970 of a TIMESTAMP_NTZ, independent of the session time zone."""
    return F.expr(f"timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {c})").alias(c)


def flag_rate_windows(spark, d):
    from tamis.operators.report import flag_rate
    r = flag_rate(read(spark, d, "events"), "ts", F.col("event_type") == "error", window="1 hour")
    return r.select(_epoch("window_start"), "n_events", "n_flagged", "rate")


def flag_rate_sliding(spark, d):
    from tamis.operators.report import flag_rate
    r = flag_rate(read(spark, d, "events"), "ts", F.col("event_type") == "error", window="3 hours",
                  slide="1 hour")
    return r.select(_epoch("window_start"), "n_events", "n_flagged", "rate")


# ----------------------------------------------------------------------- streams and user matchers

def stream_moderate(spark, d):
    return stream_verdicts(spark, d, doc_matchers(spark), "stream_moderate")


def stream_verdicts(spark, d, matchers, name: str, files_per_batch: int | None = None) -> DataFrame:
    from tamis.streaming.moderate import moderate_stream, run_available_now
    stream = read_stream(spark, d, "documents", files_per_batch=files_per_batch)
    out = verdict_columns(moderate_stream(stream.select("doc_id", "text"), matchers, mode="chain", id_col="doc_id"))
    return spark.read.parquet(run_available_now(spark, out, name))


def quota_audit_q(spark, d):
    from tamis.streaming.quota import quota_audit
    from tamis.plans.fixtures import QUOTA_RATE, QUOTA_CAPACITY
    r = quota_audit(read(spark, d, "events"), "user_id", "ts", QUOTA_RATE, QUOTA_CAPACITY, tiebreak="event_id")
    return r.select(F.col("tiebreak").alias("event_id"), F.col("key").alias("user_id"), "admitted")


def custom_matcher(spark, d):
    from tamis.operators.registry import python_find_matcher, get_matcher
    python_find_matcher(DOC_BANK)
    m = get_matcher("python_find")
    r = moderate(docs(spark, d), [m], mode="parallel", id_col="doc_id")
    return hit_columns(inlined(r, F.col("hits"), "matcher_ord"))


def stream_reload(spark, d):
    """ST2: a document stream whose bank is re-read from the CSV at every micro-batch;
    each verdict row carries the version of the bank it used."""
    from tamis.session import scratch_path
    from tamis.streaming.moderate import moderate_stream_reload
    stream = read_stream(spark, d, "documents").select("doc_id", "text")
    sink, ck = scratch_path(spark, "stream_reload"), scratch_path(spark, "stream_reload-ck")
    q = moderate_stream_reload(stream, lambda: load_word_bank(spark, DOC_BANK_CSV),
                               lambda rows: [KeywordMatcher(rows)], sink, ck, mode="chain", id_col="doc_id")
    q.awaitTermination()
    return spark.read.parquet(sink).select(F.col("id").alias("doc_id"), "flagged", "action", "n_hits",
                                           "bank_version")


def quota_audit_stream_q(spark, d):
    """ST4 stream form over parts that are out of order: each part holds the events of a period, every one moved
    later by up to ``QUOTA_DELAY`` days; two heartbeats end the stream."""
    from tamis.session import scratch_path
    from tamis.streaming.quota import quota_audit_stream
    from tamis.streaming.moderate import run_available_now
    from tamis.plans.fixtures import QUOTA_RATE, QUOTA_CAPACITY, QUOTA_DELAY, QUOTA_PARTS, QUOTA_FILE_ROWS
    events = read(spark, d, "events").select("event_id", "ts", "user_id", F.lit(False).alias("ends"))
    seen = F.col("ts") + F.expr(f"make_dt_interval(cast(pmod(xxhash64(event_id), {QUOTA_DELAY}) as int))")
    least, most = events.agg(F.min("ts"), F.max("ts")).first()
    path, files = scratch_path(spark, "quota_parts"), 1
    if least is not None:
        step = (most - least + timedelta(days=QUOTA_DELAY, seconds=1)) / QUOTA_PARTS
        part = [(seen >= F.lit(least + i * step)) & (seen < F.lit(least + (i + 1) * step)) for i in range(QUOTA_PARTS)]
        rows = events.agg(*[F.count(F.when(p, 1)) for p in part]).first()
        # a part is one micro-batch of so many files: rows are dealt in turn, so none of them is empty
        files = max(1, min(-(-max(rows) // QUOTA_FILE_ROWS), min(rows) // events.rdd.getNumPartitions()))
        for p in part:  # files are streamed in the order they were written in
            events.where(p).repartition(files).write.mode("append").parquet(path)
        for _ in range(2):  # the second one's batch runs behind the watermark that the first one moved
            end = events.limit(1).withColumns({"ts": F.lit(most + timedelta(days=QUOTA_DELAY + 1)).cast(events.schema["ts"].dataType), "ends": F.lit(True)})
            end = end.withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(files)))).drop("n")
            end.repartition(files).write.mode("append").parquet(path)
    else:
        events.write.parquet(path)
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", files).parquet(path)
    out = quota_audit_stream(stream, "user_id", "ts", QUOTA_RATE, QUOTA_CAPACITY, tiebreak="event_id", delay=f"{QUOTA_DELAY} days", heartbeat=F.col("ends"))
    res = spark.read.schema(out.schema).parquet(run_available_now(spark, out, "quota_stream"))
    return res.select(F.col("tiebreak").alias("event_id"), F.col("key").alias("user_id"), "admitted")
