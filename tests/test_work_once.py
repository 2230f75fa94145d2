"""Arrays of hits are worked out once, in slices; patterns are searched for once; streams are written in bounded files."""

import contextlib
import io

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tamis.functions.dialect import free_of_context, literal_tail
from tamis.operators import grams, registry
from tamis.operators.keyword import KeywordMatcher, match_keywords
from tamis.operators.regex import RegexMatcher, match_rules

TEXTS = [(1, "a thenx then. thenyyyy b then"), (1, "éé then, thené then. THEN"), (2, None), (3, ""), (None, "hathen.then"), (4, "x" * 5000 + "thenz then\n" + "é" * 3000 + " then,")]
RULES = [("end", "then[a-z]{1,3}", "t", "low", "pass"), ("stop", "[[:alpha:]]+ then[.,]", "t", "high", "block"), ("not", "then[^a-z]", "t", "low", "pass"),
         ("class", "then[é]?[.]", "t", "low", "pass"), ("anchor", "then$", "t", "low", "pass"), ("esc", r"\bthen\b", "t", "low", "pass"), ("rep", "hat?hen{1,2}[.]", "t", "low", "pass"),
         ("any", "[é]*", "t", "low", "pass"), ("alt", "xthen|then,", "t", "low", "pass"), ("line", "then\n[é]+ then", "t", "low", "pass")]


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame(TEXTS, "id long, text string")


def plan(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain()
    return out.getvalue()


def rows(df):
    return sorted(map(str, df.collect()))


def test_candidates_and_hits_are_worked_out_once(spark, texts):
    user = registry.row_matcher("user", lambda t: [("then", "t", "low", t.find("then"), 4)] if "then" in t else [], register=False)
    for df in (match_keywords(texts, [("then", "t", "low", "pass")], plan="join"), match_keywords(texts, [("then", "t", "low", "pass")], plan="gram"), user.flat_hits(texts, 0),
               match_rules(spark, texts, RULES, all=True, plan="packed")):
        assert plan(df).count("ArrowEvalPython") == 1
        assert df.count() > 0


def test_results_leave_by_slices(spark, monkeypatch):
    texts = pa.array(["then " * 100_000, None, "", "then"] * 4)
    seen = []
    monkeypatch.setattr(grams, "find_candidates", lambda part, f: seen.append(len(part)) or pa.nulls(len(part)))
    out = list(grams.candidates_udf(["then"]).func(iter([texts])))
    assert len(out) == len(seen) > 1 and sum(seen) == len(texts)


@pytest.mark.parametrize("all", [False, True])
def test_a_packed_rule_file_finds_what_single_rules_find(spark, texts, all):
    assert rows(match_rules(spark, texts, RULES, all=all, plan="packed")) == rows(match_rules(spark, texts, RULES, all=all, plan="unroll"))


def test_a_pack_tries_a_pattern_only_where_its_end_follows(spark, texts):
    m = RegexMatcher.from_rules(spark, [RULES[0], RULES[1]], plan="packed")
    got = texts.where("id = 3 or text like '%hathen%'").select(F.size(m.candidates(F.col("text"))).alias("n")).collect()
    assert [r.n for r in got] == [0, 0]


def test_literal_tail_is_conservative():
    assert literal_tail("then[a-z]{1,3}", "then") == ("then[a-z]{1,3}", 3, True)
    assert literal_tail("[[:alpha:]]+ then[.,]", " then") == (" then[.,]", 1, False)
    for p in ("then*", "then+", "(then)", "then.", "then$", r"then\d", "then|x", "[then]", "then[a-z]{1,900}", "then[a-z]+", "then{2}"):
        assert literal_tail(p, "then") is None, p
    assert free_of_context("[^a]b[.,]") and not any(map(free_of_context, ("^a", "a$", r"\ba", "(^a)")))


def test_files_of_a_stream_are_bounded(spark, texts):
    from tamis.plans.history import files_per_part
    assert files_per_part(texts) == 1 and files_per_part(texts.where("false")) == 1
    assert files_per_part(texts, file_bytes=500) > 5


def test_the_quota_stream_may_take_many_files(spark, monkeypatch):
    from tamis.plans import fixtures, queries
    sf = "/root/testdata/sf0.001"
    one = rows(queries.quota_audit_stream_q(spark, sf))
    monkeypatch.setattr(fixtures, "QUOTA_FILE_ROWS", 3)
    assert rows(queries.quota_audit_stream_q(spark, sf)) == one


def test_keys_of_one_group_keep_their_own_buckets(spark, tmp_path):
    import datetime as dt
    from tamis.streaming.moderate import run_available_now
    from tamis.streaming.quota import quota_audit, quota_audit_stream
    base = dt.datetime(2024, 1, 1)
    data = [(None if i % 7 == 0 else float(i % 7), base + dt.timedelta(seconds=i), None if i % 5 == 0 else i, False) for i in range(60)]
    beat = (2.0, base + dt.timedelta(days=9), -1, True)
    schema = "k double, ts timestamp, e long, beat boolean"
    for part in (data[:25], data[25:], [beat], [beat]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path))
    out = quota_audit_stream(stream, "k", "ts", 0.0, 3, tiebreak="e", heartbeat=F.col("beat"), groups=2)
    got = spark.read.parquet(run_available_now(spark, out, "groups")).select("key", "tiebreak", "admitted")
    exp = quota_audit(spark.createDataFrame(data, schema), "k", "ts", 0.0, 3, tiebreak="e").select("key", "tiebreak", "admitted")
    assert rows(got) == rows(exp)
