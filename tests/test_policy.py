import random

from pyspark.sql import functions as F

from tamis.operators.keyword import KeywordMatcher
from tamis.operators.policy import moderate, redact, declared_action
from tamis.operators.registry import row_matcher, register_matcher, get_matcher, MatcherNotFound
from conftest import texts_df

import pytest


def stub(name, hits_for_text):
    """A matcher that returns fixed hits: [(word, severity)] placed at 0."""
    def fn(t):
        return [(w, "t", sev, 0, len(w)) for (w, sev) in hits_for_text]
    return row_matcher(name, fn, register=False)


def failing(name):
    def fn(t):
        raise RuntimeError("boom")
    return row_matcher(name, fn, register=False)


def verdict(spark, matchers, mode, **kw):
    r = moderate(texts_df(spark, ["some text"]), matchers, mode=mode, **kw).first()
    return r.flagged, r.action, sorted(h.word for h in (r.hits or [])), r.score


def test_chain_stops_at_first_matcher_with_hits(spark):
    ms = [stub("none", []), stub("m1", [("bad", "high")]), stub("m2", [("worse", "high")])]
    assert verdict(spark, ms, "chain")[:3] == (True, "block", ["bad"])


def test_chain_skips_failing_matcher(spark):
    ms = [failing("f"), stub("m1", [("bad", "high")])]
    assert verdict(spark, ms, "chain")[:3] == (True, "block", ["bad"])


def test_parallel_dedupes_by_word(spark):
    ms = [stub("m1", [("bad", "high")]), stub("m2", [("bad", "high"), ("worse", "high")])]
    f, a, words, _ = verdict(spark, ms, "parallel")
    assert (f, a, words) == (True, "block", ["bad", "worse"])


def test_weighted_thresholds(spark):
    assert verdict(spark, [stub("m", [("a", "high"), ("b", "medium")])], "weighted")[:3] == (True, "block", [])
    f, a, _, s = verdict(spark, [stub("m", [("b", "medium")])], "weighted")
    assert (f, a, s) == (False, "pass", 0.5)  # 0.5 is not > 0.5
    ms = [stub("m1", [("b", "medium")]), stub("m2", [("c", "low")])]
    assert verdict(spark, ms, "weighted", threshold=0.6)[:2] == (True, "block")
    # critical weighs nothing
    assert verdict(spark, [stub("m", [("k", "critical")] * 5)], "weighted")[:2] == (False, "pass")


def test_unknown_mode_is_chain(spark):
    ms = [stub("m1", [("bad", "high")]), stub("m2", [("worse", "high")])]
    assert verdict(spark, ms, "nonsense")[:3] == (True, "block", ["bad"])


def test_null_text_gets_fallback(spark):
    df = spark.createDataFrame([(1, None)], "id long, text string")
    km = KeywordMatcher([("bad", "t", "high", "block")])
    assert moderate(df, [km], fallback="block").first().action == "block"
    r = moderate(df, [km]).first()
    assert (r.flagged, r.action) == (False, "pass")


def test_clean_texts_stay(spark):
    km = KeywordMatcher([("bad", "t", "high", "block")])
    rows = moderate(texts_df(spark, ["bad", "good", ""]), [km]).orderBy("id").collect()
    assert [(r.flagged, r.action, r.n_hits) for r in rows] == [(True, "block", 1), (False, "pass", 0),
                                                                (False, "pass", 0)]


def test_registry(spark):
    m = stub("mine", [])
    register_matcher("mine", m)
    assert get_matcher("mine") is m
    register_matcher("mine", stub("mine2", []))
    assert get_matcher("mine") is not m
    with pytest.raises(MatcherNotFound):
        get_matcher("absent")


def test_redact_merges_overlaps(spark):
    km = KeywordMatcher([(w, "t", "low", "mask") for w in ("haha", "then", "hen", "bc")])
    df = texts_df(spark, ["hahaha then x", "no hit", "😀abcd", ""])
    r = moderate(df, [km], keep=("text",))
    got = [(x.t, x.n_masked, x.n_islands) for x in
           r.select(redact(F.col("text"), F.col("hits")).alias("m")).select("m.text", "m.n_masked", "m.n_islands")
           .toDF("t", "n_masked", "n_islands").collect()]
    assert got == [("****** **** x", 10, 2), ("no hit", 0, 0), ("😀a**d", 2, 1), ("", 0, 0)]


def test_declared_action(spark):
    km = KeywordMatcher([("a", "t", "low", "review"), ("b", "t", "low", "block"), ("c", "t", "low", "pass")])
    r = moderate(texts_df(spark, ["a c", "a b", "zzz"]), [km]).orderBy("id")
    got = [x[0] for x in r.select(declared_action(F.col("hits"), km.actions())).collect()]
    assert got == ["review", "block", None]


def test_row_path_verdicts_need_no_exchange(spark):
    from tamis.operators.regex import RegexMatcher
    from tamis import fixed
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    ms = [KeywordMatcher([("bad", "t", "high", "block")]), RegexMatcher.from_rules(spark, fixed.DEFAULT_RULES)]
    for mode in ("chain", "parallel", "weighted"):
        plan = moderate(df, ms, mode=mode, id_col="doc_id")._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Join" not in plan, mode


def test_flat_path_shuffles_ids_not_texts(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    ms = [KeywordMatcher([("bad", "t", "high", "block")], plan="join")]
    r = moderate(df, ms, mode="chain", id_col="doc_id")
    ex = r._jdf.queryExecution().explainString(
        spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    for block in ex.split("\n\n"):
        if "Exchange" in block.split("\n")[0] and "hashpartitioning" in block:
            assert "text" not in block.split("Input")[1].split("\n")[0]


def test_byte_offsets(spark):
    from tamis.operators.policy import byte_offsets
    km = KeywordMatcher([("敏感词", "t", "high", "block"), ("bad", "t", "high", "block")])
    r = moderate(texts_df(spark, ["敏感词 bad"]), [km], keep=("text",))
    got = sorted((h.word, h.idx, h.len) for h in r.select(byte_offsets(F.col("text"), F.col("hits"))).first()[0])
    assert got == [("bad", 10, 3), ("敏感词", 0, 9)]


def test_failing_rows_are_counted(spark):
    m = failing("boom-count")
    moderate(texts_df(spark, ["a", "b", "c"]), [m]).collect()
    assert m.errors.value == 3


def test_dataframe_matcher_in_chain(spark):
    from tamis.operators.registry import dataframe_matcher
    from tamis.operators.keyword import match_literal

    def fn(texts, bank):
        return match_literal(texts, bank)

    m = dataframe_matcher("df-literal", fn, bank=[("bad", "t", "high", "block")])
    rows = moderate(texts_df(spark, ["a bad x", "fine"]), [stub("none", []), m], mode="chain").orderBy("id").collect()
    assert [(r.flagged, r.n_hits) for r in rows] == [(True, 1), (False, 0)]


def test_flat_path_keeps_columns(spark):
    km = KeywordMatcher([("bad", "t", "high", "block")], plan="join")
    df = spark.createDataFrame([(1, "bad bad", "x"), (2, "ok", "y")], "id long, text string, tag string")
    rows = moderate(df, [km], keep=("text", "tag")).orderBy("id").collect()
    assert [(r.flagged, r.n_hits, r.text, r.tag) for r in rows] == [(True, 2, "bad bad", "x"), (False, 0, "ok", "y")]


def test_moderate_takes_a_bank_or_names(spark):
    bank = [("bad", "t", "high", "block")]
    r = moderate(texts_df(spark, ["a bad", "ok"]), bank).orderBy("id").collect()
    assert [x.flagged for x in r] == [True, False]
    register_matcher("kw-bad", KeywordMatcher(bank))
    r = moderate(texts_df(spark, ["a bad"]), ["kw-bad"]).first()
    assert r.flagged
    with pytest.raises(MatcherNotFound):
        moderate(texts_df(spark, ["x"]), ["no-such-matcher"])


def big_bank(n=300):
    return [(f"filler{i:04d}", "t", "low", "pass") for i in range(n)] + [("bad", "t", "high", "block"), ("ad w", "u", "low", "mask")]


def test_verdicts_do_not_depend_on_the_banks_size(spark):
    small = [r for r in big_bank() if not r[0].startswith("filler")]
    df = spark.createDataFrame([("a", "a bad word here bad"), ("a", "fine"), ("b", None), ("c", "x" * 9000 + "bad")], "id string, text string")
    for mode in ("chain", "parallel", "weighted"):
        got = [sorted(moderate(df, [KeywordMatcher(b)], mode=mode, weights={"high": 1.0, "low": -0.8}, keep=("text",)).collect(), key=str) for b in (small, big_bank())]
        assert got[0] == got[1]


def test_words_of_one_and_two_characters_and_very_long_ones(spark):
    words = [chr(0x4E00 + i) + chr(0x4E10 + i) for i in range(200)] + ["敏", "z" * 9000]
    bank = [{"word": w, "type": "t", "severity": "low", "action": "review"} for w in words]
    text = "敏" + words[7] + "z" * 9001
    r = moderate(texts_df(spark, [text]), [KeywordMatcher(bank)]).first()
    assert sorted((h.word[:2], h.idx, h.len) for h in r.hits) == sorted([("敏", 0, 1), (words[7], 1, 2), ("zz", 3, 9000), ("zz", 4, 9000)])
    inline = KeywordMatcher(bank, plan="inline", text_chunk=16)
    assert inline.flat_hits(texts_df(spark, [text]), 0).count() == 4


def test_large_banks_keep_every_action_and_the_last_row_of_a_word(spark):
    m = KeywordMatcher(big_bank(6000) + [("bad", "t", "low", "mask")])
    assert len(m.actions()) == 6002 and m.actions()["bad"] == "mask"
    r = moderate(texts_df(spark, ["bad word", "filler0001", "x"]), [m]).orderBy("id")
    from tamis.operators.policy import declared_action
    assert [x[0] for x in r.select(declared_action(F.col("hits"), m.actions())).collect()] == ["mask", "pass", None]


def test_functions_register_as_matchers_and_short_tuples_are_skipped(spark):
    from tamis.operators.keyword import match_literal
    from tamis.operators.registry import row_matcher
    register_matcher("fn", lambda texts, bank: match_literal(texts, [("bad", "t", "high", "block")]))
    r = moderate(texts_df(spark, ["bad", "ok"]), ["fn"]).orderBy("id").collect()
    assert [(x.flagged, [h.word for h in x.hits]) for x in r] == [(True, ["bad"]), (False, [])]
    m = row_matcher("short", lambda t: [("w", "t")])
    assert [x.flagged for x in moderate(texts_df(spark, ["a"]), [m]).collect()] == [False]


def test_conversations_with_string_ids(spark):
    from tamis.operators.policy import moderate_conversations
    df = spark.createDataFrame([("x1", "user", "bad"), ("x2", "assistant", "ok")], "id string, role string, text string")
    got = {r.id: (r.point, r.flagged) for r in moderate_conversations(df, [KeywordMatcher([("bad", "t", "high", "block")])]).collect()}
    assert got == {"x1": ("input", True), "x2": ("output", False)}


@pytest.mark.parametrize("mode", ["chain", "parallel", "weighted"])
def test_table_path_equals_row_path_when_texts_share_ids(spark, mode):
    rows = [(1, "bad word"), (1, "clean"), (1, "bad word"), (2, None), (2, "mail a@bc.de bad"), (None, "word word"), (None, ""), (3, "x a@bc.de")]
    df = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(rows)], "id long, text string, tag int").repartition(3)
    from tamis import fixed
    from tamis.operators.regex import RegexMatcher
    bank = [("bad", "t", "high", "block"), ("word", "t", "low", "review"), ("or", "t", "medium", "mask")]
    rules = RegexMatcher.from_rules(spark, [r for r in fixed.DEFAULT_RULES if r[0] == "email_pattern"])
    got = [sorted((tuple(r) for r in moderate(df, [KeywordMatcher(bank, plan=p), rules], mode=mode, keep=("text", "tag")).collect()), key=repr) for p in ("inline", "gram", "join")]
    assert got[0] == got[1] == got[2] and len(got[0]) == len(rows)


def test_a_chain_of_tables_runs_a_matcher_on_rows_without_hits_only(spark):
    from tamis.operators.registry import dataframe_matcher
    from tamis.operators.keyword import match_keywords
    seen = []

    def second(texts, bank):
        seen.append(sorted(r.text for r in texts.collect()))
        return match_keywords(texts, bank)

    first = KeywordMatcher([("bad", "t", "high", "block")], plan="join")
    m = dataframe_matcher("second", second, bank=[("word", "t", "low", "review")], register=False)
    df = spark.createDataFrame([(1, "bad word"), (1, "a word"), (2, "none"), (2, None)], "id long, text string")
    r = sorted((x.id, x.n_hits) for x in moderate(df, [first, m], mode="chain").collect())
    assert seen == [["a word", "none"]] and r == [(1, 1), (1, 1), (2, 0), (2, 0)]


def test_tables_of_hits_are_refused_in_a_stream(spark, tmp_path):
    spark.createDataFrame([(1, "bad")], "id long, text string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id long, text string").parquet(str(tmp_path / "in"))
    with pytest.raises(ValueError, match="batch by batch"):
        moderate(stream, [KeywordMatcher([("bad", "t", "high", "block")], plan="join")])


def masked(text, spans):
    """(text, characters, islands) by painting each character; touching spans are one island."""
    paint = [False] * len(text)
    for i, n in spans:
        paint[i:i + n] = [True] * n
    return ("".join("*" if p else c for c, p in zip(text, paint)), sum(paint), sum(p and not q for p, q in zip(paint, [False, *paint])))


def test_redaction_of_rows_and_tables_equals_painting(spark, monkeypatch):
    from tamis.operators import policy
    monkeypatch.setattr(policy, "MASK_PIECE", 8)
    rng = random.Random(2)
    cases = [("", []), ("abc", []), (None, [])]
    for _ in range(60):
        text = "".join(rng.choice("aé😀 b") for _ in range(rng.randint(1, 60)))
        spans = []
        for _ in range(rng.randint(0, 8)):
            i = rng.randrange(len(text))
            spans.append((i, rng.randint(0, min(20, len(text) - i))))
        cases.append((text, spans + spans[:1]))
    texts = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(cases)], "id long, text string")
    hits = spark.createDataFrame([(k, i, n) for k, (_, spans) in enumerate(cases) for i, n in spans], "id long, idx int, len int")
    want = {k: masked(t, spans) if t is not None else (None, 0, 0) for k, (t, spans) in enumerate(cases)}
    assert {r.id: (r.text_masked, r.n_masked, r.n_islands) for r in policy.redact_hits(texts, hits).collect()} == want
    rows = texts.join(hits.groupBy("id").agg(F.collect_list(F.struct("idx", "len")).alias("hits")), "id", "left")
    rows = rows.withColumn("hits", F.coalesce("hits", F.expr("cast(array() as array<struct<idx:int,len:int>>)")))
    got = rows.select("id", policy.redact(F.col("text"), F.col("hits")).alias("m")).select("id", "m.*").where("text is not null").collect()
    assert {r.id: (r.text, r.n_masked, r.n_islands) for r in got} == {k: v for k, v in want.items() if v[0] is not None}


def test_a_text_of_ten_megabytes_is_masked_in_pieces(spark):
    from tamis.operators.policy import redact_hits
    text = ("a secret é " * 1_000_000)[:10_000_000]
    df = spark.createDataFrame([(1, text), (2, "nothing")], "id long, text string")
    from tamis.operators.keyword import match_keywords
    hits = match_keywords(df, [("secret", "t", "high", "block"), ("ret", "t", "low", "block")], plan="join")
    got = {r.id: r for r in redact_hits(df, hits).collect()}
    assert got[1].text_masked == text.replace("secret", "******") and got[1].n_islands == text.count("secret") == got[1].n_masked // 6
    assert (got[2].text_masked, got[2].n_masked, got[2].n_islands) == ("nothing", 0, 0)
