import random

from pyspark.sql import functions as F

from tamis.operators.keyword import KeywordMatcher, match_keywords, match_literal
from conftest import texts_df, naive_occurrences


def bank(*words):
    return [(w, "t", "high", "block") for w in words]


def hits(spark, texts, words, plan="inline"):
    b = bank(*words)
    if plan != "inline":
        b = spark.createDataFrame(b, "word string, type string, severity string, action string")
    rows = match_keywords(texts_df(spark, texts), b, plan=plan).collect()
    return sorted((r.id, r.word, r.idx, r.len) for r in rows)


def test_reference_cases(spark):
    assert hits(spark, ["hello bad world"], ["bad"]) == [(0, "bad", 6, 3)]
    assert len(hits(spark, ["bad bad bad"], ["bad"])) == 3
    assert hits(spark, ["abc"], ["ab", "bc"]) == [(0, "ab", 0, 2), (0, "bc", 1, 2)]
    assert hits(spark, ["hel lo bad wo rld"], ["bad"]) == [(0, "bad", 7, 3)]
    assert hits(spark, ["nothing here"], ["bad"]) == []


def test_suffix_of_non_word_prefix(spark):
    # the reference dereferences nil here; we report the one hit
    assert hits(spark, ["she"], ["shex", "he"]) == [(0, "he", 1, 2)]


def test_overlaps_and_non_ascii_positions(spark):
    assert hits(spark, ["xaaab"], ["aa"]) == [(0, "aa", 1, 2), (0, "aa", 2, 2)]
    assert hits(spark, ["敏感词 and 敏感词"], ["敏感词"]) == [(0, "敏感词", 0, 3), (0, "敏感词", 8, 3)]
    assert hits(spark, ["😀hahaha"], ["haha"]) == [(0, "haha", 1, 4), (0, "haha", 3, 4)]


def test_empty_and_null_texts(spark):
    df = spark.createDataFrame([(0, ""), (1, None)], "id long, text string")
    assert match_keywords(df, bank("a")).count() == 0


def test_plans_agree_with_naive_finder(spark):
    rnd = random.Random(7)
    alphabet = "ab😀é \n"
    texts = ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 300))) for _ in range(60)]
    texts.append("ab" * 3000)  # longer than one piece
    words = ["a", "ab", "aba", "abab", "é😀", "b a", "😀😀é", "\nab"]
    exp = sorted((i, w, p, len(w)) for i, t in enumerate(texts) for (w, p) in naive_occurrences(t, words))
    assert hits(spark, texts, words, "inline") == exp
    assert hits(spark, texts, words, "gram") == exp
    assert hits(spark, texts, words, "join") == exp


def test_literal_match_first_occurrence(spark):
    rows = match_literal(texts_df(spark, ["hello bad bad", "none"]), bank("bad", "zz")).collect()
    assert [(r.id, r.word, r.idx, r.len) for r in rows] == [(0, "bad", 6, 3)]


def test_auto_plan_switches_on_bank_size(spark):
    small = KeywordMatcher(bank(*[f"w{i}" for i in range(10)]))
    big = KeywordMatcher(bank(*[f"w{i}" for i in range(100)]))
    assert small.row_based and big.row_based and (small.plan, big.plan) == ("inline", "gram")


def test_plan_is_one_narrow_projection(spark):
    df = texts_df(spark, ["a b"])
    plan = match_keywords(df, bank("a"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan


def test_chunked_inline_matches_across_piece_borders(spark):
    rnd = random.Random(11)
    texts = ["".join(rnd.choice("ab😀 ") for _ in range(rnd.randint(0, 700))) for _ in range(20)]
    words = ["ab", "a😀b", "bab a", "😀"]
    km = KeywordMatcher(bank(*words), text_chunk=50)
    rows = km.flat_hits(texts_df(spark, texts), 0).collect()
    got = sorted((r.id, r.word, r.idx, r.len) for r in rows)
    exp = sorted((i, w, p, len(w)) for i, t in enumerate(texts) for (w, p) in naive_occurrences(t, words))
    assert got == exp


def test_literal_match_with_large_bank_keeps_first_occurrence(spark):
    words = [f"w{i:03d}" for i in range(100)] + ["bad"]
    b = spark.createDataFrame(bank(*words), "word string, type string, severity string, action string")
    rows = match_literal(texts_df(spark, ["bad w001 bad w001", "none"]), b).collect()
    assert sorted((r.id, r.word, r.idx) for r in rows) == [(0, "bad", 0), (0, "w001", 4)]


def occurrences(spark, texts, words, plan, **how):
    found = KeywordMatcher(bank(*words), plan=plan, **how).flat_hits(texts_df(spark, texts), 0).collect()
    return sorted((r.id, r.word, r.idx, r.len) for r in found)


def expected(texts, words):
    return sorted((i, w, p, len(w)) for i, t in enumerate(texts) for (w, p) in naive_occurrences(t or "", words))


def test_gram_plans_on_borders_nul_bytes_and_shared_grams(spark):
    words = ["a", "a\0", "a\0\0", "ab", "abc", "abcd", "abcde", "abcdef", "abcdefg", "abcdefgh", "abcdefghi", "abcdefghijkl", "é", "éé", "日本語", "😀" * 5, "x" * 3000]
    texts = [None, "", "a", "ab", "abcdefghijklm", "a\0\0\0", "éééé é", "日本語日本語", "😀" * 7, "abcdefg", "hijkl", "x" * 3500, "zabcdefghi" * 50, "abcdefgh"]
    for plan in ("gram", "join"):
        assert occurrences(spark, texts, words, plan) == expected(texts, words)


def test_gram_plan_on_random_texts(spark):
    rnd = random.Random(4)
    texts = ["".join(rnd.choice("abé😀\0 ") for _ in range(rnd.randint(0, 400))) for _ in range(80)]
    words = sorted({"".join(rnd.choice("abé😀\0") for _ in range(rnd.randint(1, 9))) for _ in range(300)})
    exp = expected(texts, words)
    assert occurrences(spark, texts, words, "gram") == exp and occurrences(spark, texts, words, "join") == exp


def test_two_hundred_thousand_words(spark):
    words = [f"w{i:06d}x" for i in range(150_000)] + [f"v{i}" for i in range(50_000)]
    km = KeywordMatcher(bank(*words))
    assert km.plan == "join" and not km.row_based
    texts = [" ".join(f"w{i:06d}x" for i in range(k, 200_000, 997)) + " v7 v49999" for k in range(20)] + ["w00000x v", "w000001x" * 1000]
    held = set(words)
    got = [(r.id, r.word, r.idx) for r in km.flat_hits(texts_df(spark, texts), 0).collect()]
    assert len(got) == len(set(got)) and all(w in held and texts[i][p:p + len(w)] == w for i, w, p in got)
    long = sorted(g for g in got if g[1][0] == "w")
    assert long == sorted((i, t[p:p + 8], p) for i, t in enumerate(texts) for p in range(len(t)) if t[p] == "w" and t[p:p + 8] in held)
    short = sorted(g for g in got if g[1][0] == "v")
    assert short == sorted((i, t[p:p + n], p) for i, t in enumerate(texts) for p in range(len(t)) if t[p] == "v" for n in range(2, 7) if t[p:p + n] in held and len(t[p:p + n]) == n)


def test_gram_table_needs_no_exchange_and_the_join_shuffles_no_positions(spark):
    df = texts_df(spark, ["a b"])
    plan = lambda p: match_keywords(df, bank("ab", "word"), plan=p)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan("gram") and "Join" not in plan("gram")
    assert plan("join").count("Exchange") == plan("join").count("BroadcastExchange") > 0


def test_literal_of_each_plan_agrees(spark):
    texts = ["aaa b aaa", "b", "", "xbxb"]
    for plan in ("inline", "gram", "join"):
        from tamis.operators.keyword import LiteralMatcher
        rows = LiteralMatcher(bank("a", "aa", "b"), plan=plan).flat_hits(texts_df(spark, texts), 3).collect()
        assert sorted((r.id, r.word, r.idx, r.matcher_ord) for r in rows) == [(0, "a", 0, 3), (0, "aa", 0, 3), (0, "b", 4, 3), (1, "b", 0, 3), (3, "b", 1, 3)]
