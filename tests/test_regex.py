from pyspark.sql import functions as F
from tamis.functions.dialect import re2_to_java, required_literal, PatternError
from tamis.operators.regex import RegexMatcher, match_rules
from tamis import fixed
from conftest import texts_df

import pytest


def rhits(spark, texts, patterns):
    m = RegexMatcher(spark, [dict(name=p, pattern=p, type="t", severity="high") for p in patterns])
    rows = m.flat_hits(texts_df(spark, texts), 0).collect()
    return sorted((r.id, r.word, r.idx, r.len) for r in rows)


def test_reference_case(spark):
    assert rhits(spark, ["hello bad world"], [r"\bbad\b"]) == [(0, r"\bbad\b", 6, 3)]


def test_leftmost_only_and_char_offsets(spark):
    assert rhits(spark, ["😀 bad bad"], ["bad"]) == [(0, "bad", 2, 3)]


def test_ascii_word_boundary_like_re2(spark):
    # RE2's \b is ASCII: 'é' is not a word character, so 'ébad' has a boundary
    assert rhits(spark, ["ébad"], [r"\bbad\b"]) == [(0, r"\bbad\b", 1, 3)]


def test_dollar_is_end_of_text(spark):
    assert rhits(spark, ["end.\n"], [r"\.$"]) == []
    assert rhits(spark, ["end."], [r"\.$"]) == [(0, r"\.$", 3, 1)]


def test_zero_length_match_is_a_hit(spark):
    assert rhits(spark, ["abc"], ["x*"]) == [(0, "x*", 0, 0)]


def test_invalid_patterns_are_skipped(spark):
    m = RegexMatcher(spark, [dict(name=p, pattern=p) for p in ["(", "(?=x)y", "a(?P<n>b)"]])
    assert [e["name"] for e in m.entries] == ["a(?P<n>b)"]
    assert len(m.skipped) == 2


def test_dialect_rewrites():
    assert re2_to_java("a.b") == "a[^\\n]b"
    assert re2_to_java("(?s)a.b") == "(?s)a.b"
    assert re2_to_java("[[:alpha:]]") == "[\\p{Alpha}]"
    assert re2_to_java("(?i)x") == "(?iu)x"
    with pytest.raises(PatternError):
        re2_to_java("a++")


def test_required_literal():
    assert required_literal(fixed.DEFAULT_RULES[0][1]) == "@"
    assert required_literal("https?://x") == "http"
    assert required_literal("a|b") is None
    assert required_literal("(?i)abc") is None


def test_default_rules_with_counts(spark):
    df = texts_df(spark, ["mail a@b.co and c@d.org", "card 1234 5678 9012 3456", "see https://x.y/z now"])
    rows = sorted((r.id, r.word, r.idx, r.len, r.n_matches)
                  for r in match_rules(spark, df, fixed.DEFAULT_RULES, all=True).collect())
    assert rows == [(0, "email_pattern", 5, 6, 2), (1, "credit_card_pattern", 5, 19, 1),
                    (2, "url_pattern", 4, 13, 1)]


def test_packed_plan_equals_unrolled(spark):
    from tamis.plans.fixtures import REGEX_BANK
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").selectExpr("doc_id AS id", "text")
    entries = [dict(name=w, pattern=w, type=t, severity=s) for (w, t, s, a) in REGEX_BANK] + \
        [dict(name=n, pattern=p, type=t, severity=s) for (n, p, t, s, a) in fixed.DEFAULT_RULES]
    a = RegexMatcher(spark, entries, plan="unrolled")
    b = RegexMatcher(spark, entries, plan="packed")
    assert b.packed and not a.packed
    ha = sorted(tuple(r) for r in a.flat_hits(df, 0).collect())
    hb = sorted(tuple(r) for r in b.flat_hits(df, 0).collect())
    assert ha == hb and len(ha) > 100


def test_packed_counts_equal_unrolled(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    a = match_rules(spark, df, fixed.DEFAULT_RULES, id_col="doc_id", all=True, plan="unrolled")
    b = match_rules(spark, df, fixed.DEFAULT_RULES, id_col="doc_id", all=True, plan="packed")
    assert sorted(tuple(r) for r in a.collect()) == sorted(tuple(r) for r in b.collect())


def test_nested_quantifier_lint():
    from tamis.functions.dialect import nested_quantifier
    assert nested_quantifier("(a+)+$") and nested_quantifier("(?:x*y)*") and nested_quantifier("((ab)+c)+")
    assert not nested_quantifier("(ab)+") and not nested_quantifier("a+b+") and not nested_quantifier("(a+)?")
    assert not any(nested_quantifier(r[1]) for r in fixed.DEFAULT_RULES)


def test_a_text_runs_only_the_patterns_whose_literal_it_holds(spark):
    entries = [dict(name=f"n{i}", pattern=f"word{i:04d}[a-z]+", type="t", severity="low") for i in range(2000)]
    entries += [dict(name="digits", pattern="[0-9]{6}", type="t", severity="low"), dict(name="twin", pattern="(x|y)word0007", type="t", severity="high")]
    m = RegexMatcher(spark, entries)
    assert m.packed
    texts = ["", "nothing", "word0007 word0007 word0007abc", "xword0007", "word0001a word0002 123456", None]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    tried = {r.id: [c.name for c in r.c] for r in df.select("id", m.candidates(F.col("text")).alias("c")).collect()}
    assert tried[1] == ["digits"] and tried[2] == ["n7", "digits", "twin"] and tried[4] == ["n1", "n2", "digits"]
    got = sorted((r.id, r.word, r.idx, r.len) for r in m.flat_hits(df, 0).collect())
    assert got == [(2, "n7", 18, 11), (3, "twin", 0, 9), (4, "digits", 19, 6), (4, "n1", 0, 9)]
