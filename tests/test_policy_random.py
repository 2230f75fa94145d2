"""Policies and redaction against a plain-Python model of the service, on random texts."""

import random

from pyspark.sql import functions as F

from tamis.operators.keyword import KeywordMatcher
from tamis.operators.regex import RegexMatcher
from tamis.operators.policy import moderate, redact
from conftest import texts_df, naive_occurrences

WEIGHT = {"high": 1_000_000, "medium": 500_000, "low": 200_000}
BANK = [("ab", "t", "low", "pass"), ("bab", "t", "medium", "review"), ("é😀", "u", "high", "block"),
        ("aa", "t", "critical", "block")]
RULE = [("digits", r"\d{2,}", "num", "medium", "review")]


def model(text, mode):
    kw = sorted(((p + len(w), -len(w), w, p) for (w, p) in naive_occurrences(text, [b[0] for b in BANK])))
    kw = [(w, p, len(w)) for (_, _, w, p) in kw]
    import re
    m = re.search(r"[0-9]{2,}", text)
    rx = [("digits", m.start(), m.end() - m.start())] if m else []
    sev = {b[0]: b[2] for b in BANK}
    sev["digits"] = "medium"
    if mode == "chain":
        hits = kw or rx
        return bool(hits), len(hits), None
    if mode == "parallel":
        seen = {}
        for w, p, n in kw + rx:
            seen.setdefault(w, (p, n))
        return bool(seen), len(seen), None
    score = sum(WEIGHT.get(sev[w], 0) for (w, _, _) in kw + rx)
    return score > 500_000, 0, score / 1e6


def test_policies_match_model(spark):
    rnd = random.Random(3)
    texts = ["".join(rnd.choice("ab1 é😀") for _ in range(rnd.randint(0, 40))) for _ in range(150)]
    ms = [KeywordMatcher(BANK), RegexMatcher.from_rules(spark, RULE)]
    ms_flat = [KeywordMatcher(BANK, plan="join"), RegexMatcher.from_rules(spark, RULE)]
    for mode in ("chain", "parallel", "weighted"):
        exp = [model(t, mode) for t in texts]
        for matchers in (ms, ms_flat):
            rows = moderate(texts_df(spark, texts), matchers, mode=mode).orderBy("id").collect()
            got = [(r.flagged, r.n_hits, r.score) for r in rows]
            assert got == exp, mode


def test_redact_matches_model(spark):
    rnd = random.Random(5)
    texts = ["".join(rnd.choice("ab é😀") for _ in range(rnd.randint(0, 60))) for _ in range(120)]
    words = [b[0] for b in BANK]
    r = moderate(texts_df(spark, texts), [KeywordMatcher(BANK)], keep=("text",)).orderBy("id")
    got = [x[0] for x in r.select(redact(F.col("text"), F.col("hits"))["text"]).collect()]
    exp = []
    for t in texts:
        cover = [False] * len(t)
        for w, p in naive_occurrences(t, words):
            for i in range(p, p + len(w)):
                cover[i] = True
        exp.append("".join("*" if c else ch for ch, c in zip(t, cover)))
    assert got == exp
