"""T1-T5 against plain-Python models, on random texts with wide and special characters."""

import random

from pyspark.sql import functions as F

from tamis.functions import text as T

ALPHA = ["a", "b", "é", "😀", "　", "​", "Ａ", "～", " ", "\n", "ab", "ba"]


def py_mask(t, s, e):
    s, e = max(s, 0), min(e, len(t))
    return t if s >= e else t[:s] + "*" * (e - s) + t[e:]


def py_normalize(t):
    out = []
    for ch in t:
        c = ord(ch)
        if 0xFF01 <= c <= 0xFF5E:
            out.append(chr(c - 0xFEE0))
        elif c == 0x3000:
            out.append(" ")
        elif c != 0x200B:
            out.append(ch)
    return "".join(out)


def py_first(t, words):
    best = (-1, "")
    for w in words:
        i = t.find(w)
        if i >= 0 and (best[0] == -1 or i < best[0]):
            best = (i, w)
    return best


def test_text_functions_match_models(spark):
    rnd = random.Random(9)
    rows = []
    for i in range(300):
        t = "".join(rnd.choice(ALPHA) for _ in range(rnd.randint(0, 12)))
        rows.append((i, t, rnd.randint(-3, 15), rnd.randint(-3, 15)))
    df = spark.createDataFrame(rows, "id long, t string, s int, e int")
    words = ["ab", "😀", "ba", "é"]
    got = df.orderBy("id").select(
        T.mask("t", F.col("s"), F.col("e")).alias("m"), T.normalize("t").alias("n"),
        T.first_match("t", words).alias("f"), T.is_ascii("t").alias("a"),
        T.contains_any("t", ["😀", "ba"]).alias("c")).collect()
    for (i, t, s, e), r in zip(rows, got):
        assert r.m == py_mask(t, s, e), (t, s, e)
        assert r.n == py_normalize(t), t
        assert (r.f.idx, r.f.word) == py_first(t, words), t
        assert r.a == all(ord(ch) < 128 for ch in t), t
        assert r.c == any(w in t for w in ["😀", "ba"]), t
