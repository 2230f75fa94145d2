"""Near and substring dedup against brute force, components, edge cases."""

import hashlib
import random
import re

import pytest

from tamis.llm import minmax, substring
from tamis.llm.components import connected_components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def low(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t)


def brute_near(rows, percent=75):
    sets = {}
    for i, t in rows:
        w = WORD.findall(low(t or ""))
        sets[i] = {tuple(w[j:j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    part = {i: i for i in sets}
    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = part[a], part[b]
                if x != y:
                    part = {k: min(x, y) if v in (x, y) else v for k, v in part.items()}
    return {i: (len(sets[i]), part[i], part[i] == i) for i in sets}


def near(df):
    return {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minmax.link_near_duplicates(df).collect()}


def family(rng, base, edits):
    w = base.split()
    for _ in range(edits):
        w[rng.randrange(len(w))] = "edit%d" % rng.randrange(10 ** 6)
    return " ".join(w)


def corpus(seed=3, n=160):
    rng = random.Random(seed)
    vocab = ["w%d" % i for i in range(400)]
    texts = [None, "", " \n\t", "one two", "One TWO", "a b c d e", "A b c\nd e", "\x1f\x85 x\xa0y ÄÖ"]
    bases = [" ".join(rng.choice(vocab) for _ in range(m)) for m in (60, 90, 200, 12, 3000)]
    for _ in range(n):
        b = rng.choice(bases)
        texts.append(family(rng, b, rng.randrange(0, 7)) if rng.random() < 0.8 else " ".join(rng.choice(vocab) for _ in range(rng.randrange(1, 90))))
    order = list(range(len(texts)))
    rng.shuffle(order)
    return list(zip(order, texts))


def test_near_duplicates_equal_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame([(i, t, "x", 0) for i, t in rows], "doc_id long, text string, sig string, component_id int").repartition(4)
    assert near(df) == brute_near(rows)


def test_large_group_whose_members_are_not_all_alike(spark, monkeypatch):
    monkeypatch.setattr(minmax, "_BLOCK", 16)  # several blocks a bucket
    rng = random.Random(1)
    base = " ".join("v%d" % i for i in range(100))
    rows = [(i, family(rng, base, 1 + i % 5)) for i in range(150)]
    assert near(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)) == brute_near(rows)


def test_near_repeated_and_null_ids(spark):
    long = "p q r s t u v w x y z"
    rows = [(5, long), (5, long), (3, "other words that are not alike at all"), (9, "other words that are not alike at all"), (5, "other words that are not alike at all"),
            (None, long), (None, "lonely text with a null id here")]
    got = sorted(map(str, minmax.link_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()))
    assert sum("component_id=3" in r for r in got) == 6 and sum("kept=True" in r for r in got) == 2
    assert minmax.link_near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_components_of_a_long_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(0, 300)] + [(1000, j) for j in range(1001, 1200)] + [(7, 7)]
    got = connected_components(spark.createDataFrame(edges, "a long, b long")).collect()
    groups = {}
    for r in got:
        groups.setdefault(r.component, set()).add(r.node)
    assert sorted(map(len, groups.values())) == [200, 301]


def brute_repeats(rows, length):
    w = {i: (t or "").encode().split() for i, t in rows}
    least = {}
    for i, x in w.items():
        for j in range(len(x) - length + 1):
            k = tuple(x[j:j + length])
            least[k] = min(least.get(k, i), i)
    out = {}
    for i, x in w.items():
        gone = [False] * len(x)
        for j in range(len(x) - length + 1):
            if least[tuple(x[j:j + length])] < i:
                gone[j:j + length] = [True] * length
        out[i] = (len(x), sum(gone), hashlib.sha256(b" ".join(a for a, g in zip(x, gone) if not g)).hexdigest())
    return out


def repeats(df, **how):
    return {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring.substring_dedup(df, **how).collect()}


@pytest.mark.parametrize("hot,block_rows", [(200, 1024), (2, 8), (1, 1)])
def test_repeats_equal_brute_force(spark, hot, block_rows):
    rng = random.Random(hot)
    shared = [" ".join("s%d_%d" % (p, i) for i in range(m)) for p, m in enumerate((13, 14, 30, 80, 12))]
    texts = [None, "", "short one", "same " * 40, "same " * 30, "ab " * 5000]
    for _ in range(120):
        parts = [rng.choice(shared) if rng.random() < 0.5 else " ".join("u%d" % rng.randrange(30) for _ in range(rng.randrange(25))) for _ in range(4)]
        texts.append("\n".join(parts))
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, block int").repartition(5)
    assert repeats(df, hot=hot, block_rows=block_rows) == brute_repeats(rows, 13)


def test_repeats_with_a_tiny_vocabulary(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice("ab") for _ in range(rng.randrange(60)))) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert repeats(df) == brute_repeats(rows, 13)
    assert repeats(df, length=6, prefix=2, hot=3, block_rows=7) == brute_repeats(rows, 6)


def test_repeats_null_and_repeated_ids_and_extra_columns(spark):
    text = " ".join("w%d" % i for i in range(20))
    rows = [(2, text, "a"), (2, text, "b"), (None, text, "c"), (1, "nothing  shared\there", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, kept_text string")
    got = {(r.doc_id, r.n_removed, r.kept_text) for r in substring.remove_repeats(df).collect()}
    assert got == {(2, 0, text), (None, 20, ""), (1, 0, "nothing shared here")}
    more = spark.createDataFrame([(1, text, 3, "q")], "doc_id int, text string, `c0` int, `a.b` string")
    assert substring.remove_repeats(more).columns == ["doc_id", "text", "c0", "a.b", "n_words", "n_removed", "kept_text"]
    assert substring.substring_dedup(df.limit(0)).count() == 0


def test_one_great_component_and_a_few_other_classes(spark, monkeypatch):
    monkeypatch.setattr(minmax, "_BLOCK", 8)
    rng = random.Random(8)
    base = " ".join("u%d" % i for i in range(400))
    rows = [(i, family(rng, base, 1 + i % 3)) for i in range(60)] + [(100 + i, family(rng, base, 12 + i)) for i in range(12)]
    assert near(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)) == brute_near(rows)
