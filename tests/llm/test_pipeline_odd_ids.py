"""The near-dedup stage of the pipeline over rows without a doc_id and rows that share one."""

import corpus_pipeline

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def kept(spark, rows):
    df = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], SCHEMA)
    out = corpus_pipeline.drop_near_duplicates(spark, df.repartition(3), "")
    assert out.columns == corpus_pipeline.COLUMNS
    return sorted(((r.doc_id, r.text) for r in out.collect()), key=str)


def test_rows_without_an_id_are_deduplicated_and_texts_that_share_an_id_stay(spark):
    a, b, c, d, e = (" ".join(f"{p}{i}" for i in range(40)) for p in "abcde")
    near = lambda t: t + " more"
    rows = [(7, near(a)), (None, a), (None, near(a)),  # copies and a near copy of a named text
            (None, b), (None, b),  # copies without a name
            (5, c), (5, d),  # two texts under one id
            (3, near(d)), (5, near(e)), (None, "")]
    want = [(7, near(a)), (None, b), (5, c), (3, near(d)), (5, near(e)), (None, "")]
    for r in (rows, rows[::-1]):
        assert kept(spark, r) == sorted(want, key=str)


def test_unique_ids_keep_the_smallest(spark):
    t = " ".join(f"w{i}" for i in range(40))
    assert kept(spark, [(4, t), (2, t), (9, "other words"), (1, None)]) == sorted([(2, t), (9, "other words"), (1, None)], key=str)
