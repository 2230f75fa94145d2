"""The token store against the tokenizers library, and its index, dictionary and edge cases."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

tokenizers = pytest.importorskip("tokenizers")
P = pytest.importorskip("public_tokenizers")

from tamis.llm import tokenstore  # noqa: E402
from tamis.llm.frames import scratch_path  # noqa: E402

PATH = P.path("word_bpe_49k.json")
TEXTS = [None, "", "  ", "Hello wörld, it's 12345!!", "Σίσυφος ΟΔΟΣ", "日本語 한국어 각", "x" * 5000, "İstanbul <|endoftext|>x", "same", "same",
         "a\u0085b c\x1cd\x0be\xa0f", "á ́b", "The licence of it. " * 20_000]
SCHEMA = "doc_id long, text string, start long, n_tokens long, ids binary, h string"


def docs(spark, texts=TEXTS):
    """Extra columns have the names of the operator's results and of its own columns."""
    return spark.createDataFrame([(len(texts) - i, t, -1, -1, b"", "mine") for i, t in enumerate(texts)], SCHEMA).repartition(3)


def library():
    return tokenizers.Tokenizer.from_file(PATH)


def expected(rows, end=2):
    """doc_id -> (start, ids) by the library, rows in ascending order of ids."""
    out, start, t = [], 0, library()
    for i, text in rows:
        ids = t.encode(text or "", add_special_tokens=False).ids + [end]
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_ids_equal_the_library_on_random_texts():
    rng, t, enc = random.Random(5), library(), tokenstore.Encoder(PATH)
    odd = [chr(i) for i in range(256)] + ["'s", "'ll", "'T", " the", "\n", "<|endoftext|>", "Σ", "日", "́", "<|"]
    plain = [c for c in map(chr, range(32, 256)) if c != "\x85"]
    texts = ["".join(rng.choices(a, k=rng.randint(0, 60))) for a in (odd, plain) for _ in range(2500)]
    flat, bounds = enc.encode(pa.array(texts))
    want = t.encode_batch(texts, add_special_tokens=False)
    assert [flat[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == [e.ids for e in want]


def test_forgetting_changes_nothing(monkeypatch):
    monkeypatch.setattr(tokenstore, "_KNOWN", 5)
    enc, t = tokenstore.Encoder(PATH), library()
    for text in ["some words of a text", "other words of it", "some words of a text, again"] * 3:
        assert enc.encode(pa.array([text]))[0].tolist() == t.encode(text, add_special_tokens=False).ids


def test_store_round_trip(spark):
    got = sorted(tuple(r) for r in tokenstore.token_store(docs(spark)).collect())
    assert got == expected(sorted((len(TEXTS) - i, t) for i, t in enumerate(TEXTS)))
    assert got[0][1] == 0 and all(a[1] + a[2] == b[1] for a, b in zip(got, got[1:]))


def test_small_segments_index_and_fetch(spark):
    path = scratch_path(spark, "store")
    tokenstore.write_token_store(docs(spark), path, segment_bytes=64)
    segments = spark.read.parquet(f"{path}/segments")
    assert segments.count() > 3 and segments.where("size(byte_offsets) <> size(doc_ids) + 1").count() == 0
    want = {r[0]: r for r in expected(sorted((len(TEXTS) - i, t) for i, t in enumerate(TEXTS)))}
    got = tokenstore.fetch_documents(spark, path, [1, 4, 9, 999]).select("doc_id", "start", "n_tokens", F.crc32("ids")).collect()
    assert {tuple(r) for r in got} == {want[1], want[4], want[9]}
    assert tokenstore.fetch_documents(spark, path, []).count() == 0
    assert tokenstore.read_token_store(spark, path).count() == len(TEXTS)


def test_dictionary_hash_is_checked(spark):
    path, other = scratch_path(spark, "store"), scratch_path(spark, "store")
    many = docs(spark, [f"document number {i} about the same licence terms" for i in range(400)])
    tokenstore.write_token_store(many, path)
    digest, raw, dtype = tokenstore.read_dictionary(spark, path)
    assert tokenstore.sha256(raw) == digest and raw and dtype == "<u2"
    spark.read.parquet(f"{path}/segments").write.parquet(f"{other}/segments")
    spark.createDataFrame([(tokenstore.sha256(b"x"), b"x", 2)], "sha256 string, dictionary binary, id_bytes int").write.parquet(f"{other}/dictionary")
    with pytest.raises(Exception, match="another dictionary"):
        tokenstore.read_token_store(spark, other).collect()


def test_dictionary_makes_short_documents_smaller(spark):
    many = docs(spark, [f"document number {i} about the same licence terms and conditions of use" for i in range(800)])
    size = {}
    for name, most in (("with", 2000), ("without", 0)):
        path = scratch_path(spark, name)
        tokenstore.write_token_store(many, path, sample_docs=most)
        size[name] = spark.read.parquet(f"{path}/segments").agg(F.sum(F.length("frames"))).first()[0]
    assert size["with"] < size["without"]


def test_null_and_repeated_ids_and_empty_table(spark):
    rows = [(None, "last one"), (3, "b"), (3, "a"), (3, "a"), (None, None), (-5, "first")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = tokenstore.token_store(df).orderBy("start").collect()
    assert [r.doc_id for r in got] == [-5, 3, 3, 3, None, None]
    assert sum(r.n_tokens for r in got) == sum(n for _, _, n, _ in expected(rows))
    assert tokenstore.token_store(df.limit(0)).count() == 0
    nothing = tokenstore.token_store(df.select("doc_id", F.lit(None).cast("string").alias("text"))).collect()
    assert all(r.n_tokens == 1 for r in nothing) and len(nothing) == 6


def test_a_hot_id_fills_many_ranges_in_order():
    bounds = np.array([3, 7, 7, 7, 20])
    rng = np.random.default_rng(0)
    ids = [int(i) for i in rng.integers(0, 25, 500)] + [7] * 4000 + [None] * 500
    g = rng.integers(-(1 << 63), 1 << 63, len(ids), dtype=np.int64)
    place = tokenstore._range_of(pa.array(ids, pa.int64()), g, bounds, 2)
    rows = sorted(zip([i is None for i in ids], [i or 0 for i in ids], g.tolist(), place.tolist()))
    assert [r[3] for r in rows] == sorted(r[3] for r in rows)
    assert max(r[3] for r in rows) == len(bounds) + 2 and np.bincount(place)[1:5].max() < 1400


def test_many_ranges_with_a_hot_id(spark):
    df = spark.range(0, 3000, 1, 16).select(F.when(F.col("id") % 3 == 0, F.lit(50)).when(F.col("id") % 7 == 0, F.lit(None)).otherwise(F.col("id")).alias("doc_id"),
                                            F.concat(F.lit("text number "), "id").alias("text"))
    path = scratch_path(spark, "store")
    tokenstore.write_token_store(df, path)
    held = spark.read.parquet(f"{path}/segments").groupBy("part").agg(F.sum(F.size("doc_ids")).alias("n")).collect()
    assert len(held) > 12 and max(r.n for r in held) < 700
    got = tokenstore.read_token_store(spark, path).orderBy("start").collect()
    named = [r.doc_id for r in got if r.doc_id is not None]
    assert len(got) == 3000 and named == sorted(named) and all(r.doc_id is None for r in got[len(named):])
    assert all(a.start + a.n_tokens == b.start for a, b in zip(got, got[1:]))
