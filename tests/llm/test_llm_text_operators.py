"""Byte BPE, token lengths, packing, sharding and license scans against brute force, and edge cases."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

tiktoken = pytest.importorskip("tiktoken")
P = pytest.importorskip("public_tokenizers")

from tamis.llm import bpe, lengths, licenses, packing, sharding  # noqa: E402
from tamis.llm.encodings import read_ranks  # noqa: E402

LONG = "Ünïcode wörds und 'contractions' don't  stop\n\n " * 3000
TEXTS = [None, "", " ", "a", "I'll say: don't!", "日本語 テキスト 123", "x" * 700, LONG, "same text", "same text",
         "This work is licensed under the GNU General Public License, version 3.", "  tabs\tand\x0bvt\x85nel　ideo  "]
SCHEMA = "doc_id long, text string, n_tokens long, shard int, labels string"


def docs(spark, texts=TEXTS):
    """Extra columns have the names of the operators' results."""
    rows = [(None if i == 3 else i, t, -1, 99, "mine") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def encoder(name):
    return tiktoken.Encoding("t", pat_str=P.PATTERN, mergeable_ranks=read_ranks(P.path(name)), special_tokens={})


def test_pieces_and_ids_equal_the_library_on_random_texts():
    path = P.path("byte_bpe_multi_50k.tiktoken")
    enc, rng = encoder("byte_bpe_multi_50k.tiktoken"), random.Random(7)
    alphabet = "  \n\t'''strevmdlAé1٣!,-　\xa0日́🙂"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))) for _ in range(4000)]
    texts += ["a" * 3000, "ab" * 1500 + " " * 500, "é" * 400, LONG]
    for t, got in zip(texts, bpe.encode_texts(texts, path)):
        assert np.frombuffer(got, "<u4").tolist() == enc.encode_ordinary(t)
        assert bpe.decode_ids(got, path) == t.encode()


def test_round_trip_query(spark):
    enc = encoder("byte_bpe_multi_50k.tiktoken")
    got = {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.bpe_round_trip(docs(spark)).collect()}
    want = set()
    for r in docs(spark).collect():
        t = r.text or ""
        ids = enc.encode_ordinary(t)
        want.add((r.doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()))
    assert got == want
    kept = bpe.decode_documents(bpe.encode_documents(docs(spark)))
    assert kept.columns == ["doc_id", "text", "shard", "labels", "n_tokens", "ids", "decoded"]
    assert kept.where("decoded <> cast(coalesce(text, '') as binary)").count() == 0
    assert bpe.bpe_round_trip(docs(spark).limit(0)).count() == 0


def test_length_histogram(spark):
    enc = encoder("byte_bpe_50k.tiktoken")
    n = np.array([len(enc.encode_ordinary(t or "")) for t in TEXTS])
    h = lengths.token_counts(docs(spark))
    for r in h.collect():
        assert r.n_docs == (n == r.n_tokens).sum() and r.docs_within == (n <= r.n_tokens).sum()
        assert r.tokens_within == n[n <= r.n_tokens].sum() and r.docs_over == (n > r.n_tokens).sum()
        assert r.tokens_over == n[n > r.n_tokens].sum() and r.truncated_total == np.minimum(n, r.n_tokens).sum()
    got = {r.limit: (r.docs_within, r.truncated_total) for r in lengths.truncated_totals(h, [0, 7, 10 ** 6]).collect()}
    assert got == {x: ((n <= x).sum(), np.minimum(n, x).sum()) for x in (0, 7, 10 ** 6)}
    q = {r.share: r.n_tokens for r in lengths.length_quantiles(h, [0.5, 1.0]).collect()}
    assert q == {0.5: int(np.sort(n)[len(n) // 2 - 1]), 1.0: int(n.max())}
    assert lengths.token_counts(docs(spark).limit(0)).count() == 0


def check_packing(rows, ids_of, window):
    spans, places = {}, {}
    for r in rows:
        assert r.doc_tokens == len(ids_of[r.doc_id])
        part = ids_of[r.doc_id][r.start:r.start + r.length]
        assert len(part) == r.length and zlib.crc32(np.array(part, "<u4").tobytes()) == r.ids_crc32
        spans.setdefault(r.doc_id, []).append((r.start, r.length))
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert set(spans) == set(ids_of)
    for of in (spans, places):
        for pieces in of.values():
            at = 0
            for start, n in sorted(pieces):
                assert start == at
                at += n
    for d, pieces in spans.items():
        assert sum(n for _, n in pieces) == len(ids_of[d])
    fill = [sum(n for _, n in p) for p in places.values()]
    assert max(fill, default=0) <= window and sum(f < window for f in fill) <= 1


@pytest.mark.parametrize("window,open_windows", [(2048, 64), (16, 2), (7, 1)])
def test_packing_places_every_token_once(spark, window, open_windows):
    tokenizers = pytest.importorskip("tokenizers")
    tk = tokenizers.Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    texts = [*TEXTS, "a <|endoftext|> b"]
    ids = {i: tk.encode(t or "", add_special_tokens=False).ids + [1] for i, t in enumerate(texts)}
    df = spark.createDataFrame([(i, t, 5) for i, t in enumerate(texts)], "doc_id long, text string, start int").repartition(3)
    check_packing(packing.packing(df, window=window, open_windows=open_windows).collect(), ids, window)
    assert packing.packing(df.limit(0)).count() == 0


def test_packing_merges_over_several_levels(spark, monkeypatch):
    monkeypatch.setattr(packing, "_FAN", 2)
    df = spark.createDataFrame([(i, "word " * (i % 9)) for i in range(60)], "doc_id long, text string").repartition(9)
    enc = encoder("byte_bpe_50k.tiktoken")
    ids = {i: enc.encode_ordinary("word " * (i % 9)) + [1] for i in range(60)}
    check_packing(packing.packing(df, window=32, open_windows=3).collect(), ids, 32)


def test_shards(spark):
    rows = [(i % 50 if i % 3 else 7, None if i % 11 == 0 else "é" * (i % 13), i) for i in range(1000)]  # a third repeats one id
    df = spark.createDataFrame(rows, "doc_id long, text string, slot int").repartition(4)
    out = sharding.sharding(df, bucket_bytes=2000).collect()
    assert len(out) == 1000
    sizes = {}
    for r in out:
        sizes.setdefault(r.shard, []).append(r.slot)
    assert set(sizes) == set(range(16)) and {len(s) for s in sizes.values()} <= {62, 63}
    assert all(sorted(s) == list(range(len(s))) for s in sizes.values())
    want = sorted((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t, _ in rows)
    assert sorted((r.doc_id, r.size, r.text_crc32) for r in out) == want
    assert {(r.law, r.grown_shard) for r in out} == {("rows", None)}
    kept = sharding.shard_records(df)
    assert kept.columns == ["doc_id", "text", "shard", "slot"] and kept.select("shard", "slot").distinct().count() == 1000
    assert sharding.sharding(df.limit(0)).count() == 0


def test_shuffle_is_uniform(spark):
    df = spark.range(4000).withColumn("text", F.lit("x"))
    pos = np.array([r.shard for r in sharding.shard_records(df, n_shards=4, bucket_bytes=4000).orderBy("id").collect()])
    quarters = [np.bincount(pos[a:a + 1000], minlength=4) for a in range(0, 4000, 1000)]
    assert min(q.min() for q in quarters) > 180 and max(q.max() for q in quarters) < 320


def test_shards_can_be_written(spark, tmp_path):
    df = spark.createDataFrame([(i, "t%d" % i) for i in range(100)], "doc_id long, text string")
    sharding.write_shards(df, str(tmp_path / "out"), n_shards=4)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 100 and back.select("shard").distinct().count() == 4


WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def low(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t)


def test_license_base_places(spark):
    texts = [*TEXTS, "All rights reserved. ALL RIGHTS all rights reserved", "cc-by cc by CC/BY é", "general public", "generalépublic license"]
    df = docs(spark, texts)
    for r, t in zip(sorted(licenses.license_scan(df.fillna(-5, ["doc_id"])).collect(), key=lambda r: r.doc_id),
                    [x.text for x in sorted(df.fillna(-5, ["doc_id"]).collect(), key=lambda r: r.doc_id)]):
        w = WORDS.findall(low(t or ""))
        hits = [(i, l) for p, l in licenses.BASE_PHRASES.items() for i in range(len(w)) if w[i:i + len(p.split())] == p.split()]
        assert (r.n_words, r.n_base) == (len(w), len(hits))
        assert (r.first_word, r.last_word) == ((min(hits)[0], max(hits)[0]) if hits else (None, None))
        assert r.base_labels == ",".join(sorted({l for _, l in hits}))
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(","))) and 0 <= r.score <= 1
    assert licenses.license_scan(docs(spark).limit(0)).count() == 0
    assert licenses.scan_licenses(docs(spark)).columns[:4] == ["doc_id", "text", "n_tokens", "shard"]


def brute_template(markup, text):
    """Does the text hold a match? By a regular expression over words, for the test only."""
    parts, at, out = re.compile(r'<optional>|</optional>|<alt max="(\d+)">.*?</alt>', re.S), 0, ""
    lit = lambda s: "".join(re.escape(w) + " " for w in WORDS.findall(low(s)))
    for m in parts.finditer(markup):
        out += lit(markup[at:m.start()])
        at = m.end()
        out += {"<optional>": "(?:", "</optional>": ")?"}.get(m.group(0)) or "(?:[^ ]+ ){0,%s}" % m.group(1)
    out += lit(markup[at:])
    return re.search("(?:^| )" + out, " " + "".join(w + " " for w in WORDS.findall(low(text)))) is not None


def test_templates_accept_what_the_markup_allows(spark):
    markup = {"t": '<optional>this <alt max="2">thing</alt> is</optional> given <alt max="3">freely</alt> to all <optional>of <optional>good</optional> will</optional>'}
    rng = random.Random(5)
    vocab = "this thing is given freely to all of good will foo".split()
    texts = [" ".join(rng.choice(vocab) for _ in range(rng.randint(1, 14))) for _ in range(1500)]
    texts += ["This big thing is GIVEN, to-all of good will", "given a b c to all", "given a b c d to all", "given to some"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.labels == "t" for r in licenses.license_scan(df, templates=markup).collect()}
    assert got == {i: brute_template(markup["t"], t) for i, t in enumerate(texts)}
    r = licenses.scan_licenses(df.where("doc_id = 1500"), templates=markup).first()
    assert [(m.first, m.after) for m in r.matches] == [(0, 10)] and r.score == 1.0


def test_every_shipped_template_accepts_its_own_wording(spark):
    plain = [(n, re.sub("<[^>]*>", " ", t)) for n, t in licenses.TEMPLATES.items()]
    df = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(plain)], "doc_id long, text string")
    for r in licenses.license_scan(df).collect():
        assert plain[r.doc_id][0] in r.labels.split(",")
    for bad in ("<optional>a", "a</optional>", '<alt max="2">x</alt>'):
        with pytest.raises(ValueError):
            licenses.compile_template("bad", bad)
