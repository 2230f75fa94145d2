import os

import pytest

from tamis.sources.wordbank import load_word_bank, WordBankError, by_type, load_rules
from tamis.operators.bank import lookup, is_listed, not_listed, bank_size

CSV = """# comment
#another

hello,political,high,block
  pad me , ad ,medium,mask
 ,x,low,pass
hello,spam,low,pass
two,fields
five,f,i,v,e
"q,uo",t,low,pass
"""


@pytest.fixture()
def csv_path(tmp_path):
    p = tmp_path / "bank.csv"
    p.write_text(CSV, encoding="utf-8")
    return str(p)


def test_load_drop_mode(spark, csv_path):
    bank, n_bad = load_word_bank(spark, csv_path, with_bad_count=True)
    rows = sorted(tuple(r) for r in bank.collect())
    assert rows == [("hello", "spam", "low", "pass"), ("pad me", "ad", "medium", "mask"), ("q,uo", "t", "low", "pass")]
    assert n_bad == 2


def test_load_fail_mode(spark, csv_path):
    with pytest.raises(WordBankError):
        load_word_bank(spark, csv_path, mode="fail")


def test_missing_file(spark, tmp_path):
    with pytest.raises(WordBankError):
        load_word_bank(spark, str(tmp_path / "absent.csv"))


def test_reference_bank_and_lookups(spark):
    here = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    from tamis import fixed
    bank = spark.createDataFrame(fixed.DEFAULT_BANK, "word string, type string, severity string, action string")
    assert bank_size(bank).first()[0] == 7
    words = spark.createDataFrame([("shit",), ("hello",)], "w string")
    got = sorted(tuple(r) for r in lookup(words, "w", bank).select("w", "severity").collect())
    assert got == [("hello", None), ("shit", "medium")]
    assert [r.w for r in is_listed(words, "w", bank).collect()] == ["shit"]
    assert [r.w for r in not_listed(words, "w", bank).collect()] == ["hello"]
    types = {r.type: (r.n_words, list(r.words)) for r in by_type(bank).collect()}
    assert types["spam"] == (3, ["act now", "click here", "free money"])


def test_load_rules_yaml(spark, tmp_path):
    p = tmp_path / "rules.yaml"
    p.write_text("patterns:\n  - pattern: 'a+b'\n    name: ab\n    type: t\n    severity: low\n    action: review\n")
    assert [tuple(r) for r in load_rules(spark, str(p)).collect()] == [("ab", "a+b", "t", "low", "review")]


def test_last_row_wins_across_splits(spark, tmp_path):
    # a bank file cut into many splits: the later row of a word must still win
    p = tmp_path / "big.csv"
    lines = [f"w{i},t,low,pass" for i in range(20000)] + ["w5,late,high,block"]
    p.write_text("\n".join(lines) + "\n", encoding="utf-8")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16384")
    try:
        bank = load_word_bank(spark, str(p))
        assert bank.filter("word = 'w5'").first().type == "late"
        assert bank.count() == 20000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_unicode_white_space_is_trimmed(spark, tmp_path):
    p = tmp_path / "u.csv"
    p.write_text(" word　, type\u0085,\tlow ,pass \n", encoding="utf-8")
    assert [tuple(r) for r in load_word_bank(spark, str(p)).collect()] == [("word", "type", "low", "pass")]


def test_only_bad_rows(spark, tmp_path):
    p = tmp_path / "bad.csv"
    p.write_text("a,b\nc,d,e,f,g\n", encoding="utf-8")
    bank, n_bad = load_word_bank(spark, str(p), with_bad_count=True)
    assert bank.count() == 0 and n_bad == 2


def test_quoted_fields_as_csv_has_them(spark, tmp_path):
    p = tmp_path / "bank.csv"
    p.write_text('# c\n"he ""x"" y",a,low,pass\n"two\nlines",b,high,block\nplain,c,low,pass\n"two\nlines",d,low,pass\n', encoding="utf-8")
    bank, bad = load_word_bank(spark, str(p), with_bad_count=True)
    assert bad == 0
    assert {(r.word, r.type) for r in bank.collect()} == {('he "x" y', "a"), ("two\nlines", "d"), ("plain", "c")}
