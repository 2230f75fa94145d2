from pyspark.sql import functions as F

from tamis.functions import text as T


def one(spark, col, *rows, schema="t string"):
    df = spark.createDataFrame([r if isinstance(r, tuple) else (r,) for r in rows], schema)
    return [r[0] for r in df.select(col).collect()]


def test_mask_cases(spark):
    rows = [("hello world", 0, 5), ("hi", 0, 100), ("hello", -5, 5), ("hello", 3, 3), ("hello world", 6, 11),
            ("héllo", 1, 2)]
    df = spark.createDataFrame(rows, "t string, s int, e int")
    got = [r[0] for r in df.select(T.mask("t", F.col("s"), F.col("e"))).collect()]
    assert got == ["***** world", "**", "*****", "hello", "hello *****", "h*llo"]


def test_contains_any(spark):
    df = spark.createDataFrame([("hello world",), ("nothing here",)], "t string")
    assert [r[0] for r in df.select(T.contains_any("t", ["world", "foo"])).collect()] == [True, False]
    assert [r[0] for r in df.select(T.contains_any("t", [])).collect()] == [False, False]
    assert [r[0] for r in df.select(T.contains_any("t", [""])).collect()] == [True, True]
    arr = F.array(F.lit("foo"), F.lit("here"))
    assert [r[0] for r in df.select(T.contains_any("t", arr)).collect()] == [False, True]


def test_normalize(spark):
    got = one(spark, T.normalize("t"), "hello　world", "a​b", "ｅ", "！～ x")
    assert got == ["hello world", "ab", "e", "!~ x"]


def test_first_match(spark):
    df = spark.createDataFrame([("hello world",), ("nothing",), ("abab",)], "t string")
    got = [tuple(r[0]) for r in df.select(T.first_match("t", ["world", "hello", "ba", "ab"])).collect()]
    assert got == [(0, "hello"), (-1, ""), (0, "ab")]


def test_first_match_tie_goes_to_earlier_word(spark):
    df = spark.createDataFrame([("abc",)], "t string")
    assert tuple(df.select(T.first_match("t", ["ab", "a"])).first()[0]) == (0, "ab")


def test_is_ascii(spark):
    assert one(spark, T.is_ascii("t"), "hello", "hėllo", "\U0001F600", "") == [True, False, False, True]


def test_severity_weight(spark):
    got = one(spark, T.severity_weight("t"), "high", "medium", "low", "critical", "")
    assert got == [1.0, 0.5, 0.2, 0.0, 0.0]
