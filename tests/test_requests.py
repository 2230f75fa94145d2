import json

from pyspark.sql import functions as F

from tamis import fixed
from tamis.sources.requests import parse_standard, parse_dify
from tamis.sources.render import render_standard, render_dify


def parse(spark, fn, bodies):
    df = spark.createDataFrame([(i, b) for i, b in enumerate(bodies)], "id long, request string")
    return [(r.text, r.point, r.error) for r in fn(df).orderBy("id").collect()]


def test_standard_requests(spark):
    got = parse(spark, parse_standard, [
        json.dumps({"point": "input"}),
        json.dumps({"text": "x", "point": "invalid"}),
        json.dumps({"text": "hello"}),
        json.dumps({"text": "hi", "point": "output", "app_id": "a"}),
        json.dumps({"text": 123}),
        "{not json",
    ])
    assert got == [(None, None, fixed.MSG_TEXT_REQUIRED), (None, None, fixed.MSG_BAD_POINT),
                   ("hello", "input", None), ("hi", "output", None), (None, None, fixed.MSG_TEXT_REQUIRED),
                   (None, None, fixed.MSG_TEXT_REQUIRED)]


def test_dify_requests(spark):
    got = parse(spark, parse_dify, [
        json.dumps({"params": {"query": "q"}}),
        json.dumps({"point": "app.invalid", "params": {"query": "q"}}),
        json.dumps({"point": "app.moderation.input", "params": {"text": "t"}}),
        json.dumps({"point": "app.moderation.input", "params": {"query": "q", "inputs": {"k": 1}}}),
        json.dumps({"point": "app.moderation.output", "params": {"text": "t"}}),
    ])
    assert got == [(None, None, fixed.MSG_POINT_REQUIRED),
                   (None, None, fixed.MSG_UNSUPPORTED_POINT + "app.invalid"),
                   (None, None, fixed.MSG_TEXT_REQUIRED), ("q", "input", None), ("t", "output", None)]


def test_render_dify(spark):
    df = spark.createDataFrame([(True,), (False,)], "f boolean")
    code = [json.loads(r[0]) for r in df.select(render_dify(F.col("f"))).collect()]
    assert code == [{"flagged": True, "action": "direct_output", "preset_response": fixed.DIFY_PRESET},
                    {"flagged": False, "action": "direct_output"}]
    doc = [json.loads(r[0]) for r in df.select(render_dify(F.col("f"), style="documented")).collect()]
    assert doc[0]["action"] == "overridden" and doc[1]["preset_response"] == ""


def test_render_standard(spark):
    from tamis.operators.keyword import KeywordMatcher
    from tamis.operators.policy import moderate
    df = spark.createDataFrame([(1, "a bad bad"), (2, "ok")], "id long, text string")
    r = moderate(df, [KeywordMatcher([("bad", "t", "high", "block")])])
    out = [json.loads(x[0]) for x in r.orderBy("id").select(render_standard(F.col("flagged"), F.col("action"),
                                                                             F.col("hits"))).collect()]
    assert out[0] == {"flagged": True, "action": "block",
                      "hits": [{"word": "bad", "type": "t", "severity": "high", "index": 2, "length": 3},
                               {"word": "bad", "type": "t", "severity": "high", "index": 6, "length": 3}]}
    assert out[1] == {"flagged": False, "action": "pass", "hits": []}


def test_dataframe_level_api(spark):
    from tamis.operators.keyword import KeywordMatcher
    from tamis.operators.policy import moderate, redact_texts, moderate_conversations
    from tamis.operators.regex import match_rules
    from tamis.operators.bank import size
    df = spark.createDataFrame([(1, "a bad x@y.io"), (2, "ok")], "id long, text string")
    r = moderate(df, [KeywordMatcher([("bad", "t", "high", "block")])], keep=("text",))
    assert [x.id for x in render_standard(r).collect()] == [1, 2]
    assert json.loads(render_dify(r).orderBy("id").first().response)["flagged"] is True
    assert redact_texts(r).orderBy("id").first().text_masked == "a *** x@y.io"
    assert match_rules(df, fixed.DEFAULT_RULES).count() == 1
    assert size(spark.createDataFrame([("a", "t", "low", "pass")], "word string, type string, severity string, action string")).first()[0] == 1
    turns = spark.createDataFrame([(1, "user", "bad"), (2, "assistant", "bad"), (3, "system", "ok")],
                                  "id long, role string, text string")
    pts = {x.id: (x.point, x.flagged) for x in moderate_conversations(turns, [KeywordMatcher([("bad", "t", "high", "block")])]).collect()}
    assert pts == {1: ("input", True), 2: ("output", True), 3: ("input", False)}


def test_keys_bind_case_insensitively_last_wins(spark):
    got = parse(spark, parse_standard, ['{"TEXT": "hi", "Point": "output"}', '{"text": "a", "Text": "b"}',
                                        '[1, 2]', '{"text": "x", "point": null}', '{"text": "a", "text": "b"}'])
    assert got == [("hi", "output", None), ("b", "input", None), (None, None, fixed.MSG_TEXT_REQUIRED),
                   ("x", "input", None), ("b", "input", None)]
    got = parse(spark, parse_dify, ['{"POINT": "app.moderation.input", "Params": {"QUERY": "q"}}',
                                    '{"point": "app.moderation.input", "params": "oops"}'])
    assert got == [("q", "input", None), (None, None, fixed.MSG_BAD_BODY)]
