import pytest

from signalmill.functions import parsing as P
from signalmill.operators.signals import parsed


def read(spark, text):
    return parsed(spark.createDataFrame([(text,)], "response_text string")).first()


@pytest.mark.parametrize("text,expected", [
    ("DIRECTION: BULLISH", "BULLISH"), ("The market is BEARISH today", "BEARISH"), ("No clear trend here", "NEUTRAL"),
    ("prices beLONG here", "BULLISH"), ("not bullish, sell", "BULLISH"), ("short it", "BEARISH"), ("", "NEUTRAL"),
])
def test_direction(spark, text, expected):
    assert read(spark, text).direction == expected


@pytest.mark.parametrize("text,expected", [
    ("STRENGTH: STRONG", "STRONG"), ("HIGHER", "STRONG"), ("medium", "MODERATE"), ("none", "WEAK"),
])
def test_strength(spark, text, expected):
    assert read(spark, text).strength == expected


@pytest.mark.parametrize("text,expected", [
    ("CONFIDENCE: 75%", 0.75), ("confidence: 0.82", 0.82), ("no confidence mentioned here", 0.5), ("confidence 1%", 1.0),
    ("Confidence level: 75%", 0.75), ("CONFIDENCE: 250%", 1.0), ("up 300%", 1.0), ("confidence : 40", 0.4),
    ("confidence: 0", 0.0), ("up 12.5 % today", 0.125), ("confidence: 30% confidence: 90%", 0.3),
])
def test_confidence(spark, text, expected):
    assert read(spark, text).confidence == pytest.approx(expected, abs=1e-12)


@pytest.mark.parametrize("text,expected", [
    ("ASSET: cvx", "CVX"), ("asset: none\nASSET: USO or NATGAS", "NATGAS"), ("XOM\nno line", "XLE"),
    ("My asset: brent\nASSET: WTI", "BRENT"), ("ASSET: none", "XLE"),
])
def test_asset(spark, text, expected):
    assert read(spark, text).asset == expected


@pytest.mark.parametrize("text,expected", [("POSITION_SIZE: 12.5%", 12.5), ("position_size: 45", 20.0), ("none", 3.2)])
def test_position_size(spark, text, expected):
    df = spark.createDataFrame([(text, 3.25)], "t string, d double")
    assert df.select(P.position_size_of("upper(t)", "d")).first()[0] == expected


def test_response_documents(spark):
    rows = [
        ("anthropic.claude-v2", '{"completion": "  hi\\n"}', "hi"), ("amazon.titan-text-lite-v1", '{"results": [{"outputText": "a b "}]}', "a b"),
        ("meta.llama3-8b-instruct-v1:0", '{"generation": "g"}', "g"), ("mistral.x", '{"outputs": []}', ""),
        ("mistral.x", '{"outputs": [{"text": " t"}]}', "t"), ("anthropic.claude-v2", "{}", ""), ("other", '{"a": 1}', '{"a": 1}'),
    ]
    df = spark.createDataFrame(rows, "m string, b string, e string")
    for row in df.select("e", P.response_text("m", "b").alias("r")).collect():
        assert row.r == row.e


def test_words_match_whole_tokens_only(spark):
    rows = [("it is up", True), ("up, up", True), ("up, and", False), ("UP\nnow", True), ("\x1cup", True), (" up x", True), ("supper", False)]
    df = spark.createDataFrame(rows, "t string, e boolean")
    for row in df.select("t", "e", P.has_any_word("t", ["up", "a.b"]).alias("r")).collect():
        assert row.r == row.e, row.t


def test_token_estimate(spark):
    text = "one two  three\nfour five"
    got = spark.createDataFrame([(text,), ("",)], "t string").selectExpr(f"{P.estimated_tokens_sql('t')} AS n").collect()
    assert [r.n for r in got] == [len(text.split()) * 4 // 3, 0]
