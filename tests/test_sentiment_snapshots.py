import datetime as dt

from signalmill.operators import lookups as J
from signalmill.operators import sentiment as S
from signalmill.operators import snapshots as N

POST = "title string, description string"


def test_polarity_prefers_bullish_and_keeps_punctuation(spark):
    rows = [("Buy now", "crash"), ("crash now", None), ("up, up,", None), ("", "")]
    got = [r.polarity for r in S.with_polarity(spark.createDataFrame(rows, POST)).collect()]
    assert got == ["bullish", "bearish", "neutral", "neutral"]


def test_summary_margin_and_pie(spark):
    rows = [("up", None)] * 2 + [("down", None)] * 1
    row = S.with_margin(S.summary(spark.createDataFrame(rows, POST))).first()
    assert (row.bullish_count, row.bearish_count, row.neutral_count, row.total_posts) == (2, 1, 0, 3)
    assert (row.bullish_pct, row.bearish_pct, row.direction) == (66.7, 33.3, "BULLISH")
    empty = S.with_margin(S.summary(spark.createDataFrame([], POST))).first()
    assert (empty.total_posts, empty.bullish_pct, empty.direction) == (0, 0.0, "NEUTRAL")
    assert S.pie(spark.createDataFrame([(66.7, 33.3)], "bullish_pct double, bearish_pct double")).first().neutral_pct == 0.0


def test_margin_is_strict_and_missing_counts_as_even(spark):
    df = spark.createDataFrame([(45.0, 30.0), (45.1, 30.0), (30.0, 45.1), (None, None)], "bullish_pct double, bearish_pct double")
    assert [r.direction for r in S.with_margin(df).collect()] == ["NEUTRAL", "BULLISH", "BEARISH", "NEUTRAL"]


def test_mentions_are_substrings_counted_once_per_post(spark):
    rows = [("shale hal HAL", None), ("Xle", "cop"), ("cop", None), ("oxy", None), ("slb", None), ("psx", None), ("uso", None)]
    got = [(r.ticker, r.mentions) for r in S.top_tickers(spark.createDataFrame(rows, POST)).collect()]
    assert got == [("COP", 2), ("HAL", 1), ("OXY", 1), ("PSX", 1), ("SLB", 1)]


def test_ticker_mentions_do_not_cross_join(spark):
    plan = J.ticker_mentions(spark.createDataFrame([("a", None)], POST), S.POST_TEXT, ["A"])._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_headlines_keep_the_copy_of_the_earlier_query(spark):
    t = dt.datetime(2026, 1, 1)
    rows = [("b", "u1", t), ("a", "u1", t - dt.timedelta(days=1)), ("a", "u2", t), ("zz", "u9", t)]
    articles = spark.createDataFrame(rows, "query string, url string, published_at timestamp")
    got = S.dedupe_headlines(articles, ["a", "b"], 10)
    assert sorted((r.query, r.url, r["rank"]) for r in got.collect()) == [("a", "u1", 2), ("a", "u2", 1)]
    assert S.dedupe_headlines(articles, ["b", "a"], 1).count() == 2
    assert [r.url for r in S.recent_headlines(got, 1).collect()] == ["u2"]


def test_unseen(spark):
    a = spark.createDataFrame([("u1",), ("u2",), ("u2",)], "url string")
    assert [r.url for r in J.unseen(a, spark.createDataFrame([("u2",)], "url string")).collect()] == ["u1"]


AS_OF = "2026-01-05"


def test_last_common_row_omits_and_latest_backfills(spark):
    t = dt.datetime(2026, 1, 5)
    rows = [("A", t, 1.23456), ("B", t, None), ("B", t - dt.timedelta(days=1), 2.0), ("C", t, float("nan"))]
    bars = spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, close double")
    assert [(r.symbol, r.price) for r in N.last_common_row(bars, AS_OF).collect()] == [("A", 1.2346)]
    assert N.latest_per_symbol(bars.dropna(), AS_OF, ["B"]).first().price == 2.0


def test_mix_share(spark):
    d = dt.date(2026, 1, 5)
    rows = [("Z", d, "wind", 30.0), ("Z", d, "coal", 0.0), ("Z", d, "gas", 60.0), ("Z", d - dt.timedelta(days=1), "old", 99.0), ("Y", d, "x", 0.0)]
    got = {r.fuel: r.share_pct for r in N.mix_share(spark.createDataFrame(rows, "zone string, d date, fuel string, mw double")).collect()}
    assert got == {"wind": 33.33, "gas": 66.67}


def test_combined_snapshot(spark):
    d = dt.date(2026, 1, 5)
    quotes = spark.createDataFrame([(d, "WTI", 1.0, 1), (d, "WTI", 2.0, 3), (d, "XLE", 9.0, 1)], "d date, key string, value double, priority int")
    obs = spark.createDataFrame([("S", d - dt.timedelta(days=30), 5.0), ("S", d - dt.timedelta(days=40), 4.0), ("T", d - dt.timedelta(days=31), 1.0)],
                                "series_id string, d date, value double")
    news = spark.createDataFrame([(dt.datetime(2026, 1, 4, 23),)] * 12 + [(dt.datetime(2026, 1, 1),)], "published_at timestamp")
    row = N.combined(quotes, N.daily_macro(obs, {"S": "s", "T": "t"}), N.daily_news(news)).collect()
    assert len(row) == 1 and row[0].prices == {"WTI": 2.0, "XLE": 9.0} and row[0].macro == {"S": 5.0} and row[0].news_count == 10
    assert row[0].s3_raw_key == "raw/2026-01-05/combined.json"
