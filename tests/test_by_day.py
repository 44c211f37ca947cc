"""Evidence of every date over its own look-back, against the same operators started anew for each date."""

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from signalmill.operators import evidence as E
from signalmill.operators import indicators as I
from signalmill.operators import risk as R
from signalmill.operators import sentiment as S
from signalmill.operators.asof import as_of_join

DAY = dt.timedelta(days=1)


def walk(symbol, seed, days, start=dt.date(2023, 1, 1), per_day=1, gap=0.0, flat=(), huge=()):
    """Bars with missing days, stretches that stand still, and single huge moves."""
    rng = random.Random(seed)
    price, rows = 40.0, []
    for i in range(days):
        if rng.random() < gap:
            continue
        for k in range(per_day):
            if i in huge:
                price *= rng.choice([30.0, 1 / 30])
            elif not any(a <= i < b for a, b in flat):
                price = max(0.5, price + rng.uniform(-1.5, 1.5))
            rows.append((symbol, dt.datetime.combine(start, dt.time()) + dt.timedelta(days=i, hours=9, minutes=7 * k), price))
    return rows


@pytest.fixture(scope="module")
def bars(spark):
    rows = walk("A", 1, 330) + walk("B", 2, 330, gap=0.4, flat=((60, 210),)) + walk("C", 3, 330, gap=0.85, huge=(100, 101))
    rows += walk("D", 4, 12, per_day=40) + walk("D", 5, 15, start=dt.date(2023, 10, 1), per_day=3) + walk("E", 6, 200, flat=((0, 200),))
    rows += [("A", dt.datetime(2023, 5, 1, 20), None), ("A", dt.datetime(2023, 5, 2, 20), float("nan"))]
    return spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, close double").cache()


DATES = [dt.date(2023, 1, 1) + k * DAY for k in (0, 13, 26, 34, 90, 91, 101, 150, 193, 211, 274, 300, 364, 420)]


@pytest.mark.parametrize("blocks", [{}, {"block_rows": 68, "slice_seconds": 20 * 86_400}])
def test_indicators_by_day_equal_those_that_start_anew(spark, bars, blocks):
    by_day = {(r.symbol, r.d): r for r in I.indicators_by_day(bars, **blocks).collect()}
    seen = 0
    for d in DATES:
        wanted = {r.symbol: r for r in I.indicator_latest(bars, d, 90).collect()}
        assert {s for s, at in by_day if at == d} == set(wanted), d
        for symbol, want in wanted.items():
            got = by_day[symbol, d]
            assert (got.ts, got.n, got.close) == (want.ts, want.n, want.close), (symbol, d)
            for name in I.INDICATORS:
                assert (got[name] is None) == (want[name] is None), (symbol, d, name)
                if want[name] is not None:
                    assert got[name] == pytest.approx(want[name], rel=1e-9, abs=1e-9), (symbol, d, name)
                    seen += 1
    assert seen > 100


def test_records_and_best_asset_by_day(spark, bars):
    records = I.records_by_day(bars, ["A", "B", "D"])
    best = {r.d: r.best_asset for r in I.best_asset_by_day(records).collect()}
    for d in (dt.date(2023, 3, 1), dt.date(2023, 6, 20), dt.date(2023, 10, 12)):
        wanted = {r.symbol: r for r in I.indicator_records(bars, ["A", "B", "D"], d).collect()}
        assert {r.symbol: r.asDict() | {"d": None} for r in records.where(F.col("d") == d).collect()} == {
            s: {**r.asDict(), "d": None} for s, r in wanted.items()
        }
        assert best.get(d, "XLE") == I.best_asset(I.indicator_records(bars, ["A", "B", "D"], d)).first()[0]


def test_volatility_and_flags_by_day_equal_those_that_start_anew(spark, bars):
    by_day = {(r.symbol, r.d): r.volatility for r in I.volatility_by_day(bars, slice_seconds=20 * 86_400).collect()}
    for d in DATES:
        wanted = {r.symbol: r.volatility for r in I.volatility(bars, as_of=d).collect()}
        assert {s: v for (s, at), v in by_day.items() if at == d} == pytest.approx(wanted, abs=0.011), d
    dated = I.volatility_by_day(bars)
    flags = R.market_flags(dated, ["A", "C"], 60.0).where(F.col("d") == dt.date(2023, 4, 20))
    assert sorted(map(tuple, flags.select("symbol", "flag").collect())) == sorted(
        map(tuple, R.market_flags(I.volatility(bars, as_of=dt.date(2023, 4, 20)), ["A", "C"], 60.0).select("symbol", "flag").collect())
    )


def test_a_still_price_has_no_volatility_and_an_rsi_of_100(spark, bars):
    d = dt.date(2023, 4, 1)
    row = I.indicators_by_day(bars).where((F.col("symbol") == "E") & (F.col("d") == d)).first()
    assert row.rsi == 100 and row.macd == pytest.approx(0, abs=1e-12) and row.bb_high == row.close
    assert I.volatility_by_day(bars, ["E"]).where(F.col("d") == d).first().volatility == 0


def test_a_date_sees_no_later_bar(spark, bars):
    cut = dt.date(2023, 6, 1)
    early = I.indicators_by_day(bars.where(F.col("ts") < F.lit(cut)))
    key = lambda df: {(r.symbol, r.d): r for r in df.where(F.col("d") < F.lit(cut)).collect()}
    whole, part = key(I.indicators_by_day(bars)), key(early)
    assert whole.keys() == part.keys()
    assert all(whole[k][c] == pytest.approx(part[k][c]) for k in whole for c in ("macd", "macd_signal", "rsi") if part[k][c] is not None)


def test_sentiment_by_day(spark):
    texts = {dt.date(2024, 1, 1): ["up a", "sell", "x"], dt.date(2024, 1, 2): ["up", "up", "up"], dt.date(2024, 1, 5): ["dump it", "rise and dump"]}
    rows = [(t, None, dt.datetime.combine(d, dt.time(5))) for d, list_ in texts.items() for t in list_] + [("up", None, None)]
    posts = spark.createDataFrame(rows, "title string, description string, published_at timestamp_ntz")
    got = {r.d: (r.bullish_count, r.bearish_count, r.neutral_count, r.total_posts, r.bullish_pct) for r in S.summary_by_day(posts, 1).collect()}
    assert got == {
        dt.date(2024, 1, 1): (1, 1, 1, 3, 33.3), dt.date(2024, 1, 2): (4, 1, 1, 6, 66.7), dt.date(2024, 1, 3): (3, 0, 0, 3, 100.0),
        dt.date(2024, 1, 5): (1, 1, 0, 2, 50.0), dt.date(2024, 1, 6): (1, 1, 0, 2, 50.0),
    }
    for d in got:
        window = posts.where((F.to_date("published_at") >= F.date_sub(F.lit(d), 1)) & (F.to_date("published_at") <= F.lit(d)))
        assert tuple(S.summary(window).select("bullish_count", "bearish_count", "neutral_count", "total_posts", "bullish_pct").first()) == got[d]


def test_headlines_by_day(spark):
    start = dt.datetime(2024, 1, 1, 12)
    rows = [("q1" if i % 2 else "q2", f"u{i % 17}", f"t{i}", start + dt.timedelta(hours=7 * i)) for i in range(40)]
    articles = spark.createDataFrame(rows, "query string, url string, title string, published_at timestamp_ntz")
    got = {r.d: r.headlines for r in S.headlines_by_day(articles, ["q1", "q2"], 2, 3, 5).collect()}
    for d, shown in got.items():
        window = articles.where((F.to_date("published_at") >= F.date_sub(F.lit(d), 2)) & (F.to_date("published_at") <= F.lit(d)))
        assert shown == [r.title for r in S.recent_headlines(S.dedupe_headlines(window, ["q1", "q2"], 3), 5).collect()], d


@pytest.mark.parametrize("slice_seconds", [3600, 7 * 86_400])
@pytest.mark.parametrize("within", [None, 2])
def test_as_of_join(spark, slice_seconds, within):
    rng = random.Random(8)
    base = dt.datetime(2024, 1, 1)
    right = [(rng.choice(["a", "b", None]), base + dt.timedelta(minutes=rng.randint(0, 20_000)), i, {"k": float(i)}) for i in range(80)]
    right += [("a", right[0][1], 500, {}), ("a", None, 9, {})]
    left = [(i, rng.choice(["a", "b", "c", None]), base + dt.timedelta(minutes=rng.randint(-2000, 24_000))) for i in range(120)]
    left += [(1000 + i, "a", base + dt.timedelta(days=3)) for i in range(200)] + [(2000, "a", None)]
    got = as_of_join(
        spark.createDataFrame(left, "id int, k string, at timestamp_ntz"), spark.createDataFrame(right, "k string, since timestamp_ntz, v int, m map<string,double>"),
        "at", "since", ["k"], within, slice_seconds,
    ).collect()
    assert len(got) == len(left)
    found = {r.id: (r.since, r.v) for r in got}
    for i, k, at in left:
        old = [(s, v) for key, s, v, _ in right if key == k and s is not None and at is not None and s <= at]
        best = max(old, default=(None, None))
        if within and best[0] is not None and best[0] < at - within * DAY:
            best = (None, None)
        assert found[i] == best, (i, k, at)


def test_as_of_join_without_keys_and_on_dates(spark):
    left = spark.createDataFrame([(dt.date(2024, 1, k),) for k in (1, 5, 9, 9)], "d date")
    right = spark.createDataFrame([(dt.date(2024, 1, 4), 1), (dt.date(2024, 1, 9), 2)], "since date, v int")
    assert sorted(map(tuple, as_of_join(left, right, "d", "since").select("d", "v").collect()), key=repr) == [
        (dt.date(2024, 1, 1), None), (dt.date(2024, 1, 5), 1), (dt.date(2024, 1, 9), 2), (dt.date(2024, 1, 9), 2)
    ]


def test_prices_are_those_of_one_date_of_the_look_back(spark):
    rows = [("X", dt.date(2024, 1, 2), 1.0), ("Y", dt.date(2024, 1, 2), 2.0), ("X", dt.date(2024, 1, 4), 3.00005), ("Y", dt.date(2024, 1, 4), None)]
    closes = spark.createDataFrame(rows, "symbol string, d date, close double")
    dates = spark.createDataFrame([(dt.date(2024, 1, k),) for k in (1, 3, 4, 9, 10)], "d date")
    got = {r.d.day: r.prices for r in E.price_evidence(dates, closes).collect()}
    assert got == {1: None, 3: {"X": 1.0, "Y": 2.0}, 4: {"X": 3.0}, 9: {"X": 3.0}, 10: None}


def test_signals_with_the_evidence_of_their_date(spark):
    agents = ["MarketDataAgent", "TechnicalAnalyst", "SentimentAgent", "RiskManager"]
    text = "DIRECTION: NEUTRAL\nSTRENGTH: WEAK\nCONFIDENCE: 60%\nASSET: WTI"
    rows = [(run, a, dt.datetime(2024, 1, 1 + run, 8, i), text, 7) for run in range(3) for i, a in enumerate(agents)]
    responses = spark.createDataFrame(rows, "run_id int, agent_name string, ts timestamp_ntz, response_text string, portfolio_id int")
    none = "CAST(NULL AS array<struct<ticker string, mentions bigint>>) AS top_tickers"
    evidence = spark.sql(f"""SELECT DATE '2024-01-02' AS d, map('X', 1.5d) AS prices, map('S', 2d) AS macro,
        map('X', named_struct('error', CAST(NULL AS string), 'close', 3d)) AS indicators, 'X' AS best_asset, array('a','b','c','d','e','f') AS headlines,
        named_struct('bullish_count', 3L) AS reddit, 'BULLISH' AS social_direction, {none}""").drop("top_tickers")
    own = spark.createDataFrame([(7, 2, "Z", "OVERWEIGHT: Z")], "portfolio_id int, flag_order int, symbol string, flag string")
    volatilities = spark.createDataFrame([("XLE", dt.date(2024, 1, 3), 44.0), ("XLE", dt.date(2024, 1, 2), 4.0)], "symbol string, d date, volatility double")
    got = {(r.run_id, r.agent_name): r for r in E.dated_signals(responses, evidence, own, volatilities).collect()}
    assert len(got) == 12
    assert json.loads(got[1, "MarketDataAgent"].raw_data) == {"prices": {"X": 1.5}, "macro": {"S": 2.0}}
    assert json.loads(got[0, "MarketDataAgent"].raw_data) == {"prices": {}, "macro": {}} and got[0, "MarketDataAgent"].asset == "WTI"
    assert (got[1, "TechnicalAnalyst"].asset, got[0, "TechnicalAnalyst"].asset) == ("X", "XLE")
    assert json.loads(got[1, "TechnicalAnalyst"].raw_data) == {"X": {"close": 3.0}} and got[0, "TechnicalAnalyst"].raw_data == "{}"
    assert (got[1, "SentimentAgent"].direction, got[0, "SentimentAgent"].direction) == ("BULLISH", "NEUTRAL")
    assert json.loads(got[1, "SentimentAgent"].raw_data) == {"headlines": ["a", "b", "c", "d", "e"], "reddit": {"bullish_count": 3}}
    assert [(got[r, "RiskManager"].direction, got[r, "RiskManager"].strength) for r in range(3)] == [("BEARISH", "MODERATE"), ("BEARISH", "MODERATE"), ("BEARISH", "STRONG")]
    assert json.loads(got[2, "RiskManager"].raw_data) == {"volatility": {"XLE": 44.0}, "risk_flags": ["HIGH VOLATILITY: XLE at 44.0%", "OVERWEIGHT: Z"]}


def test_signals_meet_evidence_as_texts_written_once_per_date(spark):
    responses = spark.createDataFrame(
        [(r, a, dt.datetime(2024, 1, 1 + r % 2, 8), "ASSET: WTI", 7) for r in range(4) for a in ("TechnicalAnalyst", "RiskManager")],
        "run_id int, agent_name string, ts timestamp_ntz, response_text string, portfolio_id int",
    )
    evidence = spark.createDataFrame([(dt.date(2024, 1, 1), {"X": "up"}, "X")], "d date, indicators map<string,string>, best_asset string")
    own = spark.createDataFrame([], "portfolio_id int, flag_order int, symbol string, flag string")
    volatilities = spark.createDataFrame([("XLE", dt.date(2024, 1, 2), 4.0)], "symbol string, d date, volatility double")
    signals = E.dated_signals(responses, evidence, own, volatilities)
    got = {(r.run_id, r.agent_name): json.loads(r.raw_data) for r in signals.collect()}
    for run in range(4):
        assert got[run, "TechnicalAnalyst"] == ({"X": "up"} if run % 2 == 0 else {})
        assert got[run, "RiskManager"] == {"volatility": {"XLE": 4.0} if run % 2 else {}, "risk_flags": []}
    plan = signals._jdf.queryExecution().optimizedPlan().toString()
    above, dates, below = plan.partition("RebalancePartitions")
    assert dates and "indicators#" not in above and "indicators#" in below
