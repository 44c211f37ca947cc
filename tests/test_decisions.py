import datetime as dt

import pytest

from signalmill.operators import decisions as D
from signalmill.operators import digests as G
from signalmill.operators import lookups as J
from signalmill.operators import risk as R
from signalmill.operators import signals as X

T = dt.datetime(2024, 5, 1, 12, 0, 0)
RESPONSES = "run_id bigint, agent_name string, ts timestamp_ntz, response_text string, portfolio_id int"
FLAGS = "portfolio_id int, flag_order int, symbol string, flag string"


def responses(spark, rows):
    return spark.createDataFrame([(run, agent, T, text, 1) for run, agent, text in rows], RESPONSES)


def flags(spark, *texts):
    return spark.createDataFrame([(1, 2, f"s{i}", text) for i, text in enumerate(texts)], FLAGS)


BULL = "DIRECTION: BULLISH\nSTRENGTH: STRONG\nCONFIDENCE: 80%\nASSET: CVX"
ALL = [(1, a, BULL) for a in ("MarketDataAgent", "TechnicalAnalyst", "SentimentAgent", "RiskManager", "PortfolioManager")]


def test_whole_chain_without_flags(spark):
    row = D.run_decisions(responses(spark, ALL), flags(spark)).first()
    assert row.raw_score == pytest.approx(0.8) and row.score == row.raw_score
    assert row.contributing_agents == ["MarketDataAgent", "TechnicalAnalyst", "SentimentAgent", "RiskManager"]
    assert [s.asset for s in row.signals] == ["CVX", "CVX", "XLE", "XLE"]
    assert (row.asset, row.direction, row.strength, row.confidence) == ("CVX", "BULLISH", "STRONG", 0.8)
    assert row.position_size_pct == 8.0 and row.risk_notes == "No active risk flags"


@pytest.mark.parametrize("count,direction,strength,raw", [
    (1, "BEARISH", "MODERATE", 0.544), (2, "BEARISH", "STRONG", 0.48),
])
def test_flags_override_risk_and_damp(spark, count, direction, strength, raw):
    row = D.run_decisions(responses(spark, ALL), flags(spark, *["F1", "F2"][:count])).first()
    risk = row.signals[3]
    assert (risk.direction, risk.strength) == (direction, strength)
    assert row.raw_score == pytest.approx(raw) and row.score == row.raw_score * 0.5
    assert row.risk_notes == ", ".join(["F1", "F2"][:count])


def test_missing_agents_are_left_out_and_empty_runs_give_nothing(spark):
    rows = [(1, "SentimentAgent", BULL), (1, "PortfolioManager", "no asset"), (2, "PortfolioManager", BULL), (3, "RiskManager", BULL)]
    got = D.run_decisions(responses(spark, rows), flags(spark)).collect()
    assert [r.run_id for r in got] == [1]
    assert got[0].contributing_agents == ["SentimentAgent"] and got[0].asset == "XLE"


def test_best_asset_and_social_direction_enter_the_signals(spark):
    rows = [(1, a, "CONFIDENCE: 50%") for a in ("TechnicalAnalyst", "SentimentAgent", "PortfolioManager")]
    best = spark.createDataFrame([("USO",)], "best_asset string")
    social = spark.createDataFrame([("BEARISH",)], "direction string")
    row = D.run_decisions(responses(spark, rows), flags(spark), best, social).first()
    assert [(s.asset, s.direction) for s in row.signals] == [("USO", "NEUTRAL"), ("XLE", "BEARISH")]
    assert row.asset == "USO"


def signals(spark, rows):
    data = [(1, agent, T, asset, direction, strength, confidence) for agent, asset, direction, strength, confidence in rows]
    return spark.createDataFrame(data, "run_id bigint, agent_name string, ts timestamp_ntz, asset string, direction string, strength string, confidence double")


def test_score_in_agent_order_whatever_the_row_order(spark):
    rows = [("RiskManager", "XLE", "BEARISH", "WEAK", 0.71), ("TechnicalAnalyst", "USO", "BULLISH", "WEAK", 0.71),
            ("MarketDataAgent", "WTI", "NEUTRAL", "STRONG", 1.0), ("Custom", "XLE", "BULLISH", "MODERATE", 0.5)]
    want = round(0.0 + 0.20 * 0.0 * 1.0 * 1.0 + 0.35 * 1.0 * 0.3 * 0.71 + 0.20 * -1.0 * 0.3 * 0.71 + 0.25 * 1.0 * 0.6 * 0.5, 4)
    assert D.scores(signals(spark, rows)).first().score == want
    assert D.scores(signals(spark, rows[::-1]).repartition(3)).first().score == want


def test_most_common_asset_ties_go_to_the_first_agent(spark):
    rows = [("RiskManager", "XLE", "BULLISH", "WEAK", 0.5), ("SentimentAgent", "XLE", "BULLISH", "WEAK", 0.5),
            ("TechnicalAnalyst", "USO", "BULLISH", "WEAK", 0.5), ("MarketDataAgent", "USO", "BULLISH", "WEAK", 0.5)]
    assert D.asset_votes(signals(spark, rows)).first().asset == "USO"
    assert D.asset_votes(signals(spark, rows[:3])).first().asset == "XLE"


def test_repeated_agent_rows_keep_the_latest(spark):
    rows = responses(spark, ALL).union(
        spark.createDataFrame([(1, "MarketDataAgent", T + dt.timedelta(hours=1), "sell", 1)], RESPONSES)
    )
    row = D.run_decisions(rows, flags(spark)).first()
    assert len(row.signals) == 4 and row.signals[0].direction == "BEARISH"


def test_size_is_capped(spark):
    got = spark.createDataFrame([(3.0, 0), (-0.31, 1)], "score double, n_flags int").selectExpr(f"{D.SIZED} AS s", f"{D.DAMPED} AS d").collect()
    assert [(r.s, r.d) for r in got] == [(20.0, 3.0), (pytest.approx(3.1), -0.155)]


def test_unknown_agent_has_the_default_weight(spark):
    df = spark.createDataFrame([("TechnicalAnalyst",), ("New",)], "agent_name string")
    assert {r.agent_name: r.weight for r in J.with_agent_weight(df).collect()} == {"TechnicalAnalyst": 0.35, "New": 0.25}


def test_validation_splits_and_names_faults(spark):
    rows = [("A", "XLE", "BULLISH", "STRONG", 1.0), ("A", None, "UP", "STRONG", 1.1), (None, "XLE", None, "x", float("nan"))]
    good, bad = X.validated(spark.createDataFrame(rows, "agent_name string, asset string, direction string, strength string, confidence double"))
    assert good.count() == 1
    reasons = sorted(r.reasons for r in bad.collect())
    assert reasons == [
        ["agent_name missing", "direction invalid", "strength invalid", "confidence outside 0..1"],
        ["asset missing", "direction invalid", "confidence outside 0..1"],
    ]


def test_records_and_notifications(spark):
    rows = X.signal_records(X.parsed(responses(spark, ALL[:1])))
    row = rows.first()
    assert (row.timestamp, row.date) == ("2024-05-01T12:00:00+00:00", "2024-05-01")
    note = D.notifications(D.run_decisions(responses(spark, ALL), flags(spark))).first()
    assert note.subject == "STRONG BULLISH signal: CVX" and '"position_size_pct":8.0' in note.message


def test_digest(spark):
    text = G.run_digest(D.run_decisions(responses(spark, ALL[1:2] + ALL[4:]), flags(spark, "F1"))).first().digest
    assert text == (
        "AGENT SIGNALS:\n  TechnicalAnalyst: BULLISH (STRONG) confidence=80% asset=CVX\nRISK FLAGS:\n  ⚠ F1\n"
        "AGGREGATED SIGNAL SCORE: +0.14\nSUGGESTED POSITION SIZE: 1.4% of portfolio"
    )


def test_placeholders_show_only_without_lines(spark):
    positions = spark.createDataFrame([(1, "A", 20.25)], "portfolio_id int, symbol string, size_pct double")
    lines = G.position_lines(positions).select("key", "line")
    assert [r.line for r in G.or_placeholder(lines, G.NO_POSITIONS).collect()] == ["  A: 20.2%"]
    assert [r.line for r in G.or_placeholder(lines.limit(0), G.NO_POSITIONS).collect()] == [G.NO_POSITIONS]
    top = spark.createDataFrame([("COP", 1), ("XLE", 3)], "ticker string, mentions bigint")
    assert G.ticker_text(top).first().tickers == "XLE(3), COP(1)" and G.ticker_text(top.limit(0)).first().tickers == "none"


def test_flag_limits_are_strict_and_ordered(spark):
    positions = spark.createDataFrame([(1, "A", 20.0), (1, "B", 20.5), (1, "C", 19.75), (2, "A", 30.0), (2, "B", 30.0)],
                                      "portfolio_id int, symbol string, size_pct double")
    vols = spark.createDataFrame([("XLE", 30.0), ("USO", 35.25), ("ZZZ", 90.0)], "symbol string, volatility double")
    lists = {r.portfolio_id: r.flags for r in R.flag_lists(R.risk_flags(positions, vols)).collect()}
    assert lists[1] == ["HIGH VOLATILITY: USO at 35.2%", "OVERWEIGHT: B at 20.5% (max 20.0%)",
                        "SECTOR OVEREXPOSURE: 60.2% in energy (max 60.0%)"]
    assert lists[2] == ["HIGH VOLATILITY: USO at 35.2%", "OVERWEIGHT: A at 30.0% (max 20.0%)", "OVERWEIGHT: B at 30.0% (max 20.0%)"]


def test_registered_agents(spark):
    X.register_agent("loud", lambda r: X.agent_rows(r, "MarketDataAgent").withColumn("strength", X.F.lit("STRONG")))
    assert X.run_agent("loud", responses(spark, [(1, "MarketDataAgent", "meh")])).first().strength == "STRONG"
    with pytest.raises(ValueError):
        X.run_agent("nobody", responses(spark, ALL))


def test_run_rows_need_one_shuffle(spark):
    plan = D.run_rows(X.parsed(responses(spark, ALL)))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_dated_evidence_reaches_the_runs_of_its_date(spark):
    rows = [(1, a, T, "CONFIDENCE: 50%", 1) for a in ("TechnicalAnalyst", "SentimentAgent", "RiskManager", "PortfolioManager")]
    rows += [(2, a, T + dt.timedelta(days=1), t, 1) for _, a, _, t, _ in rows]
    best = spark.createDataFrame([(T.date(), "USO")], "d date, best_asset string")
    social = spark.createDataFrame([((T + dt.timedelta(days=1)).date(), "BULLISH")], "d date, direction string")
    flags = spark.createDataFrame([(1, (T + dt.timedelta(days=1)).date(), 2, "s", "F")], "portfolio_id int, d date, flag_order int, symbol string, flag string")
    got = {r.run_id: r for r in D.run_decisions(spark.createDataFrame(rows, RESPONSES), flags, best, social).collect()}
    assert [(s.asset, s.direction) for s in got[1].signals] == [("USO", "NEUTRAL"), ("XLE", "NEUTRAL"), ("XLE", "NEUTRAL")]
    assert [(s.asset, s.direction) for s in got[2].signals] == [("XLE", "NEUTRAL"), ("XLE", "BULLISH"), ("XLE", "BEARISH")]
    assert (got[1].n_flags, got[2].n_flags) == (0, 1)


def test_unlisted_agents_count_with_the_default_weight(spark):
    more = [(1, "Zeta", "BULLISH STRONG CONFIDENCE: 80% ASSET: USO"), (1, "Beta", "BEARISH WEAK CONFIDENCE: 50%"), (1, "Beta", "BEARISH WEAK CONFIDENCE: 50%")]
    rows = responses(spark, ALL + more)
    row = D.run_decisions(rows, flags(spark)).first()
    assert [s.agent_name for s in row.signals][-2:] == ["Beta", "Zeta"] and len(row.signals) == 6
    plain = D.run_decisions(responses(spark, ALL), flags(spark)).first()
    assert row.raw_score == pytest.approx(plain.raw_score + 0.25 * 0.8 - 0.25 * 0.3 * 0.5, abs=1e-4)
    assert row.contributing_agents == [s.agent_name for s in row.signals]


def test_market_flags_hold_without_portfolio_or_positions(spark):
    market = spark.createDataFrame([(1, "USO", "HIGH VOLATILITY: USO at 35.2%"), (1, "XLE", "HIGH VOLATILITY: XLE at 40.0%")], "flag_order int, symbol string, flag string")
    nobody = spark.createDataFrame([], "portfolio_id int, flag_order int, symbol string, flag string")
    rows = responses(spark, ALL).withColumn("portfolio_id", X.F.lit(None).cast("int"))
    row = D.run_decisions(rows, nobody, market_flags=market).first()
    assert row.n_flags == 2 and row.risk_notes == "HIGH VOLATILITY: USO at 35.2%, HIGH VOLATILITY: XLE at 40.0%"
    risk = [s for s in row.signals if s.agent_name == "RiskManager"][0]
    assert (risk.direction, risk.strength) == ("BEARISH", "STRONG") and row.score == row.raw_score * 0.5
    calm = D.run_decisions(rows, nobody, market_flags=market.limit(0)).first()
    assert (calm.n_flags, calm.risk_notes) == (0, "No active risk flags")
    both = D.run_decisions(responses(spark, ALL), flags(spark, "F1"), market_flags=market).first()
    assert both.n_flags == 3 and both.risk_notes.endswith("F1")


def test_portfolios_without_positions_have_market_flags(spark):
    positions = spark.createDataFrame([], "portfolio_id int, symbol string, size_pct double")
    vols = spark.createDataFrame([("XLE", 31.0), ("USO", float("nan"))], "symbol string, volatility double")
    everyone = spark.createDataFrame([(1,), (1,), (2,)], "portfolio_id int")
    got = R.risk_flags(positions, vols, portfolios=everyone).collect()
    assert sorted((r.portfolio_id, r.flag) for r in got) == [(1, "HIGH VOLATILITY: XLE at 31.0%"), (2, "HIGH VOLATILITY: XLE at 31.0%")]
