"""Signals of every agent, their aggregation, and recommendations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..constants import PORTFOLIO_AGENT
from ..functions.times import iso_date, iso_utc
from ..operators import decisions as D
from ..operators import digests as G
from ..operators import indicators as I
from ..operators import lookups as J
from ..operators import risk as R
from ..operators import sentiment as S
from ..operators import signals as X
from ..sources import payloads as P
from . import queries_market as M
from . import queries_text as Q
from .bindings import TICKERS, Inputs
from .oracle_views import VIEWS, fixed, half_even, q
from .registry import query

# every run has the market's volatility flags, whatever its portfolio holds
VIEWS["run_flags"] = """
SELECT portfolio_id, flag_order, symbol, flag FROM (SELECT DISTINCT portfolio_id FROM responses), vol_flags
UNION ALL SELECT portfolio_id, flag_order, symbol, flag FROM own_flags WHERE portfolio_id IN (SELECT portfolio_id FROM responses)"""
VIEWS["flag_counts"] = """
SELECT portfolio_id, count(*) AS n_flags, string_agg(flag, ', ' ORDER BY flag_order, symbol) AS notes,
       string_agg(concat('  ⚠ ', flag), chr(10) ORDER BY flag_order, symbol) AS flag_block FROM run_flags GROUP BY portfolio_id"""
VIEWS["final_signals"] = """
SELECT s.run_id, s.portfolio_id, s.agent_name, s.ts, s.confidence, coalesce(n_flags, 0) AS n_flags,
  CASE agent_name WHEN 'MarketDataAgent' THEN 1 WHEN 'TechnicalAnalyst' THEN 2 WHEN 'SentimentAgent' THEN 3 ELSE 4 END AS place,
  CASE agent_name WHEN 'TechnicalAnalyst' THEN (SELECT best_asset FROM best) WHEN 'MarketDataAgent' THEN asset ELSE 'XLE' END AS asset,
  CASE WHEN agent_name = 'RiskManager' AND n_flags >= 1 THEN 'BEARISH'
       WHEN agent_name = 'SentimentAgent' AND direction = 'NEUTRAL' THEN (SELECT direction FROM social_dir) ELSE direction END AS direction,
  CASE WHEN agent_name = 'RiskManager' AND n_flags >= 2 THEN 'STRONG'
       WHEN agent_name = 'RiskManager' AND n_flags = 1 THEN 'MODERATE' ELSE strength END AS strength
FROM signals s LEFT JOIN flag_counts USING (portfolio_id)"""
PART = """CASE agent_name WHEN 'MarketDataAgent' THEN 0.2::DOUBLE WHEN 'TechnicalAnalyst' THEN 0.35::DOUBLE WHEN 'SentimentAgent' THEN 0.25::DOUBLE
       WHEN 'RiskManager' THEN 0.2::DOUBLE ELSE 0.25::DOUBLE END
  * CASE direction WHEN 'BULLISH' THEN 1.0::DOUBLE WHEN 'BEARISH' THEN -1.0::DOUBLE ELSE 0.0::DOUBLE END
  * CASE strength WHEN 'STRONG' THEN 1.0::DOUBLE WHEN 'MODERATE' THEN 0.6::DOUBLE ELSE 0.3::DOUBLE END * confidence"""


def _total(source: str) -> str:
    parts = " + ".join(
        f"coalesce(max(CASE WHEN agent_name = '{a}' THEN part END), 0.0::DOUBLE)"
        for a in ("MarketDataAgent", "TechnicalAnalyst", "SentimentAgent", "RiskManager")
    )
    return f"SELECT run_id, 0.0::DOUBLE + {parts} AS total FROM (SELECT *, {PART} AS part FROM {source}) GROUP BY run_id"


VIEWS["plain_total"] = _total("signals")
VIEWS["final_total"] = _total("final_signals")
VIEWS["plain_score"] = f"SELECT run_id, {half_even('total', 4)} AS score FROM plain_total"
VIEWS["final_score"] = f"SELECT run_id, {half_even('total', 4)} AS raw_score FROM final_total"
VIEWS["asset_votes"] = """
SELECT run_id, asset FROM (SELECT run_id, asset, row_number() OVER (PARTITION BY run_id ORDER BY count(*) DESC, min(place)) AS k
  FROM final_signals GROUP BY run_id, asset) WHERE k = 1"""
VIEWS["run_lines"] = f"""
SELECT run_id, count(*) AS n_signals, string_agg(agent_name, ',' ORDER BY place) AS agents,
  string_agg(concat('  ', agent_name, ': ', direction, ' (', strength, ') confidence=', CAST(CAST({half_even('(confidence * 100)', 0)} AS BIGINT) AS VARCHAR),
             '% asset=', asset), chr(10) ORDER BY place) AS signal_block
FROM final_signals GROUP BY run_id"""
VIEWS["decided0"] = """
SELECT a.run_id, a.portfolio_id, a.date, coalesce(n_flags, 0) AS n_flags, notes, flag_block, raw_score,
       CASE WHEN n_flags > 0 THEN raw_score * 0.5 ELSE raw_score END AS score, a.named, a.direction, a.strength, a.confidence, a.sized, a.response_text
FROM read_texts a JOIN final_score USING (run_id) LEFT JOIN flag_counts USING (portfolio_id) WHERE a.agent_name = 'PortfolioManager'"""
VIEWS["decided1"] = "SELECT *, least(abs(score) * 10, 20.0::DOUBLE) AS suggested FROM decided0"
VIEWS["decided"] = f"""
SELECT run_id, portfolio_id, date, n_flags, raw_score, score, suggested AS suggested_size_pct, coalesce(named, v.asset) AS asset,
       direction, strength, confidence,
       CASE WHEN sized IS NOT NULL THEN least(sized, 20.0::DOUBLE) ELSE {half_even('suggested', 1)} END AS position_size_pct,
       coalesce(notes, 'No active risk flags') AS risk_notes, agents AS contributing_agents, signal_block, flag_block, n_signals, response_text
FROM decided1 JOIN asset_votes v USING (run_id) JOIN run_lines USING (run_id)"""


def best_asset(inp: Inputs):
    return I.best_asset(M.records(inp))


def social_direction(inp: Inputs):
    return S.with_margin(Q.social(inp))


def market_flags(inp: Inputs):
    return R.market_flags(M.volatilities(inp), M.SHOWN_SYMBOLS)


def flags(inp: Inputs):
    """The flags of every portfolio that a run has."""
    return R.risk_flags(inp.positions(), M.volatilities(inp), symbols=M.SHOWN_SYMBOLS, portfolios=inp.responses())


def decisions(inp: Inputs):
    responses = inp.responses().unionByName(inp.answers())
    return D.run_decisions(
        responses, R.risk_flags(inp.positions()), best_asset(inp), social_direction(inp), market_flags=market_flags(inp)
    )


SIGNAL = ["run_id", "agent_name", "asset", "direction", "strength", "confidence"]
SIGNAL_SQL = ", ".join(SIGNAL)


@query("technical_signal", q("""
SELECT run_id, agent_name, (SELECT best_asset FROM best) AS asset, direction, strength, confidence FROM signals WHERE agent_name = 'TechnicalAnalyst'"""))
def technical_signal(inp):
    return X.technical_signal(inp.responses(), best_asset(inp)).select(*SIGNAL)


@query("sentiment_signal", q(f"SELECT {SIGNAL_SQL} FROM final_signals WHERE agent_name = 'SentimentAgent'"))
def sentiment_signal(inp):
    return X.sentiment_signal(inp.responses(), social_direction(inp)).select(*SIGNAL)


@query("risk_signal", q(f"SELECT {SIGNAL_SQL}, n_flags FROM final_signals WHERE agent_name = 'RiskManager'"))
def risk_signal(inp):
    return X.risk_signal(inp.responses(), flags(inp)).select(*SIGNAL, "n_flags")


@query("join_agent_weight", q("""
SELECT run_id, agent_name, CASE agent_name WHEN 'MarketDataAgent' THEN 0.2::DOUBLE WHEN 'TechnicalAnalyst' THEN 0.35::DOUBLE
       WHEN 'SentimentAgent' THEN 0.25::DOUBLE WHEN 'RiskManager' THEN 0.2::DOUBLE ELSE 0.25::DOUBLE END AS weight FROM read_texts"""))
def join_agent_weight(inp):
    rows = inp.responses().unionByName(inp.answers())
    return J.with_agent_weight(rows).select("run_id", "agent_name", "weight")


@query("join_run_evidence", q("""
SELECT run_id, portfolio_id, count(*) AS n_signals,
       coalesce(max(CASE WHEN agent_name = 'MarketDataAgent' THEN direction END), '') AS market_direction,
       coalesce(max(CASE WHEN agent_name = 'TechnicalAnalyst' THEN direction END), '') AS technical_direction,
       coalesce(max(CASE WHEN agent_name = 'SentimentAgent' THEN direction END), '') AS sentiment_direction,
       coalesce(max(CASE WHEN agent_name = 'RiskManager' THEN direction END), '') AS risk_direction,
       coalesce(max(n_flags), 0) AS n_flags
FROM signals LEFT JOIN flag_counts USING (portfolio_id) GROUP BY run_id, portfolio_id"""))
def join_run_evidence(inp):
    return J.run_evidence(X.parsed(inp.responses()), flags(inp))


@query("signal_record", q("""
SELECT run_id, agent_name, asset, direction, strength, confidence, response_text AS reasoning, "timestamp", date FROM signals"""))
def signal_record(inp):
    return X.signal_records(X.parsed(inp.responses())).drop("raw_data")


@query("validate_rows", q("""
SELECT run_id, agent_name, concat_ws('; ', CASE WHEN direction NOT IN ('BULLISH', 'NEUTRAL') THEN 'direction invalid' END,
       CASE WHEN confidence * 1.5 > 1 THEN 'confidence outside 0..1' END) AS reasons FROM signals"""))
def validate_rows(inp):
    """Every signal with its list of faults, after faults were put in: a renamed direction, raised confidence."""
    broken = X.parsed(inp.responses()).withColumns({
        "direction": F.when(F.col("direction") == "BEARISH", "DOWN").otherwise(F.col("direction")),
        "confidence": F.col("confidence") * 1.5,
    })
    return X.with_reasons(broken).select("run_id", "agent_name", F.array_join("reasons", "; ").alias("reasons"))


@query("validate_rejected", q("""
SELECT run_id, agent_name FROM signals WHERE confidence * 1.5 > 1"""))
def validate_rejected(inp):
    broken = X.parsed(inp.responses()).withColumn("confidence", F.col("confidence") * 1.5)
    return X.validated(broken)[1].select("run_id", "agent_name")


@query("agg_score", q("SELECT run_id, score FROM plain_score"))
def agg_score(inp):
    return D.scores(X.parsed(inp.responses()))


@query("damp_score", q("""
SELECT run_id, CASE WHEN n_flags > 0 THEN score * 0.5 ELSE score END AS damped
FROM plain_score JOIN (SELECT DISTINCT run_id, portfolio_id FROM responses) USING (run_id) LEFT JOIN flag_counts USING (portfolio_id)"""))
def damp_score(inp):
    runs = inp.responses().groupBy("run_id").agg(F.max("portfolio_id").alias("portfolio_id"))
    counted = R.flag_counts(flags(inp))
    rows = D.scores(X.parsed(inp.responses())).join(runs, "run_id").join(counted, "portfolio_id", "left")
    return rows.selectExpr("run_id", f"{D.DAMPED} AS damped")


@query("size_position", q("SELECT run_id, least(abs(score) * 10, 20.0::DOUBLE) AS size_pct FROM plain_score"))
def size_position(inp):
    return D.scores(X.parsed(inp.responses())).selectExpr("run_id", f"{D.SIZED} AS size_pct")


@query("final_position", q("SELECT run_id, suggested_size_pct, position_size_pct FROM decided"))
def final_position(inp):
    return decisions(inp).select("run_id", "suggested_size_pct", "position_size_pct")


@query("fallback_asset", q("""
SELECT run_id, asset FROM (SELECT run_id, asset, row_number() OVER (PARTITION BY run_id ORDER BY count(*) DESC,
   min(CASE agent_name WHEN 'MarketDataAgent' THEN 1 WHEN 'TechnicalAnalyst' THEN 2 WHEN 'SentimentAgent' THEN 3 ELSE 4 END)) AS k
  FROM signals GROUP BY run_id, asset) WHERE k = 1"""))
def fallback_asset(inp):
    return D.asset_votes(X.parsed(inp.responses()))


REC = ["run_id", "portfolio_id", "date", "asset", "direction", "strength", "confidence", "position_size_pct", "risk_notes"]


@query("recommendation", q(f"SELECT {', '.join(REC)}, contributing_agents FROM decided"))
def recommendation(inp):
    return decisions(inp).select(*REC, F.array_join("contributing_agents", ",").alias("contributing_agents"))


@query("run_decisions", q("""
SELECT run_id, n_signals, n_flags, raw_score, score, asset, direction, strength, confidence, position_size_pct FROM decided"""))
def run_decisions(inp):
    return decisions(inp).select(
        "run_id", F.size("signals").cast("bigint").alias("n_signals"), "n_flags", "raw_score", "score", "asset", "direction",
        "strength", "confidence", "position_size_pct",
    )


def recommendation_records(inp: Inputs):
    """Recommendations in the form of signal records."""
    return decisions(inp).select(
        "run_id", F.lit(PORTFOLIO_AGENT).alias("agent_name"), "asset", "direction", "strength", "confidence",
        iso_utc("ts").alias("timestamp"), iso_date("ts").alias("date"),
    )


@query("latest_recommendation", q("""
SELECT d.run_id, 'PortfolioManager' AS agent_name, d.asset, d.direction, d.strength, d.confidence, "timestamp", d.date
FROM decided d JOIN read_texts t ON t.run_id = d.run_id AND t.agent_name = 'PortfolioManager' ORDER BY "timestamp" DESC, d.run_id DESC LIMIT 1"""))
def latest_recommendation(inp):
    return D.latest_recommendation(recommendation_records(inp))


@query("strong_only", q("SELECT run_id, asset, direction, strength, confidence FROM decided WHERE strength = 'STRONG'"))
def strong_only(inp):
    return D.strong_only(decisions(inp)).select("run_id", "asset", "direction", "strength", "confidence")


@query("notify_strong", q("""
SELECT run_id, concat('STRONG ', direction, ' signal: ', asset) AS subject, asset, direction, strength, confidence, position_size_pct, risk_notes
FROM decided WHERE strength = 'STRONG'"""))
def notify_strong(inp):
    """Messages read back from their JSON."""
    schema = "asset string, direction string, strength string, confidence double, position_size_pct double, risk_notes string"
    rows = D.notifications(decisions(inp)).withColumn("m", F.from_json("message", schema))
    return rows.select("run_id", "subject", "m.*")


@query("evidence_digest", q(f"""
SELECT run_id, concat_ws(chr(10), 'AGENT SIGNALS:', signal_block, 'RISK FLAGS:', coalesce(flag_block, '  ✓ None'),
  concat('AGGREGATED SIGNAL SCORE: ', CASE WHEN score >= 0 THEN '+' ELSE '' END, {fixed('score', 2)}),
  concat('SUGGESTED POSITION SIZE: ', {fixed('suggested_size_pct', 1)}, '% of portfolio')) AS digest FROM decided"""))
def evidence_digest(inp):
    return G.run_digest(decisions(inp))


@query("evidence_market_digest", q(f"""
SELECT 'indicators' AS part, symbol AS key, concat(symbol, ': close=$', CAST(close AS VARCHAR), ', RSI=', CAST(rsi AS VARCHAR), ', MACD_hist=',
   {fixed('macd_hist', 4)}, ', BB=[', CAST(bb_low AS VARCHAR), '-', CAST(bb_high AS VARCHAR), '] | Signals: ', replace(ta_signals, '; ', ', ')) AS line FROM ta_rec
UNION ALL SELECT 'volatility', symbol, concat('  ', symbol, ': ', {fixed('volatility', 1)}, '% annualized') FROM vol
UNION ALL SELECT 'prices', symbol, concat('  ', symbol, ': $', {fixed('close', 2)}) FROM bars_d WHERE d = (SELECT max(d) FROM bars_d)
UNION ALL SELECT 'positions', concat(portfolio_id, '/', symbol), concat('  ', symbol, ': ', {fixed('size_pct', 1)}, '%') FROM positions
UNION ALL SELECT 'inventory', series_id, concat('  Inventory: ', CAST(v AS VARCHAR), ' Mmbbl (change: ', coalesce(CAST({half_even('delta', 2)} AS VARCHAR), 'None'), ' Mmbbl)')
  FROM leveled WHERE place = 1
UNION ALL SELECT 'tickers', '', string_agg(concat(ticker, '(', mentions, ')'), ', ' ORDER BY mentions DESC, ticker)
  FROM (SELECT ticker, count(*) AS mentions FROM mentions GROUP BY ticker ORDER BY mentions DESC, ticker LIMIT 5)
UNION ALL SELECT 'headlines', url, concat('  - ', title) FROM (SELECT * FROM headlines ORDER BY query_order, rank LIMIT 15)
UNION ALL SELECT 'flags', symbol, concat('  ⚠ ', flag) FROM vol_flags
UNION ALL SELECT 'macro', series_id, concat('  ', series_id, ': ', {fixed('value', 2)})
  FROM (SELECT series_id, max_by(value, d) AS value FROM obs GROUP BY series_id ORDER BY series_id LIMIT 6)"""))
def evidence_market_digest(inp):
    prices = inp.bars_d().filter(F.col("d") == inp.table("orders").agg(F.max(F.to_date("o_orderdate"))).scalar())
    raised = market_flags(inp).selectExpr("symbol AS key", "concat('  ⚠ ', flag) AS line")
    tickers = G.ticker_text(S.top_tickers(inp.posts(), TICKERS))
    macro = inp.obs().groupBy("series_id").agg(F.max_by("value", "d").alias("value"))
    parts = {
        "indicators": G.indicator_lines(M.records(inp)),
        "volatility": G.volatility_lines(M.volatilities(inp)),
        "prices": G.price_lines(prices.select(F.col("symbol").alias("key"), F.col("close").alias("value"))),
        "inventory": G.or_placeholder(G.inventory_lines(P.inventory_delta(inp.inventory_payloads())), G.NO_INVENTORY),
        "positions": G.or_placeholder(
            G.position_lines(inp.positions()).selectExpr("concat(portfolio_id, '/', symbol) AS key", "line"), G.NO_POSITIONS
        ),
        "headlines": G.or_placeholder(G.headline_lines(S.recent_headlines(Q.headlines(inp))), G.NO_HEADLINES),
        "flags": G.or_placeholder(raised, G.NO_FLAGS),
        "tickers": tickers.selectExpr("'' AS key", "tickers AS line"),
        "macro": G.macro_lines(macro.select(F.col("series_id").alias("key"), "value", F.col("series_id").alias("place"))),
    }
    rows = [lines.select(F.lit(part).alias("part"), "key", "line") for part, lines in parts.items()]
    out = rows[0]
    for more in rows[1:]:
        out = out.unionByName(more)
    return out


@query("agent_plugin", q(f"""
SELECT {SIGNAL_SQL} FROM final_signals WHERE agent_name IN ('TechnicalAnalyst', 'SentimentAgent', 'RiskManager')"""))
def agent_plugin(inp):
    """Three agents by their registered names, each with its evidence."""
    rows = X.run_agent("technical", inp.responses(), best_asset=best_asset(inp)).select(*SIGNAL)
    rows = rows.unionByName(X.run_agent("sentiment", inp.responses(), margin=social_direction(inp)).select(*SIGNAL))
    return rows.unionByName(X.run_agent("risk", inp.responses(), flags=flags(inp)).select(*SIGNAL))
