"""Runs with the evidence of their own date, against SQL that starts every look-back anew for each date."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from ..operators import decisions as D
from ..operators import evidence as E
from ..operators import indicators as I
from ..operators import risk as R
from ..operators import sentiment as S
from . import queries_decisions, queries_market  # noqa: F401  (their views are used here)
from .bindings import BEARISH, BULLISH, NEWS, SERIES_NAMES, TICKERS, Inputs
from .oracle_views import VIEWS, fixed, half_even, q
from .queries_text import _words
from .registry import day, query, sql_day

#: The symbols whose volatility is watched and the limit, which random prices pass now and then only.
WATCHED, LIMIT = ["1-URGENT", "3-MEDIUM", "5-LOW"], 650.0
SLICE = 90 * 86_400


def dated_responses(inp: Inputs):
    """The responses of runs that are spread over 400 days in the middle of the price history."""
    return inp.responses().withColumn("ts", F.expr(
        "CAST('1994-10-01' AS timestamp_ntz) + make_dt_interval(CAST(run_id % 400 AS int)) + (ts - date_trunc('day', ts))"
    ))


VIEWS["run_responses"] = re.sub(
    r"\n {7}ts,\n", "\n       TIMESTAMP '1994-10-01' + to_days(CAST(floor(event_id / 4) % 400 AS INTEGER)) + (ts - date_trunc('day', ts)) AS ts,\n", VIEWS["responses"], count=1
)
VIEWS["want_days"] = "SELECT DISTINCT CAST(ts AS DATE) AS d FROM run_responses"


def _anew(prefix: str, days: int, names: list[str]) -> None:
    """Views over one history per wanted date and symbol: the bars of that date's look-back and nothing else."""
    VIEWS[f"{prefix}bars_h"] = f"""
SELECT concat(strftime(w.d, '%Y-%m-%d'), '|', b.symbol) AS symbol, CAST(b.d AS TIMESTAMP) AS ts, b.close
FROM want_days w JOIN bars_d b ON b.d <= w.d AND b.d >= w.d - {days}"""
    for name in names:
        text = VIEWS[name]
        for other in ["bars_h", *names]:
            text = re.sub(rf"\b{other}\b", prefix + other, text)
        VIEWS[prefix + name] = text


_anew("t90_", I.LOOKBACK_DAYS, ["bars_n", "ema", "ind", "ta", "ta_rec"])
_anew("v60_", I.VOLATILITY_DAYS, ["returns", "vol0"])
VIEWS["day_vol"] = f"""
SELECT split_part(symbol, '|', 2) AS symbol, CAST(split_part(symbol, '|', 1) AS DATE) AS d, {half_even('v', 2)} AS volatility FROM v60_vol0 WHERE v IS NOT NULL"""
VIEWS["day_records"] = "SELECT * REPLACE (split_part(symbol, '|', 2) AS symbol), CAST(split_part(symbol, '|', 1) AS DATE) AS d FROM t90_ta_rec"
VIEWS["day_short"] = """
SELECT split_part(symbol, '|', 2) AS symbol, CAST(split_part(symbol, '|', 1) AS DATE) AS d FROM t90_bars_h GROUP BY symbol HAVING count(*) < 26"""
VIEWS["day_best"] = "SELECT d, min_by(symbol, (-abs(ta_score), symbol)) AS best_asset FROM day_records GROUP BY d"
VIEWS["day_vol_flags"] = f"""
SELECT d, 1 AS flag_order, symbol, concat('HIGH VOLATILITY: ', symbol, ' at ', {fixed('volatility', 1)}, '%') AS flag
FROM day_vol WHERE symbol IN ({', '.join(f"'{s}'" for s in WATCHED)}) AND volatility > {LIMIT}"""
VIEWS["day_posts"] = "SELECT doc_id, polarity, body, CAST(make_timestamp(created_utc * 1000000) AS DATE) AS pd FROM polar"
VIEWS["day_social0"] = """
SELECT w.d, CAST(count_if(polarity = 'bullish') AS BIGINT) AS bullish_count, CAST(count_if(polarity = 'bearish') AS BIGINT) AS bearish_count,
       CAST(count_if(polarity = 'neutral') AS BIGINT) AS neutral_count, count(*) AS total_posts,
       count_if(polarity = 'bullish') / count(*) * 100 AS bull0, count_if(polarity = 'bearish') / count(*) * 100 AS bear0
FROM want_days w JOIN day_posts p ON p.pd = w.d OR p.pd = w.d - 1 GROUP BY w.d"""
VIEWS["day_social"] = f"""
SELECT d, bullish_count, bearish_count, neutral_count, total_posts, {half_even('bull0', 1)} AS bullish_pct, {half_even('bear0', 1)} AS bearish_pct FROM day_social0"""
VIEWS["day_social_dir"] = """
SELECT *, CASE WHEN bullish_pct > bearish_pct + 15 THEN 'BULLISH' WHEN bearish_pct > bullish_pct + 15 THEN 'BEARISH' ELSE 'NEUTRAL' END AS direction FROM day_social"""
VIEWS["day_tickers"] = f"""
SELECT w.d, ticker, count(*) AS mentions FROM want_days w JOIN day_posts p ON p.pd = w.d OR p.pd = w.d - 1, (SELECT unnest({_words(TICKERS)}) AS ticker)
WHERE contains(lower(body), lower(ticker)) GROUP BY w.d, ticker QUALIFY row_number() OVER (PARTITION BY w.d ORDER BY count(*) DESC, ticker) <= 5"""
VIEWS["day_page"] = f"""
SELECT w.d, p.url, p.title, list_position({_words(NEWS)}, p.query) AS query_order,
       row_number() OVER (PARTITION BY w.d, p.query ORDER BY p.created_utc DESC, p.url) AS rank
FROM want_days w JOIN (SELECT *, CAST(make_timestamp(created_utc * 1000000) AS DATE) AS pd FROM posts) p ON p.pd <= w.d AND p.pd >= w.d - 2
WHERE list_contains({_words(NEWS)}, p.query)"""
VIEWS["day_headlines"] = """
SELECT d, title, row_number() OVER (PARTITION BY d ORDER BY query_order, rank) AS place
FROM (SELECT *, row_number() OVER (PARTITION BY d, url ORDER BY query_order, rank) AS copy FROM day_page WHERE rank <= 10) WHERE copy = 1"""
VIEWS["day_prices"] = f"""
SELECT w.d, b.symbol, b.close FROM (SELECT w.d, max(b.d) AS price_date FROM want_days w JOIN bars_d b ON b.d <= w.d AND b.d >= w.d - {E.PRICE_DAYS} GROUP BY w.d) w
JOIN bars_d b ON b.d = w.price_date"""
VIEWS["day_macro"] = """
SELECT w.d, o.series_id, max_by(o.value, o.d) AS value FROM want_days w JOIN obs o ON o.d <= w.d AND o.d >= w.d - 30 JOIN names USING (series_id) GROUP BY w.d, o.series_id"""
VIEWS["day_levels"] = """
SELECT w.d, max_by(o.v, o.p) AS level, max_by(o.change, o.p) AS change
FROM want_days w JOIN (SELECT CAST(p AS DATE) AS p, v, v - lag(v) OVER (ORDER BY p) AS change FROM (
  SELECT date_trunc('week', d) AS p, max(value) AS v FROM obs WHERE series_id = 'AF' GROUP BY ALL)) o ON o.p <= w.d GROUP BY w.d"""


def days_of_bars(inp: Inputs):
    return inp.bars_d().select("d").distinct()


ALL_DAYS = "SELECT DISTINCT d FROM bars_d"


def records(inp: Inputs):
    return I.records_by_day(inp.daily_bars())


def volatilities(inp: Inputs):
    return E.risk_evidence(inp.daily_bars(), WATCHED, slice_seconds=SLICE)


@query("ta_record_by_day", q(
    "SELECT * REPLACE (strftime(d, '%Y-%m-%d') AS d, CAST(ta_score AS INT) AS ta_score) FROM day_records",
    want_days=ALL_DAYS, bars_d=VIEWS["bars_d"].replace("max(o_totalprice)", "floor(max(o_totalprice))")))
def ta_record_by_day(inp):
    """The record of every symbol and date over that date's own 90 days; whole prices, whose means round alike everywhere."""
    whole = inp.daily_bars().withColumn("close", F.floor("close").cast("double"))
    rows = I.records_by_day(whole).join(days_of_bars(inp), "d")
    return rows.withColumns({"ta_signals": F.array_join("ta_signals", "; "), "d": day("d")})


@query("best_asset_by_day", q("SELECT strftime(d, '%Y-%m-%d') AS d, best_asset FROM day_best", want_days=ALL_DAYS))
def best_asset_by_day(inp):
    return I.best_asset_by_day(records(inp)).join(days_of_bars(inp), "d").select(day("d").alias("d"), "best_asset")


@query("volatility_by_day", q("SELECT symbol, strftime(d, '%Y-%m-%d') AS d, volatility FROM day_vol", want_days=ALL_DAYS))
def volatility_by_day(inp):
    rows = I.volatility_by_day(inp.daily_bars(), slice_seconds=SLICE).join(days_of_bars(inp), "d")
    return rows.select("symbol", day("d").alias("d"), "volatility")


@query("flag_high_vol_by_day", q("SELECT strftime(d, '%Y-%m-%d') AS d, flag_order, symbol, flag FROM day_vol_flags", want_days=ALL_DAYS))
def flag_high_vol_by_day(inp):
    rows = R.market_flags(volatilities(inp), WATCHED, LIMIT).join(days_of_bars(inp), "d")
    return rows.select(day("d").alias("d"), "flag_order", "symbol", "flag")


@query("sentiment_by_day", q(
    "SELECT * REPLACE (strftime(d, '%Y-%m-%d') AS d) FROM day_social_dir", want_days="SELECT DISTINCT unnest([d, d + 1]) AS d FROM dated_posts"))
def sentiment_by_day(inp):
    """Counts, shares and margin direction of the posts that every date sees."""
    return S.with_margin(S.summary_by_day(inp.articles(), 1, BULLISH, BEARISH)).withColumn("d", day("d"))


@query("headlines_by_day", q(
    "SELECT strftime(d, '%Y-%m-%d') AS d, CAST(place - 1 AS INT) AS place, title FROM day_headlines WHERE place <= 15",
    want_days="SELECT DISTINCT unnest([d, d + 1, d + 2]) AS d FROM dated_posts"))
def headlines_by_day(inp):
    rows = S.headlines_by_day(inp.articles(), NEWS)
    return rows.select(day("d").alias("d"), F.posexplode("headlines").alias("place", "title"))


def evidence(inp: Inputs, *kinds: str):
    """One row per run date with what the agents of its runs knew: all kinds, or those named."""
    dates = E.run_dates(dated_responses(inp))
    weekly = inp.obs().groupBy("series_id", F.date_trunc("week", "d").cast("date").alias("d")).agg(F.max("value").alias("level"))
    gather = {
        "prices": lambda: E.price_evidence(dates, inp.bars_d()),
        "macro": lambda: E.macro_evidence(inp.obs(), SERIES_NAMES),
        "inventory": lambda: E.inventory_evidence(dates, weekly, "AF"),
        "technical": lambda: E.technical_evidence(inp.daily_bars()),
        "headlines": lambda: S.headlines_by_day(inp.articles(), NEWS),
        "social": lambda: E.social_evidence(inp.articles(), 1, TICKERS, bullish=BULLISH, bearish=BEARISH),
    }
    return E.dated_evidence(dates, *[part() for kind, part in gather.items() if not kinds or kind in kinds])


def signals(inp: Inputs, *kinds: str):
    return E.dated_signals(dated_responses(inp), evidence(inp, *kinds), R.risk_flags(inp.positions()), volatilities(inp), WATCHED, LIMIT)


@query("inventory_as_of", q(f"SELECT strftime(d, '%Y-%m-%d') AS d, level AS inventory_mmbbl, {half_even('change', 2)} AS change_mmbbl FROM day_levels"))
def inventory_as_of(inp):
    """The weekly level that each run date saw, by an as-of join."""
    return evidence(inp, "inventory").select(day("d").alias("d"), "inventory.*").filter("inventory_mmbbl IS NOT NULL")


# --- what depends on the date, in place of the views of the same names -----------------------

DATED = {
    "responses": "SELECT * FROM run_responses",
    "run_day": "SELECT run_id, portfolio_id, CAST(max(ts) AS DATE) AS d FROM run_responses GROUP BY run_id, portfolio_id",
    "run_flag_rows": """
SELECT r.run_id, f.flag_order, f.symbol, f.flag FROM run_day r JOIN day_vol_flags f ON f.d = r.d
UNION ALL SELECT r.run_id, f.flag_order, f.symbol, f.flag FROM run_day r JOIN own_flags f ON f.portfolio_id = r.portfolio_id""",
    "run_flag_counts": """
SELECT run_id, count(*) AS n_flags, string_agg(flag, ', ' ORDER BY flag_order, symbol) AS notes,
       string_agg(concat('  ⚠ ', flag), chr(10) ORDER BY flag_order, symbol) AS flag_block FROM run_flag_rows GROUP BY run_id""",
    "final_signals": """
SELECT s.run_id, s.portfolio_id, s.agent_name, s.ts, s.confidence, s.response_text, r.d, coalesce(n_flags, 0) AS n_flags,
  CASE agent_name WHEN 'MarketDataAgent' THEN 1 WHEN 'TechnicalAnalyst' THEN 2 WHEN 'SentimentAgent' THEN 3 ELSE 4 END AS place,
  CASE agent_name WHEN 'TechnicalAnalyst' THEN coalesce(b.best_asset, 'XLE') WHEN 'MarketDataAgent' THEN asset ELSE 'XLE' END AS asset,
  CASE WHEN agent_name = 'RiskManager' AND n_flags >= 1 THEN 'BEARISH'
       WHEN agent_name = 'SentimentAgent' AND s.direction = 'NEUTRAL' THEN coalesce(o.direction, 'NEUTRAL') ELSE s.direction END AS direction,
  CASE WHEN agent_name = 'RiskManager' AND n_flags >= 2 THEN 'STRONG'
       WHEN agent_name = 'RiskManager' AND n_flags = 1 THEN 'MODERATE' ELSE strength END AS strength
FROM signals s JOIN run_day r USING (run_id) LEFT JOIN run_flag_counts USING (run_id) LEFT JOIN day_best b ON b.d = r.d LEFT JOIN day_social_dir o ON o.d = r.d""",
    "decided0": """
SELECT a.run_id, a.portfolio_id, a.date, coalesce(n_flags, 0) AS n_flags, notes, flag_block, raw_score,
       CASE WHEN n_flags > 0 THEN raw_score * 0.5 ELSE raw_score END AS score, a.named, a.direction, a.strength, a.confidence, a.sized, a.response_text
FROM read_texts a JOIN final_score USING (run_id) LEFT JOIN run_flag_counts USING (run_id) WHERE a.agent_name = 'PortfolioManager'""",
}
SIGNAL = ["run_id", "agent_name", "asset", "direction", "strength", "confidence"]


def dated_decisions(inp: Inputs, responses, known, volatility):
    """Recommendations of the given responses with the evidence of each run's own date."""
    return D.run_decisions(
        responses.unionByName(inp.answers(responses)), R.risk_flags(inp.positions()),
        known.selectExpr("d", f"coalesce(best_asset, '{D.DEFAULT_ASSET}') AS best_asset"),
        known.selectExpr("d", "social_direction AS direction"), market_flags=R.market_flags(volatility, WATCHED, LIMIT),
    )


def dated_recommendations(inp: Inputs, dates):
    """Recommendations of the runs of some dates (``date``), from the bars, posts and responses that these dates reach."""
    responses = dated_responses(inp).withColumn("date", day("ts")).join(dates, "date", "left_semi").drop("date")
    wanted = dates.select(F.to_date("date").alias("d"))
    reach = wanted.select(F.explode(F.sequence(F.date_sub("d", I.LOOKBACK_DAYS), F.col("d"))).alias("d")).distinct()
    bars = inp.bars_d().join(reach, "d", "left_semi").select("symbol", F.col("d").cast("timestamp_ntz").alias("ts"), "close")
    articles = inp.articles().withColumn("d", F.to_date("published_at")).join(reach, "d", "left_semi").drop("d")
    known = E.dated_evidence(wanted, E.technical_evidence(bars), E.social_evidence(articles, 1, TICKERS, bullish=BULLISH, bearish=BEARISH))
    rows = dated_decisions(inp, responses, known, E.risk_evidence(bars, WATCHED, slice_seconds=SLICE))
    return rows.select("run_id", "date", "asset", "direction", "strength", "confidence", "position_size_pct")


@query("run_decisions_by_day", q("""
SELECT run_id, n_signals, n_flags, raw_score, score, asset, direction, strength, confidence, position_size_pct, risk_notes FROM decided""", **DATED))
def run_decisions_by_day(inp):
    """Every run with the indicators, volatility flags, posts and prices of its own date."""
    return dated_decisions(inp, dated_responses(inp), evidence(inp, "technical", "social"), volatilities(inp)).select(
        "run_id", F.size("signals").cast("bigint").alias("n_signals"), "n_flags", "raw_score", "score", "asset", "direction",
        "strength", "confidence", "position_size_pct", "risk_notes",
    )


@query("market_signal", q(f"""
SELECT {', '.join(SIGNAL)}, coalesce(p.n, 0) AS n_prices, coalesce(m.n, 0) AS n_macro FROM final_signals s
LEFT JOIN (SELECT d, count(*) AS n FROM day_prices GROUP BY d) p ON p.d = s.d
LEFT JOIN (SELECT d, count(*) AS n FROM day_macro GROUP BY d) m ON m.d = s.d WHERE agent_name = 'MarketDataAgent'""", **DATED))
def market_signal(inp):
    """The market agent's rows with the prices and the macro values of their own date."""
    rows = signals(inp, "prices", "macro").filter("agent_name = 'MarketDataAgent'")
    read = rows.withColumn("_e", F.from_json("raw_data", "prices map<string,double>, macro map<string,double>"))
    return read.select(*SIGNAL, F.size("_e.prices").cast("bigint").alias("n_prices"), F.size("_e.macro").cast("bigint").alias("n_macro"))


EVIDENCE_SQL = q(f"""
SELECT s.run_id, s.agent_name, e.part, e.key, e.value, e.shown FROM final_signals s JOIN (
  SELECT 'MarketDataAgent' AS agent_name, d, 'prices' AS part, symbol AS key, {half_even('close', 4)} AS value, NULL AS shown FROM day_prices
  UNION ALL SELECT 'MarketDataAgent', d, 'macro', series_id, value, NULL FROM day_macro
  UNION ALL SELECT 'TechnicalAnalyst', d, 'indicators', symbol, rsi, ta_signals FROM day_records
  UNION ALL SELECT 'TechnicalAnalyst', d, 'indicators', symbol, NULL, 'insufficient data' FROM day_short
  UNION ALL SELECT 'SentimentAgent', d, 'headlines', CAST(place - 1 AS VARCHAR), NULL, title FROM day_headlines WHERE place <= 5
  UNION ALL SELECT 'SentimentAgent', d, 'reddit', 'bullish', bullish_count, CAST(bullish_pct AS VARCHAR) FROM day_social
  UNION ALL SELECT 'SentimentAgent', d, 'reddit', 'bearish', bearish_count, CAST(bearish_pct AS VARCHAR) FROM day_social
  UNION ALL SELECT 'SentimentAgent', d, 'reddit', 'total', total_posts, NULL FROM day_social
  UNION ALL SELECT 'SentimentAgent', d, 'tickers', ticker, mentions, NULL FROM day_tickers
  UNION ALL SELECT 'RiskManager', d, 'volatility', symbol, volatility, NULL FROM day_vol WHERE symbol IN ({', '.join(f"'{s}'" for s in WATCHED)})
) e ON e.d = s.d AND e.agent_name = s.agent_name
UNION ALL SELECT run_id, 'RiskManager', 'risk_flags', CAST(row_number() OVER (PARTITION BY run_id ORDER BY flag_order, symbol) - 1 AS VARCHAR), NULL, flag FROM run_flag_rows
""", **DATED)


@query("signal_evidence_by_day", EVIDENCE_SQL)
def signal_evidence_by_day(inp):
    """What every stored signal keeps as evidence, read back from its JSON: one row per entry."""
    from ..operators.signals import signal_records

    stored = signal_records(signals(inp)).select("run_id", "agent_name", "raw_data")
    record = "struct<error string, rsi double, ta_signals array<string>>"
    reddit = "struct<bullish_count bigint, bearish_count bigint, total_posts bigint, bullish_pct double, bearish_pct double, top_tickers array<struct<ticker string, mentions bigint>>>"
    row = "array<struct<part string, key string, value double, shown string>>"
    numbers = "transform(map_entries({0}), e -> named_struct('part', '{1}', 'key', e.key, 'value', e.value, 'shown', CAST(NULL AS string)))"
    texts = "transform({0}, (t, i) -> named_struct('part', '{1}', 'key', CAST(i AS string), 'value', CAST(NULL AS double), 'shown', t))"
    agents = {
        "MarketDataAgent": ("prices map<string,double>, macro map<string,double>", f"concat({numbers.format('e.prices', 'prices')}, {numbers.format('e.macro', 'macro')})"),
        "RiskManager": ("volatility map<string,double>, risk_flags array<string>", f"concat({numbers.format('e.volatility', 'volatility')}, {texts.format('e.risk_flags', 'risk_flags')})"),
        "SentimentAgent": (f"headlines array<string>, reddit {reddit}", f"""concat({texts.format('e.headlines', 'headlines')},
            CASE WHEN e.reddit IS NULL THEN CAST(array() AS {row}) ELSE array(
              named_struct('part', 'reddit', 'key', 'bullish', 'value', CAST(e.reddit.bullish_count AS double), 'shown', CAST(e.reddit.bullish_pct AS string)),
              named_struct('part', 'reddit', 'key', 'bearish', 'value', CAST(e.reddit.bearish_count AS double), 'shown', CAST(e.reddit.bearish_pct AS string)),
              named_struct('part', 'reddit', 'key', 'total', 'value', CAST(e.reddit.total_posts AS double), 'shown', CAST(NULL AS string))) END,
            coalesce(transform(e.reddit.top_tickers, t -> named_struct('part', 'tickers', 'key', t.ticker, 'value', CAST(t.mentions AS double), 'shown', CAST(NULL AS string))), CAST(array() AS {row})))"""),
        "TechnicalAnalyst": (f"map<string, {record}>", "transform(map_entries(e), t -> named_struct('part', 'indicators', 'key', t.key, 'value', t.value.rsi, 'shown', coalesce(t.value.error, array_join(t.value.ta_signals, '; '))))"),
    }
    read = stored
    for agent, (schema, _) in agents.items():
        read = read.withColumn(agent, F.when(F.col("agent_name") == agent, F.from_json("raw_data", schema)))
    cases = " ".join(f"WHEN '{agent}' THEN transform(array({agent}), e -> {rows})[0]" for agent, (_, rows) in agents.items())
    return read.selectExpr("run_id", "agent_name", f"inline(CAST(CASE agent_name {cases} END AS {row}))")
