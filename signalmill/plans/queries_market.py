"""Bars, indicators, volatility, risk flags and snapshots."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.numeric import half_even as he
from ..functions.numeric import rounded
from ..operators import indicators as I
from ..operators import lookups as J
from ..operators import risk as R
from ..operators import snapshots as N
from .bindings import SERIES_NAMES, SHOWN_SYMBOLS, ZONES, Inputs
from .oracle_views import VIEWS, fixed, half_even, q
from .registry import day, query, sql_day, sql_stamp, stamp

VIEWS["bars_n"] = """
SELECT symbol, ts, close, row_number() OVER w AS rn, close - lag(close) OVER w AS move,
       avg(close) OVER band AS mid, stddev_pop(close) OVER band AS dev, count(*) OVER (PARTITION BY symbol) AS n
FROM bars_h WINDOW w AS (PARTITION BY symbol ORDER BY ts), band AS (PARTITION BY symbol ORDER BY ts ROWS 19 PRECEDING)"""
VIEWS["ema"] = """
SELECT symbol, rn, 0.0::DOUBLE AS g, 0.0::DOUBLE AS l, close AS e12, close AS e26, NULL::DOUBLE AS sig FROM bars_n WHERE rn = 1
UNION ALL
SELECT symbol, rn, g, l, e12, e26, CASE WHEN rn = 26 THEN e12 - e26 WHEN rn > 26 THEN sig * 0.8::DOUBLE + (e12 - e26) * 0.2::DOUBLE END
FROM (SELECT b.symbol, b.rn, (e.g * 13 + greatest(b.move, 0)) / 14 AS g, (e.l * 13 + greatest(-b.move, 0)) / 14 AS l,
             (e.e12 * 11 + b.close * 2) / 13 AS e12, (e.e26 * 25 + b.close * 2) / 27 AS e26, e.sig
      FROM ema e JOIN bars_n b ON b.symbol = e.symbol AND b.rn = e.rn + 1)"""
VIEWS["ind"] = """
SELECT b.symbol, b.ts, b.rn, b.n, b.close,
       CASE WHEN rn >= 14 THEN CASE WHEN l = 0 THEN 100 ELSE 100 - 100 / (1 + g / l) END END AS rsi,
       CASE WHEN rn >= 26 THEN e12 - e26 END AS macd,
       CASE WHEN rn >= 34 THEN sig END AS macd_signal,
       CASE WHEN rn >= 34 THEN e12 - e26 - sig END AS macd_hist,
       CASE WHEN rn >= 20 THEN mid + 2 * dev END AS bb_high,
       CASE WHEN rn >= 20 THEN mid END AS bb_mid,
       CASE WHEN rn >= 20 THEN mid - 2 * dev END AS bb_low
FROM bars_n b JOIN ema USING (symbol, rn)"""
VIEWS["ta"] = f"""
SELECT *, CASE WHEN rsi < 30 THEN 2 WHEN rsi > 70 THEN -2 ELSE 0 END
        + CASE WHEN macd_hist > 0 AND macd > macd_signal THEN 1 WHEN macd_hist < 0 THEN -1 ELSE 0 END
        + CASE WHEN close < bb_low THEN 1 WHEN close > bb_high THEN -1 ELSE 0 END AS ta_score,
       concat_ws('; ', concat('RSI ', CASE WHEN rsi < 30 THEN 'oversold' WHEN rsi > 70 THEN 'overbought' ELSE 'neutral' END,
                              ' (', {fixed('rsi', 1)}, ')'),
           CASE WHEN macd_hist > 0 AND macd > macd_signal THEN 'MACD bullish crossover' WHEN macd_hist < 0 THEN 'MACD bearish' END,
           CASE WHEN close < bb_low THEN 'Price below lower Bollinger Band (oversold)'
                WHEN close > bb_high THEN 'Price above upper Bollinger Band (overbought)' END) AS ta_signals
FROM ind WHERE rn = n AND n >= 26"""
VIEWS["best"] = "SELECT coalesce(min_by(symbol, (-abs(ta_score), symbol)), 'XLE') AS best_asset FROM ta"
VIEWS["returns"] = """
SELECT symbol, ts, ln(close / prev) AS r, n FROM (
  SELECT symbol, ts, close, lag(close) OVER (PARTITION BY symbol ORDER BY ts) AS prev, count(*) OVER (PARTITION BY symbol) AS n FROM bars_h)
WHERE prev > 0 AND close > 0"""
VIEWS["vol0"] = "SELECT symbol, stddev_samp(r) * sqrt(252.0::DOUBLE) * 100 AS v FROM returns GROUP BY symbol HAVING max(n) >= 10"
VIEWS["vol"] = f"SELECT symbol, {half_even('v', 2)} AS volatility FROM vol0 WHERE symbol IN ('purchase', 'view', 'click')"
VIEWS["own_flags"] = f"""
SELECT portfolio_id, 2 AS flag_order, symbol, concat('OVERWEIGHT: ', symbol, ' at ', {fixed('size_pct', 1)}, '% (max 20.0%)') AS flag
FROM positions WHERE size_pct > 20
UNION ALL
SELECT portfolio_id, 3, '', concat('SECTOR OVEREXPOSURE: ', {fixed('total', 1)}, '% in energy (max 60.0%)')
FROM (SELECT portfolio_id, sum(size_pct) AS total FROM positions GROUP BY portfolio_id) WHERE total > 60"""
VIEWS["vol_flags"] = f"""
SELECT 1 AS flag_order, symbol, concat('HIGH VOLATILITY: ', symbol, ' at ', {fixed('volatility', 1)}, '%') AS flag FROM vol WHERE volatility > 30"""

DIGITS = {"rsi": 6, "macd": 6, "macd_signal": 6, "macd_hist": 6, "bb_high": 6, "bb_mid": 6, "bb_low": 6}


def _shown(columns: list[str]):
    return rounded({c: DIGITS[c] for c in columns})


def _series(inp: Inputs, columns: list[str]):
    return I.indicator_series(inp.bars_h()).select("symbol", stamp("ts").alias("ts"), *_shown(columns))


def _series_sql(columns: list[str]) -> str:
    shown = ", ".join(f"{half_even(c, DIGITS[c])} AS {c}" for c in columns)
    return q(f"SELECT symbol, {sql_stamp('ts')} AS ts, {shown} FROM ind")


@query("bars_resample", q(f"SELECT symbol, {sql_stamp('ts')} AS ts, open, high, low, close, volume FROM bars_h"))
def bars_resample(inp):
    return inp.bars_h().withColumn("ts", stamp("ts"))


@query("ind_history_gate", q("""
SELECT symbol, count(close) AS n_close, CASE WHEN count(close) < 26 THEN 'insufficient data' ELSE 'ok' END AS status
FROM bars_h GROUP BY symbol"""))
def ind_history_gate(inp):
    return I.history_gate(inp.bars_h())


@query("ind_rsi", _series_sql(["rsi"]))
def ind_rsi(inp):
    return _series(inp, ["rsi"])


@query("ind_macd", _series_sql(["macd", "macd_signal", "macd_hist"]))
def ind_macd(inp):
    return _series(inp, ["macd", "macd_signal", "macd_hist"])


@query("ind_bollinger", _series_sql(["bb_high", "bb_mid", "bb_low"]))
def ind_bollinger(inp):
    return _series(inp, ["bb_high", "bb_mid", "bb_low"])


VIEWS["long_n"] = """
SELECT symbol, d, close, row_number() OVER (PARTITION BY symbol ORDER BY d) AS rn,
       close - lag(close) OVER (PARTITION BY symbol ORDER BY d) AS move FROM bars_d"""
VIEWS["long_ema"] = """
SELECT symbol, d, rn, 0.0::DOUBLE AS g, 0.0::DOUBLE AS l, close AS e12, close AS e26 FROM long_n WHERE rn = 1
UNION ALL
SELECT b.symbol, b.d, b.rn, (e.g * 13 + greatest(b.move, 0)) / 14, (e.l * 13 + greatest(-b.move, 0)) / 14,
       (e.e12 * 11 + b.close * 2) / 13, (e.e26 * 25 + b.close * 2) / 27
FROM long_ema e JOIN long_n b ON b.symbol = e.symbol AND b.rn = e.rn + 1"""
VIEWS["long_ind"] = """
SELECT symbol, d, CASE WHEN rn >= 14 THEN CASE WHEN l = 0 THEN 100 ELSE 100 - 100 / (1 + g / l) END END AS rsi,
       CASE WHEN rn >= 26 THEN e12 - e26 END AS macd FROM long_ema"""


@query("ind_long_history", q(f"""
SELECT symbol, {sql_day('d')} AS d, {half_even('rsi', 6)} AS rsi, {half_even('macd', 4)} AS macd FROM long_ind"""))
def ind_long_history(inp):
    """The same indicators over histories that span several row blocks."""
    rows = I.indicator_series(inp.daily_bars(), slice_seconds=90 * 86_400)
    return rows.select("symbol", day("ts").alias("d"), *rounded({"rsi": 6, "macd": 4}))


@query("ta_score", q("SELECT symbol, CAST(ta_score AS INT) AS ta_score, ta_signals FROM ta"))
def ta_score(inp):
    rows = I.scored(I.indicator_latest(inp.bars_h()))
    return rows.select("symbol", "ta_score", F.array_join("ta_signals", "; ").alias("ta_signals"))


# daily bars that stand still from their 101st on, as a halted symbol's do
FLAT = """SELECT symbol, CAST(d AS TIMESTAMP) AS ts, CASE WHEN rn > 100 THEN max(CASE WHEN rn = 100 THEN close END) OVER (PARTITION BY symbol) ELSE close END AS close
FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY d) AS rn FROM bars_d)"""


@query("ind_flat_history", q(f"""
SELECT symbol, {sql_day('ts')} AS d, {half_even('rsi', 6)} AS rsi, {half_even('macd', 4)} AS macd, {half_even('macd_signal', 4)} AS macd_signal,
       {half_even('bb_high', 4)} AS bb_high, {half_even('bb_low', 4)} AS bb_low FROM ind""", bars_h=FLAT))
def ind_flat_history(inp):
    """A flat price keeps its RSI across all row blocks, and its bands are the price."""
    rows = inp.daily_bars().selectExpr("symbol", "ts", "close", "row_number() OVER (PARTITION BY symbol ORDER BY ts) AS rn")
    held = "CASE WHEN rn > 100 THEN max(CASE WHEN rn = 100 THEN close END) OVER (PARTITION BY symbol) ELSE close END AS close"
    series = I.indicator_series(rows.selectExpr("symbol", "ts", held), slice_seconds=90 * 86_400)
    return series.select("symbol", day("ts").alias("d"), *rounded({"rsi": 6, "macd": 4, "macd_signal": 4, "bb_high": 4, "bb_low": 4}))


def newest_day(inp: Inputs):
    return inp.table("orders").agg(F.max(F.to_date("o_orderdate"))).scalar()


def _back(days: int) -> str:
    return f"SELECT symbol, CAST(d AS TIMESTAMP) AS ts, close FROM bars_d WHERE d >= (SELECT max(d) FROM bars_d) - {days}"


@query("volatility_lookback", q(f"SELECT symbol, {half_even('v', 2)} AS volatility FROM vol0", bars_h=_back(60)))
def volatility_lookback(inp):
    """Volatility of the last 60 days of a history of years."""
    return I.volatility(inp.daily_bars(), as_of=newest_day(inp))


def records(inp: Inputs):
    return I.indicator_records(inp.bars_h())


RECORD_SQL = ", ".join(
    f"{half_even(c, d)} AS {c}" for c, d in
    {"close": 2, "rsi": 2, "macd": 4, "macd_signal": 4, "macd_hist": 4, "bb_high": 2, "bb_mid": 2, "bb_low": 2}.items()
)
VIEWS["ta_rec"] = f"SELECT symbol, {RECORD_SQL}, ta_score, ta_signals FROM ta"


@query("ta_record", q("SELECT * REPLACE (CAST(ta_score AS INT) AS ta_score) FROM ta_rec"))
def ta_record(inp):
    return records(inp).withColumn("ta_signals", F.array_join("ta_signals", "; "))


@query("ta_record_lookback", q("SELECT * REPLACE (CAST(ta_score AS INT) AS ta_score) FROM ta_rec", bars_h=_back(90)))
def ta_record_lookback(inp):
    """Records of the last 90 days of a history of years."""
    found = I.indicator_records(inp.daily_bars(), as_of=newest_day(inp))
    return found.withColumn("ta_signals", F.array_join("ta_signals", "; "))


@query("ta_direction", q("""
SELECT CAST(sum(ta_score) AS BIGINT) AS total_score,
       CASE WHEN sum(ta_score) > 1 THEN 'BULLISH' WHEN sum(ta_score) < -1 THEN 'BEARISH' ELSE 'NEUTRAL' END AS direction FROM ta"""))
def ta_direction(inp):
    return I.direction_by_score(records(inp))


@query("ta_best_asset", q("SELECT best_asset FROM best"))
def ta_best_asset(inp):
    return I.best_asset(records(inp))


@query("log_returns", q(f"SELECT symbol, {sql_stamp('ts')} AS ts, {half_even('r', 9)} AS log_return FROM returns"))
def log_returns(inp):
    rows = I.log_returns(inp.bars_h())
    return rows.select("symbol", stamp("ts").alias("ts"), he("log_return", 9).alias("log_return"))


def volatilities(inp: Inputs):
    return I.volatility(inp.bars_h(), SHOWN_SYMBOLS)


@query("volatility", q(f"SELECT symbol, {half_even('v', 2)} AS volatility FROM vol0"))
def volatility(inp):
    return I.volatility(inp.bars_h())


@query("flag_high_vol", q("SELECT * FROM vol_flags"))
def flag_high_vol(inp):
    return R.high_volatility(volatilities(inp))


@query("flag_overweight", q("SELECT * FROM own_flags WHERE flag_order = 2"))
def flag_overweight(inp):
    return R.overweight(inp.positions())


@query("flag_sector", q("SELECT * FROM own_flags WHERE flag_order = 3"))
def flag_sector(inp):
    return R.sector_exposure(inp.positions())


@query("risk_flags", q("""
SELECT * FROM own_flags UNION ALL
SELECT p.portfolio_id, f.* FROM (SELECT DISTINCT portfolio_id FROM positions) p, vol_flags f"""))
def risk_flags(inp):
    return R.risk_flags(inp.positions(), volatilities(inp), symbols=SHOWN_SYMBOLS)


VIEWS["weekly"] = """
SELECT series_id, date_trunc('week', d) AS p, CASE WHEN series_id = 'NO' THEN 0.0 ELSE max(value) END AS v
FROM obs GROUP BY series_id, date_trunc('week', d)"""
VIEWS["leveled"] = """
SELECT *, v - lead(v) OVER (PARTITION BY series_id ORDER BY p DESC) AS delta,
       row_number() OVER (PARTITION BY series_id ORDER BY p DESC) AS place FROM weekly"""

# --- snapshots ---------------------------------------------------------------------

def last_hour(inp: Inputs):
    return inp.table("events").agg(F.to_date(F.max("ts"))).scalar()


def last_ship(inp: Inputs):
    return inp.table("lineitem").agg(F.max(F.to_date("l_shipdate"))).scalar()


RECENT = "ts >= (SELECT CAST(max(ts) AS DATE) FROM events) - 5"
LAST_SHIP = "(SELECT max(d) FROM obs)"


@query("snap_last_common_row", q(f"""
SELECT symbol, {half_even('close', 4)} AS price FROM bars_h WHERE {RECENT} AND ts = (SELECT max(ts) FROM bars_h)"""))
def snap_last_common_row(inp):
    return N.last_common_row(inp.bars_h(), last_hour(inp))


@query("snap_latest_per_symbol", q(f"SELECT symbol, max_by(close, ts) AS price FROM bars_h WHERE {RECENT} GROUP BY symbol"))
def snap_latest_per_symbol(inp):
    return N.latest_per_symbol(inp.bars_h(), last_hour(inp))


VIEWS["names"] = "SELECT * FROM (VALUES ('AF', 'Spot price'), ('RF', 'Spread'), ('NO', 'Breakeven')) t(series_id, name)"
VIEWS["zones"] = "SELECT * FROM (VALUES ('AF', 'Power_DE'), ('NO', 'Power_FR'), ('RF', '3-MEDIUM')) t(zone, label)"


@query("snap_macro", q(f"""
SELECT series_id, max_by(value, d) AS value, {sql_day('max(d)')} AS d, name FROM obs JOIN names USING (series_id)
WHERE d >= {LAST_SHIP} - 30 GROUP BY series_id, name"""))
def snap_macro(inp):
    return N.macro_snapshot(inp.obs(), last_ship(inp), SERIES_NAMES).withColumn("d", day("d"))


@query("snap_zone_price", q(f"""
SELECT zone, label, max_by(value, d) AS value, {sql_day('max(d)')} AS d FROM (SELECT series_id AS zone, d, value FROM obs) JOIN zones USING (zone)
WHERE d >= {LAST_SHIP} - 30 GROUP BY zone, label"""))
def snap_zone_price(inp):
    rows = inp.obs().withColumnRenamed("series_id", "zone")
    return N.zone_snapshot(rows, last_ship(inp), ZONES, 30).withColumn("d", day("d"))


@query("series_trend", q(f"""
SELECT {sql_day('d')} AS date, {half_even('value', 2)} AS price FROM obs WHERE series_id = 'AF' AND d >= {LAST_SHIP} - 84"""))
def series_trend(inp):
    return N.series_trend(inp.obs(), last_ship(inp), "AF", 12)


@query("mix_share", q(f"""
SELECT zone, fuel, {half_even('share', 2)} AS share_pct FROM shares WHERE mw > 0""",
    current="SELECT * FROM gen_mix g WHERE d = (SELECT max(d) FROM gen_mix h WHERE h.zone = g.zone)",
    shares="SELECT zone, fuel, mw, mw / sum(mw) OVER (PARTITION BY zone) * 100 AS share FROM current"))
def mix_share(inp):
    return N.mix_share(inp.gen_mix())


def snapshots(inp: Inputs):
    """One snapshot per trading day: daily closes, a spot series and labelled zones, macro and news."""
    obs = inp.obs()
    equities = inp.bars_d().select("d", F.col("symbol").alias("key"), F.col("close").alias("value"), F.lit(1).alias("priority"))
    # one pass over the observations: each labelled row is a zone price, and the spot series is one more price
    roles = F.array(
        F.struct(F.col("label").alias("key"), F.lit(3).alias("priority")),
        F.when(F.col("zone") == "NO", F.struct(F.lit("WTI_EIA").alias("key"), F.lit(2).alias("priority"))),
    )
    labelled = J.with_zone_label(obs.withColumnRenamed("series_id", "zone"), ZONES)
    observed = labelled.select("d", "value", F.explode(F.array_compact(roles)).alias("r")).select("d", "r.key", "value", "r.priority")
    quotes = equities.unionByName(observed)
    return N.combined(quotes, N.daily_macro(obs, SERIES_NAMES), N.daily_news(inp.articles()))


VIEWS["quotes"] = """
SELECT d, symbol AS key, close AS value, 1 AS priority FROM bars_d
UNION ALL SELECT d, 'WTI_EIA', value, 2 FROM obs WHERE series_id = 'NO'
UNION ALL SELECT d, label, value, 3 FROM (SELECT series_id AS zone, d, value FROM obs) JOIN zones USING (zone)"""
VIEWS["carried"] = """
SELECT s.d, o.series_id AS key, max_by(o.value, o.d) AS value
FROM (SELECT DISTINCT d FROM quotes) s JOIN (SELECT o.* FROM obs o JOIN names USING (series_id)) o ON o.d <= s.d AND o.d >= s.d - 30
GROUP BY s.d, o.series_id"""
VIEWS["dated_posts"] = "SELECT CAST(make_timestamp(created_utc * 1000000) AS DATE) AS d FROM posts"
VIEWS["news_days"] = """
SELECT s.d, CAST(least(count(p.d), 10) AS INT) AS news_count FROM (SELECT DISTINCT d FROM quotes) s
LEFT JOIN dated_posts p ON p.d = s.d OR p.d = s.d - 1 GROUP BY s.d"""
VIEWS["snap_entries"] = """
SELECT d, 'price' AS kind, key, max_by(value, priority) AS value FROM quotes GROUP BY d, key
UNION ALL SELECT d, 'macro', key, value FROM carried
UNION ALL SELECT d, 'news', '', CAST(news_count AS DOUBLE) FROM news_days"""


@query("snap_combined", q(f"SELECT {sql_day('d')} AS date, kind, key, value FROM snap_entries"))
def snap_combined(inp):
    def entries(kind, column):
        return F.transform(F.map_entries(column), lambda e: F.struct(F.lit(kind).alias("kind"), e["key"].alias("key"), e["value"].alias("value")))

    news = F.array(F.struct(F.lit("news").alias("kind"), F.lit("").alias("key"), F.col("news_count").cast("double").alias("value")))
    return snapshots(inp).select("date", F.inline(F.concat(entries("price", "prices"), entries("macro", "macro"), news)))


@query("snap_source_failures", q(f"""
SELECT {sql_day('d')} AS d, source FROM (SELECT DISTINCT d FROM quotes), (VALUES ('yfinance'), ('fred'), ('eia_wti')) t(source)
WHERE (d, source) NOT IN (SELECT d, 'yfinance' FROM bars_d UNION ALL SELECT d, CASE series_id WHEN 'AF' THEN 'fred' ELSE 'eia_wti' END
  FROM obs WHERE series_id IN ('AF', 'NO'))"""))
def snap_source_failures(inp):
    bars = inp.bars_d().select("d", F.lit("yfinance").alias("source"))
    obs = inp.obs()
    series = obs.filter("series_id IN ('AF', 'NO')").selectExpr("d", "CASE series_id WHEN 'AF' THEN 'fred' ELSE 'eia_wti' END AS source")
    zones = obs.filter("series_id IN ('AF', 'NO', 'RF')").select("d")
    return N.source_failures(bars.select("d").unionByName(zones), bars.unionByName(series)).withColumn("d", day("d"))


@query("snap_source_counts", q(f"""
SELECT {sql_day('d')} AS date, CAST(count_if(kind = 'price') AS INT) AS prices_count, CAST(count_if(kind = 'macro') AS INT) AS macro_count,
       CAST(max(CASE WHEN kind = 'news' THEN value END) AS INT) AS news_count FROM snap_entries GROUP BY d"""))
def snap_source_counts(inp):
    return N.source_counts(snapshots(inp))


@query("sql_price_trend", q(f"""
SELECT {sql_day('d')} AS date, max(CASE WHEN kind = 'price' AND key = 'WTI_EIA' THEN value END) AS price
FROM snap_entries GROUP BY d ORDER BY d DESC LIMIT 30"""))
def sql_price_trend(inp):
    from ..operators.tables import price_trend_sql

    return price_trend_sql(snapshots(inp), "WTI_EIA", "combined", 30)


@query("join_series_name", q(f"""
SELECT series_id, {sql_day('d')} AS d, value, coalesce(name, series_id) AS name FROM obs LEFT JOIN names USING (series_id)"""))
def join_series_name(inp):
    return J.with_series_name(inp.obs(), SERIES_NAMES).withColumn("d", day("d"))


@query("join_zone_label", q(f"""
SELECT zone, {sql_day('d')} AS d, value, label FROM (SELECT series_id AS zone, d, value FROM obs) JOIN zones USING (zone)"""))
def join_zone_label(inp):
    return J.with_zone_label(inp.obs().withColumnRenamed("series_id", "zone"), ZONES).withColumn("d", day("d"))
