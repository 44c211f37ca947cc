"""What the agents of a run knew on the run's own date, and the signals they give with it.

Every kind of evidence is computed once per date (never per run) and has at most one row a date; runs meet it by their date.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import DEFAULT_ASSET, MACRO_SERIES, MAX_VOLATILITY_PCT, MENTION_TICKERS, VOLATILITY_SYMBOLS
from ..functions.numeric import half_even, rounded
from .asof import as_of_join
from .indicators import LOOKBACK_DAYS, MIN_BARS, RECORD_DIGITS, USABLE, VOLATILITY_DAYS, best_asset_by_day, indicators_by_day, scored, volatility_by_day
from .lookups import ticker_mentions
from .risk import OVERRIDDEN_DIRECTION, OVERRIDDEN_STRENGTH, flag_lists, market_flags
from .sentiment import COUNTS, POST_TEXT, directed, headlines_by_day, summary_by_day, with_margin
from .signals import parsed
from .snapshots import MACRO_DAYS, daily_macro

PRICE_DAYS = 5
TICKERS_SHOWN, HEADLINES_KEPT = 5, 5


def run_dates(responses: DataFrame) -> DataFrame:
    """The distinct dates (d) of runs: the calendar that evidence is wanted for."""
    return responses.select(F.to_date("ts").alias("d")).filter("d IS NOT NULL").distinct()


def _entries(key: str, value: str):
    return F.map_from_entries(F.sort_array(F.collect_list(F.struct(key, value))))


def price_evidence(dates: DataFrame, closes: DataFrame, symbols: Sequence[str] | None = None, days: int = PRICE_DAYS) -> DataFrame:
    """d, price_date, prices: all closes of the newest date in the look-back on which any symbol has a row.

    ``closes`` holds symbol, d, close. A symbol without a close on that date is left out, not filled back.
    """
    if symbols is not None:
        closes = closes.filter(F.col("symbol").isin(list(symbols)))
    usable = closes.select("d", F.when(F.expr(USABLE), F.struct("symbol", half_even("close", 4).alias("close"))).alias("_e"))
    listed = F.map_from_entries(F.sort_array(F.collect_list("_e")))
    daily = usable.groupBy(F.col("d").alias("price_date")).agg(listed.alias("prices"))
    return as_of_join(dates.select("d"), daily, "d", "price_date", within_days=days)


def macro_evidence(observations: DataFrame, names: Mapping[str, str] = MACRO_SERIES, days: int = MACRO_DAYS) -> DataFrame:
    """d, macro: the newest value of each tracked series in the look-back of every date."""
    return daily_macro(observations, names, days).groupBy("d").agg(_entries("key", "value").alias("macro"))


def inventory_evidence(dates: DataFrame, levels: DataFrame, series: str) -> DataFrame:
    """d, inventory: newest weekly level of ``series`` up to each date and its change; ``levels`` holds series_id, d, level."""
    own = levels.filter(F.col("series_id") == series).selectExpr(
        "d AS level_date", "level", "level - lag(level) OVER (PARTITION BY series_id ORDER BY d) AS change"
    )
    found = as_of_join(dates.select("d"), own, "d", "level_date").filter("level_date IS NOT NULL")
    return found.select("d", F.struct(F.col("level").alias("inventory_mmbbl"), half_even("change", 2).alias("change_mmbbl")).alias("inventory"))


def technical_evidence(bars: DataFrame, symbols: Sequence[str] | None = None, days: int = LOOKBACK_DAYS, slice_seconds: int = 90 * 86_400) -> DataFrame:
    """d, indicators (symbol to its record, or to why there is none) and best_asset of every date's own look-back."""
    if symbols is not None:
        bars = bars.filter(F.col("symbol").isin(list(symbols)))
    by_day = indicators_by_day(bars, days, slice_seconds=slice_seconds)
    good = scored(by_day).select("symbol", "d", *rounded(RECORD_DIGITS), "ta_score", "ta_signals")
    fields = [*RECORD_DIGITS, "ta_score", "ta_signals"]
    short = by_day.filter(f"n < {MIN_BARS}").select("symbol", "d", F.lit("insufficient data").alias("error"))
    every = good.unionByName(short, allowMissingColumns=True)
    documents = every.select("d", "symbol", F.struct("error", *fields).alias("_document"))
    documents = documents.groupBy("d").agg(_entries("symbol", "_document").alias("indicators"))
    return documents.join(best_asset_by_day(good, symbols), "d", "left")


def social_evidence(posts: DataFrame, days: int = 1, tickers: Sequence[str] = MENTION_TICKERS, published: str = "published_at", **words) -> DataFrame:
    """d, reddit (counts, shares, top tickers) and social_direction of the posts that every date sees."""
    counted = with_margin(summary_by_day(posts, days, published=published, **words)).withColumnRenamed("direction", "social_direction")
    dated = posts.withColumn("d", F.to_date(published)).filter("d IS NOT NULL")
    found = ticker_mentions(dated, POST_TEXT, tickers).groupBy("d", "ticker").agg(F.count("*").alias("n"))
    found = found.withColumn("d", F.expr(f"explode(sequence(d, date_add(d, {days})))")).groupBy("d", "ticker").agg(F.sum("n").alias("n"))
    ranked = "transform(slice(sort_array(collect_list(struct(-n AS m, ticker))), 1, {0}), t -> struct(t.ticker AS ticker, -t.m AS mentions))"
    top = found.groupBy("d").agg(F.expr(ranked.format(TICKERS_SHOWN) + " AS top_tickers"))
    reddit = F.struct(*COUNTS[:3], "bullish_pct", "bearish_pct", F.coalesce("top_tickers", F.expr("array()")).alias("top_tickers"), "total_posts")
    return counted.join(top, "d", "left").select("d", reddit.alias("reddit"), "social_direction")


def risk_evidence(bars: DataFrame, symbols: Sequence[str] = VOLATILITY_SYMBOLS, days: int = VOLATILITY_DAYS, slice_seconds: int = 90 * 86_400) -> DataFrame:
    """symbol, d, volatility of the listed symbols over every date's own look-back."""
    return volatility_by_day(bars, symbols, days=days, slice_seconds=slice_seconds)


def dated_evidence(dates: DataFrame, *parts: DataFrame) -> DataFrame:
    """One row per date d with the columns of all parts, each of which has at most one row a date."""
    out = dates.select("d").distinct()
    for part in parts:
        out = out.join(part, "d", "left")
    return out


def run_flags(runs: DataFrame, own: DataFrame, market: DataFrame, key: str = "portfolio_id") -> DataFrame:
    """run_id, n_flags, flags: the market's flags of the run's date d, then those of its portfolio."""
    listed = F.expr("transform(sort_array(collect_list(struct(flag_order, symbol, flag))), f -> f.flag) AS _market")
    rows = runs.select("run_id", key, "d").join(market.groupBy("d").agg(listed), "d", "left").join(flag_lists(own, key).select(key, "flags"), key, "left")
    every = rows.select("run_id", F.expr("concat(coalesce(_market, array()), coalesce(flags, array())) AS flags"))
    return every.select("run_id", F.size("flags").cast("long").alias("n_flags"), "flags")


#: What an agent finds where a kind of evidence was not gathered at all.
NOT_GATHERED = {
    "prices": "map<string,double>", "macro": "map<string,double>", "indicators": "map<string,string>", "best_asset": "string",
    "headlines": "array<string>", "reddit": "struct<total_posts: bigint>", "social_direction": "string",
}


def dated_signals(
    responses: DataFrame, evidence: DataFrame, own_flags: DataFrame, volatilities: DataFrame,
    symbols: Sequence[str] = VOLATILITY_SYMBOLS, limit: float = MAX_VOLATILITY_PCT, key: str = "portfolio_id",
) -> DataFrame:
    """The signals of the four agents with the evidence of each run's own date, as text in ``raw_data``.

    ``evidence`` is ``dated_evidence`` (prices, macro, indicators, best_asset, headlines, reddit, social_direction), one row a
    date, any of them may be left out; ``volatilities`` are dated, too. What is absent on a date is empty in raw_data. Values are those that the agent of the
    run would have gathered on that date: the technical asset is the date's best one, a NEUTRAL sentiment falls back to the
    date's posts, and the flags of the date and the portfolio override the risk agent's direction and strength.

    Text that depends on the date alone is written once per date, and rows meet it as their last step: none carries evidence
    through a shuffle.
    """
    absent = {c: F.lit(None).cast(kind) for c, kind in NOT_GATHERED.items() if c not in evidence.columns}
    evidence = evidence.withColumns(absent) if absent else evidence
    rows = parsed(responses).withColumn("d", F.to_date("ts"))
    runs = rows.groupBy("run_id").agg(F.max(key).alias(key), F.max("d").alias("d"))
    flags = run_flags(runs, own_flags, market_flags(volatilities, symbols, limit), key)
    known = volatilities.filter(F.col("symbol").isin(list(symbols))).groupBy("d").agg(_entries("symbol", "volatility").alias("volatility"))
    no_text, no_numbers = F.expr("CAST(array() AS array<string>)"), F.expr("CAST(map() AS map<string,double>)")
    found = F.struct(F.coalesce("volatility", no_numbers).alias("volatility"), F.coalesce("flags", no_text).alias("risk_flags"))
    risky = rows.filter("agent_name = 'RiskManager'").join(flags, "run_id", "left").join(known, "d", "left").withColumn("_risk", F.to_json(found))
    others = rows.filter("agent_name <> 'RiskManager'").withColumns({"n_flags": F.lit(None).cast("long"), "_risk": F.lit(None).cast("string")})
    rows = others.unionByName(risky.drop("flags", "volatility"))
    texts = {
        "MarketDataAgent": lambda kind: F.to_json(F.struct(*[F.coalesce(kind(c), no_numbers).alias(c) for c in ("prices", "macro")])),
        "TechnicalAnalyst": lambda kind: F.coalesce(F.to_json(kind("indicators")), F.lit("{}")),
        "SentimentAgent": lambda kind: F.to_json(F.struct(
            F.coalesce(F.slice(kind("headlines"), 1, HEADLINES_KEPT), no_text).alias("headlines"), kind("reddit").alias("reddit"))),
    }
    of_date = evidence.select("d", "best_asset", "social_direction", *[text(F.col).alias(agent) for agent, text in texts.items()])
    rows = rows.join(of_date.hint("rebalance", "d"), "d", "left")  # its size is known before the join
    raw = F.when(F.col("agent_name") == "RiskManager", F.col("_risk"))
    for agent, text in texts.items():
        nothing = text(lambda kind: F.lit(None).cast(evidence.schema[kind].dataType))
        raw = raw.when(F.col("agent_name") == agent, F.coalesce(agent, nothing))
    asset = f"""CASE agent_name WHEN 'TechnicalAnalyst' THEN coalesce(best_asset, '{DEFAULT_ASSET}')
        WHEN 'MarketDataAgent' THEN asset ELSE '{DEFAULT_ASSET}' END"""
    neutral = directed(F.col("direction"), F.coalesce("social_direction", F.col("direction")))
    risk = F.expr(OVERRIDDEN_DIRECTION.format(parsed="direction"))
    direction = F.when(F.col("agent_name") == "SentimentAgent", neutral).when(F.col("agent_name") == "RiskManager", risk).otherwise(F.col("direction"))
    strength = F.when(F.col("agent_name") == "RiskManager", F.expr(OVERRIDDEN_STRENGTH.format(parsed="strength"))).otherwise(F.col("strength"))
    return rows.select(
        *responses.columns, direction.alias("direction"), strength.alias("strength"), "confidence", F.expr(asset).alias("asset"), raw.alias("raw_data")
    )

