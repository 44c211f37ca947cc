"""Look-ups by key: fixed tables joined by broadcast, memberships, and evidence per run."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import (
    AGENT_WEIGHTS, DEFAULT_PRICE_PER_THOUSAND, DEFAULT_WEIGHT, MACRO_SERIES, PRICE_PER_MILLION,
    PRICE_PER_THOUSAND, ZONE_LABELS,
)
from ..functions.lookup import lookup_table, quoted
from ..functions.parsing import has_any_word


def with_agent_weight(signals: DataFrame, weights: Mapping[str, float] = AGENT_WEIGHTS) -> DataFrame:
    """Adds weight; an unlisted agent keeps its row with the default weight."""
    table = lookup_table(signals.sparkSession, list(weights.items()), ["agent_name", "_weight"])
    return signals.join(table, "agent_name", "left").selectExpr(
        *signals.columns, f"coalesce(_weight, {DEFAULT_WEIGHT}d) AS weight"
    )


def with_prices(
    calls: DataFrame, prices: Mapping[str, tuple[float, float]] = PRICE_PER_MILLION,
    default: tuple[float, float] = (0.0, 0.0),
) -> DataFrame:
    """Adds price_in and price_out by model."""
    rows = [(model, float(p_in), float(p_out)) for model, (p_in, p_out) in prices.items()]
    table = lookup_table(calls.sparkSession, rows, ["model", "_in", "_out"])
    return calls.join(table, "model", "left").selectExpr(
        *calls.columns, f"coalesce(_in, {default[0]}d) AS price_in", f"coalesce(_out, {default[1]}d) AS price_out"
    )


def with_prices_per_thousand(
    calls: DataFrame, prices: Mapping[str, tuple[float, float]] = PRICE_PER_THOUSAND,
) -> DataFrame:
    return with_prices(calls, prices, DEFAULT_PRICE_PER_THOUSAND)


def with_series_name(observations: DataFrame, names: Mapping[str, str] = MACRO_SERIES) -> DataFrame:
    """Adds name; an unlisted series is named by its id."""
    table = lookup_table(observations.sparkSession, list(names.items()), ["series_id", "_name"])
    return observations.join(table, "series_id", "left").selectExpr(
        *observations.columns, "coalesce(_name, series_id) AS name"
    )


def with_zone_label(observations: DataFrame, labels: Mapping[str, str] = ZONE_LABELS) -> DataFrame:
    """Keeps the labelled zones only and adds label."""
    table = lookup_table(observations.sparkSession, list(labels.items()), ["zone", "label"])
    return observations.join(table, "zone")


def ticker_mentions(posts: DataFrame, text: str, tickers) -> DataFrame:
    """One row per post and ticker found in its text (SQL); a post may hit several, none is dropped."""
    lowered = posts.selectExpr("*", f"lower({text}) AS _text")
    found = f"explode(filter(array({quoted(sorted(tickers))}), t -> contains(_text, lower(t)))) AS ticker"
    return lowered.selectExpr(*posts.columns, found)


def posts_with_words(posts: DataFrame, text: str, words) -> DataFrame:
    """Posts whose words meet the list at least once."""
    return posts.filter(has_any_word(text, words))


def unseen(articles: DataFrame, stored: DataFrame, key: str = "url") -> DataFrame:
    """Articles whose url is not stored yet."""
    return articles.join(stored.select(key), key, "left_anti")


def run_evidence(signals: DataFrame, flags: DataFrame, key: str = "portfolio_id") -> DataFrame:
    """One row per run: direction by agent and the number of risk flags; an absent part is empty.

    All agents of a run come together in one aggregation instead of a join per agent.
    """
    columns = {
        "market_direction": "MarketDataAgent", "technical_direction": "TechnicalAnalyst",
        "sentiment_direction": "SentimentAgent", "risk_direction": "RiskManager",
    }
    runs = signals.groupBy("run_id", key).agg(F.expr("count(*) AS n_signals"), *[
        F.expr(f"max(CASE WHEN agent_name = '{agent}' THEN direction END) AS {name}") for name, agent in columns.items()
    ])
    counted = flags.groupBy(key).agg(F.expr("count(*) AS _flags"))
    return runs.join(counted, key, "left").selectExpr(
        "run_id", key, "n_signals", *[f"coalesce({c}, '') AS {c}" for c in columns], "coalesce(_flags, 0) AS n_flags"
    )
