"""Evidence as text: one line per row (key, line), and one block per run."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import fixed_sql, half_even_sql

# --- fixed values: what is shown when there is no line ----------------------------------
NO_HEADLINES = "  (no headlines available)"
NO_POSITIONS = "  (no open positions — paper trading)"
NO_FLAGS = "  ✓ No active risk flags"
NO_INVENTORY = "  Inventory data unavailable"


def or_placeholder(lines: DataFrame, text: str) -> DataFrame:
    """The lines, or the placeholder as the only line when there are none."""
    empty = lines.groupBy().agg(F.count("*").alias("n")).filter("n = 0")
    return lines.unionByName(empty.select(F.lit("").alias("key"), F.lit(text).alias("line")))


def price_lines(prices: DataFrame) -> DataFrame:
    """``  SYMBOL: $12.34`` per (key, value) row."""
    return prices.selectExpr("key", f"concat('  ', key, ': $', {fixed_sql('value', 2)}) AS line")


def macro_lines(macro: DataFrame, limit: int = 6) -> DataFrame:
    """``  SERIES: 12.34`` for the first series in the given order (column ``place``)."""
    first = macro.orderBy("place").limit(limit)
    return first.selectExpr("key", f"concat('  ', key, ': ', {fixed_sql('value', 2)}) AS line")


def inventory_lines(inventory: DataFrame) -> DataFrame:
    """Level and change per series row (inventory_mmbbl, change_mmbbl)."""
    return inventory.selectExpr(
        "series_id AS key",
        "concat('  Inventory: ', inventory_mmbbl, ' Mmbbl (change: ', coalesce(CAST(change_mmbbl AS string), 'None'),"
        " ' Mmbbl)') AS line",
    )


def indicator_lines(records: DataFrame) -> DataFrame:
    """One line per symbol record; an undefined histogram shows as nan."""
    hist = f"coalesce({fixed_sql('macd_hist', 4)}, 'nan')"
    return records.selectExpr(
        "symbol AS key",
        f"concat(symbol, ': close=$', close, ', RSI=', rsi, ', MACD_hist=', {hist},"
        " ', BB=[', bb_low, '-', bb_high, '] | Signals: ', array_join(ta_signals, ', ')) AS line",
    )


def volatility_lines(volatilities: DataFrame) -> DataFrame:
    return volatilities.selectExpr(
        "symbol AS key", f"concat('  ', symbol, ': ', {fixed_sql('volatility', 1)}, '% annualized') AS line"
    )


def position_lines(positions: DataFrame) -> DataFrame:
    """``  SYMBOL: 12.3%`` per position; other columns, such as the portfolio, stay."""
    return positions.selectExpr("*", "symbol AS key", f"concat('  ', symbol, ': ', {fixed_sql('size_pct', 1)}, '%') AS line")


def headline_lines(headlines: DataFrame) -> DataFrame:
    return headlines.selectExpr("url AS key", "concat('  - ', title) AS line")


def ticker_text(top_tickers: DataFrame) -> DataFrame:
    """One row: ``XLE(3), COP(1)`` of the few top tickers, or ``none``."""
    ranked = "sort_array(collect_list(struct(-mentions AS m, ticker)))"
    shown = f"array_join(transform({ranked}, t -> concat(t.ticker, '(', -t.m, ')')), ', ')"
    return top_tickers.selectExpr(f"coalesce(nullif({shown}, ''), 'none') AS tickers")


def run_digest(decisions: DataFrame) -> DataFrame:
    """Signals, flags, score and size of a run as the fixed text block; needs run_decisions rows."""
    percent = f"CAST(CAST({half_even_sql('(s.confidence * 100)', 0)} AS bigint) AS string)"
    line = (
        "concat('  ', s.agent_name, ': ', s.direction, ' (', s.strength, ') confidence=',"
        f" {percent}, '% asset=', s.asset)"
    )
    block = (
        f"concat_ws('\\n', 'AGENT SIGNALS:', array_join(transform(signals, s -> {line}), '\\n'), 'RISK FLAGS:',"
        " CASE WHEN n_flags > 0 THEN array_join(transform(flags, f -> concat('  ⚠ ', f)), '\\n') ELSE '  ✓ None' END,"
        f" concat('AGGREGATED SIGNAL SCORE: ', CASE WHEN score >= 0 THEN '+' ELSE '' END, {fixed_sql('score', 2)}),"
        f" concat('SUGGESTED POSITION SIZE: ', {fixed_sql('suggested_size_pct', 1)}, '% of portfolio'))"
    )
    return decisions.selectExpr("run_id", f"{block} AS digest")
