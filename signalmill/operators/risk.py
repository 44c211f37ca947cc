"""Risk flags per portfolio and the signal they force."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import MAX_POSITION_PCT, MAX_SECTOR_PCT, MAX_VOLATILITY_PCT, VOLATILITY_SYMBOLS
from ..functions.numeric import fixed_sql


def high_volatility(volatilities: DataFrame, limit: float = MAX_VOLATILITY_PCT) -> DataFrame:
    """Flags (flag_order, symbol, flag), with the date d if the volatilities are dated."""
    text = f"concat('HIGH VOLATILITY: ', symbol, ' at ', {fixed_sql('volatility', 1)}, '%')"
    dated = ["d"] if "d" in volatilities.columns else []
    return volatilities.filter(f"volatility > {limit} AND NOT isnan(volatility)").selectExpr(*dated, "1 AS flag_order", "symbol", f"{text} AS flag")


def overweight(positions: DataFrame, key: str = "portfolio_id", limit: float = MAX_POSITION_PCT) -> DataFrame:
    text = f"concat('OVERWEIGHT: ', symbol, ' at ', {fixed_sql('size_pct', 1)}, '% (max {limit}%)')"
    return positions.filter(f"size_pct > {limit}").selectExpr(key, "2 AS flag_order", "symbol", f"{text} AS flag")


def sector_exposure(positions: DataFrame, key: str = "portfolio_id", limit: float = MAX_SECTOR_PCT) -> DataFrame:
    total = positions.groupBy(key).agg(F.sum("size_pct").alias("total"))
    text = f"concat('SECTOR OVEREXPOSURE: ', {fixed_sql('total', 1)}, '% in energy (max {limit}%)')"
    return total.filter(f"total > {limit}").selectExpr(key, "3 AS flag_order", "'' AS symbol", f"{text} AS flag")


def market_flags(volatilities: DataFrame, symbols: Sequence[str] = VOLATILITY_SYMBOLS, limit: float = MAX_VOLATILITY_PCT) -> DataFrame:
    """The volatility flags of the listed symbols: (flag_order, symbol, flag), per date d if the volatilities are dated."""
    return high_volatility(volatilities.filter(F.col("symbol").isin(list(symbols))), limit)


def risk_flags(
    positions: DataFrame, volatilities: DataFrame | None = None, key: str = "portfolio_id",
    symbols: Sequence[str] = VOLATILITY_SYMBOLS, portfolios: DataFrame | None = None,
) -> DataFrame:
    """One row per flag, in the order (flag_order, symbol) within a portfolio.

    Volatility flags hold for every portfolio, with or without positions: ``portfolios`` (column ``key``, repeats
    allowed) lists them, else those with positions are meant. They exist for the listed symbols only, so the list bounds
    the one small array that is attached. Flags stay rows: nothing gathers a portfolio into one task.
    """
    own = overweight(positions, key).unionByName(sector_exposure(positions, key))
    if volatilities is None:
        return own
    listed = F.expr("sort_array(collect_list(struct(flag_order, symbol, flag)))")
    market = market_flags(volatilities, symbols).agg(listed).scalar()
    known = positions if portfolios is None else portfolios
    everyone = known.select(key).distinct().select(key, F.inline(market))
    return everyone.unionByName(own)


def flag_lists(flags: DataFrame, key: str = "portfolio_id") -> DataFrame:
    """Flag count and ordered flag texts per portfolio (and date d, if flags are dated), as a recommendation stores them."""
    ordered = "transform(sort_array(collect_list(struct(flag_order, symbol, flag))), f -> f.flag)"
    keys = [key, "d"] if "d" in flags.columns else [key]
    return flags.groupBy(*keys).agg(F.expr("count(*) AS n_flags"), F.expr(f"{ordered} AS flags"))


def flag_counts(flags: DataFrame, key: str = "portfolio_id") -> DataFrame:
    return flags.groupBy(key).agg(F.expr("count(*) AS n_flags"))


# the direction and strength that n_flags force on a risk signal
OVERRIDDEN_DIRECTION = "CASE WHEN n_flags >= 1 THEN 'BEARISH' ELSE {parsed} END"
OVERRIDDEN_STRENGTH = "CASE WHEN n_flags >= 2 THEN 'STRONG' WHEN n_flags = 1 THEN 'MODERATE' ELSE {parsed} END"
