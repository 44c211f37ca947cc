"""Windows over already typed series and bars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.times import AsOf, days_before


def series_window(
    observations: DataFrame, as_of: AsOf, days: int = 90, series=None,
) -> DataFrame:
    """Observations of the look-back without NULL or NaN values."""
    rows = observations.filter(F.col("d") >= days_before(as_of, days)).dropna(subset=["value"])
    return rows if series is None else rows.filter(F.col("series_id").isin(list(series)))


def zone_prices(observations: DataFrame, as_of: AsOf, days: int = 7, zone: str = "series_id") -> DataFrame:
    """Zone observations as price rows of commodity ``POWER_<zone>``."""
    return series_window(observations, as_of, days).select(
        F.concat(F.lit("POWER_"), F.col(zone)).alias("commodity"),
        F.col("value").alias("price"),
        F.lit("EUR/MWh").alias("unit"),
        F.col("d").cast("timestamp").alias("timestamp"),
        F.lit("entsoe").alias("source"),
    )


def carried(daily: DataFrame, key: str, days: int) -> DataFrame:
    """Each row repeated on the following dates until the key's next row, for at most ``days`` days.

    ``daily`` has one row per key and date d, so what is ordered per key is bounded by the calendar.
    """
    rows = daily.selectExpr("*", f"lead(d) OVER (PARTITION BY {key} ORDER BY d) AS _next")
    last = f"least(date_add(d, {days}), date_sub(coalesce(_next, date_add(d, {days + 1})), 1))"
    others = [f"`{c}`" for c in daily.columns if c != "d"]
    return rows.selectExpr(*others, f"explode(sequence(d, {last})) AS d")


def scan_bars(bars: DataFrame, as_of: AsOf, symbols=None, days: int = 60) -> DataFrame:
    """Bars of the look-back; a symbol without rows yields nothing. Both filters reach the scan."""
    rows = bars.filter(F.col("ts") >= days_before(as_of, days))
    return rows if symbols is None else rows.filter(F.col("symbol").isin(list(symbols)))
