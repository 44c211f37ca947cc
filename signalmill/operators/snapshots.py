"""Latest values per source and their merge into one snapshot per date."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..constants import MACRO_SERIES, ZONE_LABELS
from ..functions.numeric import half_even
from ..functions.times import AsOf
from ..sources.series import carried, scan_bars, series_window
from .lookups import with_series_name, with_zone_label

PRIORITY = {"equities": 1, "spot": 2, "zones": 3}
TRACKED_SOURCES = ("yfinance", "fred", "eia_wti")
NEWS_LIMIT = 10
MACRO_DAYS = 30


def last_common_row(bars: DataFrame, as_of: AsOf, symbols=None, days: int = 5) -> DataFrame:
    """Closes on the newest time of all symbols together; a symbol without a close then is omitted."""
    recent = scan_bars(bars, as_of, symbols, days)
    newest = recent.agg(F.max("ts")).scalar()
    return recent.filter((F.col("ts") == newest) & F.col("close").isNotNull() & ~F.isnan("close")).select(
        "symbol", half_even("close", 4).alias("price")
    )


def latest_per_symbol(bars: DataFrame, as_of: AsOf, symbols=None, days: int = 5) -> DataFrame:
    """Each symbol's own last close in the look-back."""
    return scan_bars(bars, as_of, symbols, days).groupBy("symbol").agg(F.max_by("close", "ts").alias("price"))


def _last(rows: DataFrame, key: str) -> DataFrame:
    return rows.groupBy(key).agg(F.max_by("value", "d").alias("value"), F.max("d").alias("d"))


def macro_snapshot(observations: DataFrame, as_of: AsOf, names=MACRO_SERIES, days: int = MACRO_DAYS) -> DataFrame:
    """Latest value of every tracked series with its name; a series without a value is absent."""
    recent = series_window(observations, as_of, days, list(names))
    return with_series_name(_last(recent, "series_id"), names)


def zone_snapshot(prices: DataFrame, as_of: AsOf, labels=ZONE_LABELS, days: int = 1) -> DataFrame:
    """Latest price of the labelled zones."""
    return with_zone_label(_last(series_window(prices, as_of, days), "zone"), labels)


def series_trend(observations: DataFrame, as_of: AsOf, series: str, weeks: int = 12) -> DataFrame:
    return series_window(observations, as_of, weeks * 7, [series]).select(
        F.date_format("d", "yyyy-MM-dd").alias("date"), half_even("value", 2).alias("price")
    )


def mix_share(generation: DataFrame) -> DataFrame:
    """Percent share per fuel in each zone's latest row.

    The newest value per (zone, fuel) is a partial aggregate; only one row per fuel meets in a zone.
    """
    latest = generation.groupBy("zone", "fuel").agg(F.max_by("mw", "d").alias("mw"), F.max("d").alias("d"))
    zone = W.partitionBy("zone")
    current = latest.withColumn("_newest", F.max("d").over(zone)).filter(F.col("d") == F.col("_newest"))
    total = current.withColumn("_total", F.sum("mw").over(zone)).filter("_total <> 0 AND mw > 0")
    share = total.withColumn("share_pct", F.expr("mw / _total * 100"))
    return share.select("zone", "fuel", half_even("share_pct", 2).alias("share_pct"))


def daily_macro(observations: DataFrame, names=MACRO_SERIES, days: int = MACRO_DAYS) -> DataFrame:
    """The value each series shows on every date: its newest one, carried for at most ``days`` days.

    A daily series has at most one row per calendar day, and a row is repeated at most days + 1 times.
    """
    rows = observations.filter(F.col("series_id").isin(list(names))).dropna(subset=["value"])
    return carried(rows, "series_id", days).selectExpr("d", "series_id AS key", "value")


def daily_news(articles: DataFrame, limit: int = NEWS_LIMIT) -> DataFrame:
    """Articles of the last day per date (the date itself and the one before), at most ``limit`` counted."""
    per_day = articles.groupBy(F.to_date("published_at").alias("d")).agg(F.count("*").alias("n"))
    spread = per_day.select(F.explode(F.array(F.col("d"), F.date_add("d", 1))).alias("d"), "n")
    return spread.groupBy("d").agg(F.least(F.sum("n"), F.lit(limit)).cast("int").alias("news_count"))


def combined(quotes: DataFrame, macro: DataFrame, news: DataFrame, source: str = "combined") -> DataFrame:
    """One snapshot per date that has a quote.

    quotes(d, key, value, priority): of equal keys on a date the higher priority wins. macro(d, key, value)
    and news(d, news_count) add to those dates. All parts are stacked and meet in two aggregations.
    """
    price = quotes.select("d", F.lit("p").alias("kind"), "key", "value", "priority")
    extra = macro.select("d", F.lit("m").alias("kind"), "key", "value", F.lit(0).alias("priority"))
    count = news.select("d", F.lit("n").alias("kind"), F.lit("").alias("key"),
                        F.col("news_count").cast("double").alias("value"), F.lit(0).alias("priority"))
    rows = price.unionByName(extra).unionByName(count)
    kept = rows.groupBy("d", "kind", "key").agg(F.max_by("value", "priority").alias("value"))

    def entries(kind: str) -> Column:
        pairs = F.collect_list(F.when(F.col("kind") == kind, F.struct("key", "value")))
        return F.map_from_entries(F.sort_array(pairs))

    news_count = F.coalesce(F.max(F.when(F.col("kind") == "n", F.col("value"))), F.lit(0)).cast("int")
    per_date = kept.groupBy("d").agg(entries("p").alias("prices"), entries("m").alias("macro"), news_count.alias("news_count"))
    return per_date.filter(F.size("prices") > 0).select(
        F.date_format("d", "yyyy-MM-dd").alias("date"), F.lit(source).alias("source"),
        F.col("d").cast("timestamp").alias("timestamp"), "prices", "macro", "news_count",
        F.lit(None).cast("double").alias("sentiment_score"),
        F.concat(F.lit("raw/"), F.date_format("d", "yyyy-MM-dd"), F.lit(f"/{source}.json")).alias("s3_raw_key"),
    )


def source_failures(dates: DataFrame, landed: DataFrame, sources=TRACKED_SOURCES) -> DataFrame:
    """(d, source) of every tracked source that landed nothing on a run date; feeds the failure metric.

    dates(d) holds the run dates, landed(d, source) what arrived.
    """
    listed = F.array(*[F.lit(s) for s in sources])
    expected = dates.select("d").distinct().select("d", F.explode(listed).alias("source"))
    return expected.join(landed.select("d", "source").distinct(), ["d", "source"], "left_anti")


def source_counts(snapshots: DataFrame) -> DataFrame:
    return snapshots.select(
        "date", F.size("prices").alias("prices_count"), F.size("macro").alias("macro_count"), "news_count"
    )


def snapshot_events(snapshots: DataFrame) -> DataFrame:
    """The message that announces a snapshot."""
    return snapshots.select(
        F.lit("new_snapshot").alias("event_type"), "date", F.col("s3_raw_key").alias("s3_key")
    )
