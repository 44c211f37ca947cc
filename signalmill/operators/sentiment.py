"""News and social sentiment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import BEARISH_WORDS, BULLISH_WORDS, MENTION_TICKERS, NEWS_QUERIES
from ..functions.lookup import quoted
from ..functions.numeric import half_even
from ..functions.parsing import has_any_word
from .lookups import ticker_mentions

MARGIN = 15
POST_TEXT = "concat(title, ' ', coalesce(description, ''))"


def dedupe_headlines(articles: DataFrame, queries=NEWS_QUERIES, per_query: int = 10, by: tuple[str, ...] = ()) -> DataFrame:
    """Newest articles of the listed queries; of equal urls the copy of the earlier query stays, within each ``by`` group.

    Expects query, url, published_at and any further columns. The limit per query acts before the
    shuffle, so what is deduplicated has at most len(queries) * per_query rows a group.
    """
    group = "".join(f"{c}, " for c in by)
    top = articles.filter(F.col("query").isin(list(queries))).selectExpr(
        "*", f"row_number() OVER (PARTITION BY {group}query ORDER BY published_at DESC, url) AS rank"
    ).filter(f"rank <= {per_query}")
    ordered = top.selectExpr("*", f"CAST(array_position(array({quoted(queries)}), query) AS int) AS query_order")
    copies = ordered.selectExpr("*", f"row_number() OVER (PARTITION BY {group}url ORDER BY query_order, rank) AS _copy")
    return copies.filter("_copy = 1").drop("_copy")


def headlines_by_day(articles: DataFrame, queries=NEWS_QUERIES, days: int = 2, per_query: int = 10, limit: int = 15) -> DataFrame:
    """The headlines (at most ``limit``, in query order, newest first) that every date d sees of its last ``days`` days: d, headlines."""
    reach = f"explode(sequence(to_date(published_at), date_add(to_date(published_at), {days}))) AS d"
    kept = dedupe_headlines(articles.selectExpr("query", "url", "title", "published_at", reach), queries, per_query, ("d",))
    listed = "transform(sort_array(collect_list(struct(query_order, rank, title))), x -> x.title)"
    return kept.groupBy("d").agg(F.expr(f"slice({listed}, 1, {limit}) AS headlines"))


def recent_headlines(articles: DataFrame, limit: int = 15) -> DataFrame:
    """Titles in query order, newest first inside a query."""
    return articles.orderBy("query_order", "rank").limit(limit)


def with_polarity(posts: DataFrame, bullish=BULLISH_WORDS, bearish=BEARISH_WORDS) -> DataFrame:
    """Adds polarity; a post with words of both lists is bullish."""
    polarity = F.when(has_any_word(POST_TEXT, bullish), "bullish").when(has_any_word(POST_TEXT, bearish), "bearish")
    return posts.withColumn("polarity", polarity.otherwise("neutral"))


def top_tickers(posts: DataFrame, tickers=MENTION_TICKERS, limit: int = 5) -> DataFrame:
    """Posts mentioning each ticker, most mentioned first, ties by ticker."""
    counts = ticker_mentions(posts, POST_TEXT, tickers).groupBy("ticker").agg(F.expr("count(*) AS mentions"))
    return counts.orderBy(F.desc("mentions"), "ticker").limit(limit)


def summary(posts: DataFrame, bullish=BULLISH_WORDS, bearish=BEARISH_WORDS, by=()) -> DataFrame:
    """One row of counts and shares, or one per ``by`` columns such as the date d."""
    return _with_shares(_polarity_counts(posts, bullish, bearish, by))


def summary_by_day(posts: DataFrame, days: int = 1, bullish=BULLISH_WORDS, bearish=BEARISH_WORDS, published: str = "published_at") -> DataFrame:
    """The summary that every date d sees: its own posts and those of the ``days`` dates before it.

    Posts become counts per date first, which add up; a date's counts reach ``days`` + 1 dates. A date without posts in
    reach has no row, which means no shares and a NEUTRAL margin.
    """
    daily = _polarity_counts(posts.withColumn("d", F.to_date(published)), bullish, bearish, ("d",))
    spread = daily.filter("d IS NOT NULL").withColumn("d", F.expr(f"explode(sequence(d, date_add(d, {days})))"))
    return _with_shares(spread.groupBy("d").agg(*[F.sum(c).alias(c) for c in COUNTS]))


COUNTS = ("bullish_count", "bearish_count", "neutral_count", "total_posts")


def _polarity_counts(posts: DataFrame, bullish, bearish, by) -> DataFrame:
    return with_polarity(posts, bullish, bearish).groupBy(*by).agg(
        *[F.expr(f"count_if(polarity = '{p}') AS {p}_count") for p in ("bullish", "bearish", "neutral")],
        F.expr("count(*) AS total_posts"),
    )


def _with_shares(counts: DataFrame) -> DataFrame:
    shares = [f"{p}_count / greatest(total_posts, 1) * 100 AS {p}_pct" for p in ("bullish", "bearish")]
    return counts.selectExpr("*", *shares).withColumns(
        {c: half_even(c, 1) for c in ("bullish_pct", "bearish_pct")}
    )


def margin_direction(bullish: str = "bullish_pct", bearish: str = "bearish_pct", margin: float = MARGIN) -> Column:
    """A side wins when it leads by more than the margin; missing shares count as 50."""
    bull, bear = f"coalesce({bullish}, 50d)", f"coalesce({bearish}, 50d)"
    return F.expr(
        f"CASE WHEN {bull} > {bear} + {margin} THEN 'BULLISH' WHEN {bear} > {bull} + {margin} THEN 'BEARISH' ELSE 'NEUTRAL' END"
    )


def with_margin(summary_row: DataFrame) -> DataFrame:
    return summary_row.withColumn("direction", margin_direction())


def pie(summary_row: DataFrame) -> DataFrame:
    """Shares for display; the neutral share is what the rounded others leave."""
    rest = summary_row.selectExpr("bullish_pct", "bearish_pct", "100 - bullish_pct - bearish_pct AS neutral_pct")
    return rest.withColumn("neutral_pct", half_even("neutral_pct", 6))


def directed(parsed: Column, fallback: Column) -> Column:
    """The parsed direction, or the fallback when it is NEUTRAL."""
    return F.when(parsed == "NEUTRAL", fallback).otherwise(parsed)
