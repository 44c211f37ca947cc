"""Landed payload documents to typed rows; a bad row is skipped, never the whole document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import schemas
from ..constants import SOCIAL_KEYWORDS
from ..functions.numeric import half_even, to_float_sql
from ..functions.times import AsOf, days_before

DAY_PATTERN = r"^\d{4}-\d{2}-\d{2}"
MONTH_PATTERN = r"^\d{4}-\d{2}$"


def series_rows(payloads: DataFrame, keys: list[str], body: str = "body") -> DataFrame:
    """One row per ``response.data`` entry: keys, period, value (both text)."""
    parsed = payloads.select(*keys, F.from_json(body, schemas.SERIES_PAYLOAD).alias("_p"))
    return parsed.select(*keys, F.inline("_p.response.data"))


def _newest(rows: DataFrame, key: str, limit: int) -> DataFrame:
    order = W.partitionBy(key).orderBy(F.col("period").desc(), F.col("value"))
    return rows.withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") <= limit)


def _prices(rows: DataFrame, key: str, timestamp: Column, unit: str, source: str) -> DataFrame:
    return rows.select(
        F.col(key).alias("commodity"),
        F.expr(to_float_sql("value")).alias("price"),
        F.lit(unit).alias("unit"),
        timestamp.alias("timestamp"),
        F.lit(source).alias("source"),
    ).filter("price IS NOT NULL AND timestamp IS NOT NULL")  # a price that reads as NaN stays


def spot_prices(
    payloads: DataFrame, as_of: AsOf, days: int = 30, key: str = "commodity",
    unit: str = "USD/bbl", source: str = "eia",
) -> DataFrame:
    """Daily spot prices of the look-back, the newest ``days`` entries per commodity."""
    start = F.date_format(days_before(as_of, days), "yyyy-MM-dd")
    rows = _newest(series_rows(payloads, [key]).filter(F.col("period") >= start), key, days)
    stamp = F.when(F.col("period").rlike(DAY_PATTERN), F.try_to_timestamp("period"))
    return _prices(rows, key, stamp, unit, source)


def monthly_prices(
    payloads: DataFrame, as_of: AsOf, days: int = 30, key: str = "commodity",
    unit: str = "USD/MMBtu", source: str = "eia", months: int = 12,
) -> DataFrame:
    """Monthly prices dated to the first of the month, at most ``months`` per commodity."""
    start = F.date_format(days_before(as_of, days), "yyyy-MM")
    rows = _newest(series_rows(payloads, [key]).filter(F.col("period") >= start), key, months)
    stamp = F.when(
        F.col("period").rlike(MONTH_PATTERN), F.try_to_timestamp(F.concat("period", F.lit("-01")))
    )
    return _prices(rows, key, stamp, unit, source)


def inventory_delta(payloads: DataFrame, key: str = "series_id") -> DataFrame:
    """Newest weekly level per series and its change against the week before."""
    two = _newest(series_rows(payloads, [key]), key, 2).withColumn(
        "_level", F.expr(f"CASE WHEN value IS NULL THEN 0d ELSE {to_float_sql('value')} END")
    )
    first, second = F.col("_rank") == 1, F.col("_rank") == 2
    per_series = two.groupBy(key).agg(
        F.max(F.when(first, F.col("period"))).alias("date"),
        F.max(F.when(first, F.col("_level"))).alias("inventory_mmbbl"),
        F.max(F.when(second, F.col("_level"))).alias("_previous"),
        F.count_if(F.col("_level").isNull()).alias("_bad"),
    )
    delta = per_series.filter("_bad = 0").withColumn("change_mmbbl", F.expr("inventory_mmbbl - _previous"))
    return delta.select(key, "date", "inventory_mmbbl", half_even("change_mmbbl", 2).alias("change_mmbbl"))


def news_rows(
    payloads: DataFrame, as_of: AsOf, days: int = 3, page_size: int = 20, query: str = "query",
    body: str = "body",
) -> DataFrame:
    """Articles of the look-back, newest ``page_size`` per query, rows without url or source skipped."""
    parsed = payloads.select(query, F.from_json(body, schemas.ARTICLES_PAYLOAD).alias("_p"))
    articles = parsed.select(query, F.inline("_p.articles")).withColumn(
        "published_at", F.try_to_timestamp("publishedAt")
    )
    inside = articles.filter(F.col("published_at") >= days_before(as_of, days).cast("timestamp"))
    newest = W.partitionBy(query).orderBy(F.col("published_at").desc(), F.col("url"))
    page = inside.withColumn("_rank", F.row_number().over(newest)).filter(F.col("_rank") <= page_size)
    return page.filter(F.col("url").isNotNull() & F.col("source.name").isNotNull()).select(
        query,
        F.coalesce("title", F.lit("")).alias("title"),
        "description",
        "url",
        "published_at",
        F.col("source.name").alias("source"),
        F.lit(None).cast("double").alias("sentiment"),
    )


def social_posts(
    posts: DataFrame, keywords=SOCIAL_KEYWORDS, groups=None, limit: int = 25, description_chars: int = 200,
) -> DataFrame:
    """Top posts per group, then those whose title holds a keyword as a substring.

    Expects group, score, post_id, title, body, permalink, created_utc.
    """
    if groups is not None:
        posts = posts.filter(F.col("group").isin(list(groups)))
    best = W.partitionBy("group").orderBy(F.col("score").desc(), F.col("post_id"))
    top = posts.withColumn("_rank", F.row_number().over(best)).filter(F.col("_rank") <= limit)
    words = F.array(*[F.lit(k.lower()) for k in keywords])
    title = F.lower("title")
    return top.filter(F.exists(words, lambda k: F.contains(title, k))).select(
        F.col("title"),
        F.nullif(F.substring("body", 1, description_chars), F.lit("")).alias("description"),
        F.concat(F.lit("https://reddit.com"), F.col("permalink")).alias("url"),
        F.timestamp_seconds("created_utc").alias("published_at"),
        F.concat(F.lit("reddit/r/"), F.col("group")).alias("source"),
        F.lit(None).cast("double").alias("sentiment"),
    )


def fundamentals(documents: DataFrame, symbol: str = "symbol", body: str = "body") -> DataFrame:
    """Ten fixed columns from an info document; an absent attribute is NULL."""
    parsed = documents.select(symbol, F.from_json(body, schemas.FUNDAMENTALS_PAYLOAD).alias("i"))
    names = {
        "sector": "sector", "pe_ratio": "trailingPE", "forward_pe": "forwardPE",
        "ev_ebitda": "enterpriseToEbitda", "dividend_yield": "dividendYield",
        "52w_high": "fiftyTwoWeekHigh", "52w_low": "fiftyTwoWeekLow",
        "market_cap": "marketCap", "beta": "beta",
    }
    return parsed.select(
        F.col(symbol).alias("symbol"), *[F.col(f"i.{old}").alias(new) for new, old in names.items()]
    )


def call_report_rows(reports: DataFrame, body: str = "body") -> DataFrame:
    """Call rows of saved reports ``{timestamp, system, raw_results[], summary{}}``."""
    schema = f"timestamp string, raw_results array<struct<{_as_struct(schemas.CALL_RESULT)}>>"
    parsed = reports.select(F.from_json(body, schema).alias("r"))
    return parsed.select(F.col("r.timestamp").alias("reported_at"), F.inline("r.raw_results"))


def call_report_summaries(reports: DataFrame, body: str = "body") -> DataFrame:
    """Summary rows of saved reports: the map keyed by provider/model, one row per entry."""
    schema = f"timestamp string, summary map<string, struct<{_as_struct(schemas.CALL_SUMMARY)}>>"
    parsed = reports.select(F.from_json(body, schema).alias("r"))
    entries = parsed.select(
        F.col("r.timestamp").alias("reported_at"), F.explode("r.summary").alias("model_name", "s")
    )
    return entries.select("reported_at", "model_name", "s.*")


def save_call_report(calls: DataFrame, summary: DataFrame, path: str, reported_at: str, system: dict[str, str] | None = None) -> None:
    """Save a benchmark run below ``path``: call rows, summary rows and the system it ran on, each as JSON lines.

    A report is one folder per part, so it has any number of calls; saving the same ``reported_at`` again replaces it.
    """
    stamp = F.lit(reported_at).alias("reported_at")
    known = (system or {}).items()
    described = calls.sparkSession.createDataFrame([(k, str(v)) for k, v in known], "key string, value string")
    wanted = {"raw_results": schemas.CALL_RESULT, "summary": schemas.CALL_SUMMARY, "system": "key string, value string"}
    for part, rows in (("raw_results", calls), ("summary", summary), ("system", described)):
        names = [f.split(" ")[0] for f in wanted[part].split(", ")]
        kept = rows.select(*[c for c in names if c in rows.columns], stamp)
        kept.write.mode("overwrite").partitionBy("reported_at").option("partitionOverwriteMode", "dynamic").json(f"{path}/{part}")


def load_call_report(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(call rows, summary rows, system entries) of all saved reports, each with its ``reported_at``; what a row lacks is NULL."""
    kinds = (("raw_results", schemas.CALL_RESULT), ("summary", schemas.CALL_SUMMARY), ("system", "key string, value string"))
    rows = [spark.read.schema(f"{kind}, reported_at string").json(f"{path}/{part}") for part, kind in kinds]
    return rows[0], rows[1], rows[2]


def flatten_runs(summaries: DataFrame, body: str = "body") -> DataFrame:
    """One row per signal of a stored run summary, with the run's recommendation beside it."""
    schema = (
        "run_id bigint, run_timestamp string, "
        f"signals array<struct<{_as_struct(_stored(schemas.AGENT_SIGNAL))}>>, "
        f"recommendation struct<{_as_struct(_stored(schemas.RECOMMENDATION))}>"
    )
    runs = summaries.select(F.from_json(body, schema).alias("r")).select("r.*")
    rows = runs.select("run_id", "run_timestamp", "recommendation", F.inline_outer("signals"))
    return rows.select(
        "run_id", "run_timestamp", F.substring("timestamp", 1, 10).alias("date"),
        "agent_name", "asset", "direction", "strength", "confidence",
        F.col("recommendation.asset").alias("rec_asset"),
        F.col("recommendation.direction").alias("rec_direction"),
        F.col("recommendation.position_size_pct").alias("rec_position_size_pct"),
    )


def _stored(schema: str) -> str:
    """Timestamps are ISO text inside stored documents."""
    return schema.replace("timestamp timestamp", "timestamp string")


def _as_struct(schema: str) -> str:
    """``a int, b map<string,x>`` as struct fields ``a: int, b: map<string,x>``."""
    out, depth, start = [], 0, 0
    for i, ch in enumerate(schema + ","):
        depth += (ch == "<") - (ch == ">")
        if ch == "," and depth == 0:
            name, kind = schema[start:i].strip().split(" ", 1)
            out.append(f"{name}: {kind}")
            start = i + 1
    return ", ".join(out)
