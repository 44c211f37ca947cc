"""Sentiment of posts and signal extraction from response texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import parsing as P
from ..operators import lookups as J
from ..operators import sentiment as S
from .bindings import BEARISH, BULLISH, NEWS, TICKERS, Inputs
from .oracle_views import VIEWS, half_even, q
from .registry import query, sql_stamp, stamp


def _words(words) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


VIEWS["post_text"] = "SELECT *, concat(title, ' ', coalesce(description, '')) AS body FROM posts"
VIEWS["polar"] = f"""
SELECT *, CASE WHEN list_has_any(words, {_words(BULLISH)}) THEN 'bullish' WHEN list_has_any(words, {_words(BEARISH)}) THEN 'bearish' ELSE 'neutral' END AS polarity
FROM (SELECT *, string_split_regex(lower(body), '\\s+') AS words FROM post_text)"""
VIEWS["mentions"] = f"""
SELECT doc_id, ticker FROM post_text, (SELECT unnest({_words(TICKERS)}) AS ticker) WHERE contains(lower(body), lower(ticker))"""
VIEWS["social0"] = """
SELECT count_if(polarity = 'bullish') AS bullish_count, count_if(polarity = 'bearish') AS bearish_count,
       count_if(polarity = 'neutral') AS neutral_count, count(*) AS total_posts,
       count_if(polarity = 'bullish') / greatest(count(*), 1) * 100 AS bull0, count_if(polarity = 'bearish') / greatest(count(*), 1) * 100 AS bear0
FROM polar"""
VIEWS["social"] = f"""
SELECT CAST(bullish_count AS BIGINT) AS bullish_count, CAST(bearish_count AS BIGINT) AS bearish_count,
       CAST(neutral_count AS BIGINT) AS neutral_count, total_posts,
       {half_even('bull0', 1)} AS bullish_pct, {half_even('bear0', 1)} AS bearish_pct FROM social0"""
VIEWS["social_dir"] = """
SELECT *, CASE WHEN bullish_pct > bearish_pct + 15 THEN 'BULLISH' WHEN bearish_pct > bullish_pct + 15 THEN 'BEARISH' ELSE 'NEUTRAL' END AS direction FROM social"""
VIEWS["headline_page"] = f"""
SELECT *, row_number() OVER (PARTITION BY query ORDER BY created_utc DESC) AS rank, list_position({_words(NEWS)}, query) AS query_order
FROM posts WHERE list_contains({_words(NEWS)}, query)"""
VIEWS["headlines"] = """
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY query_order, rank) AS copy FROM headline_page WHERE rank <= 10)
WHERE copy = 1"""


def headlines(inp: Inputs):
    rows = inp.articles().select("doc_id", "query", "title", "url", "published_at")
    return S.dedupe_headlines(rows, NEWS, 10)


@query("news_dedupe_multi", q(f"""
SELECT doc_id, query, title, url, {sql_stamp('make_timestamp(created_utc * 1000000)')} AS published_at,
       CAST(rank AS INT) AS rank, CAST(query_order AS INT) AS query_order FROM headlines"""))
def news_dedupe_multi(inp):
    return headlines(inp).withColumn("published_at", stamp("published_at"))


@query("recent_headlines", q("SELECT doc_id, query, title FROM headlines ORDER BY query_order, rank LIMIT 15"))
def recent_headlines(inp):
    return S.recent_headlines(headlines(inp), 15).select("doc_id", "query", "title")


@query("post_polarity", q("SELECT doc_id, polarity FROM polar"))
def post_polarity(inp):
    return S.with_polarity(inp.posts(), BULLISH, BEARISH).select("doc_id", "polarity")


@query("join_ticker_mentions", q("SELECT doc_id, ticker FROM mentions"))
def join_ticker_mentions(inp):
    return J.ticker_mentions(inp.posts(), S.POST_TEXT, TICKERS).select("doc_id", "ticker")


@query("ticker_mentions_top5", q("SELECT ticker, count(*) AS mentions FROM mentions GROUP BY ticker ORDER BY mentions DESC, ticker LIMIT 5"))
def ticker_mentions_top5(inp):
    return S.top_tickers(inp.posts(), TICKERS)


def social(inp: Inputs):
    return S.summary(inp.posts(), BULLISH, BEARISH)


@query("sentiment_summary", q("SELECT * FROM social"))
def sentiment_summary(inp):
    return social(inp)


@query("sentiment_margin", q("SELECT bullish_pct, bearish_pct, direction FROM social_dir"))
def sentiment_margin(inp):
    return S.with_margin(social(inp)).select("bullish_pct", "bearish_pct", "direction")


@query("sentiment_pie", q(f"""
SELECT bullish_pct, bearish_pct, {half_even('(100 - bullish_pct - bearish_pct)', 6)} AS neutral_pct FROM social"""))
def sentiment_pie(inp):
    return S.pie(social(inp))


@query("semi_lexicon", q(f"SELECT doc_id FROM polar WHERE list_has_any(words, {_words(BULLISH)})"))
def semi_lexicon(inp):
    return J.posts_with_words(inp.posts(), S.POST_TEXT, BULLISH).select("doc_id")


# --- response texts -------------------------------------------------------------------

VIEWS["texts"] = """
SELECT run_id, agent_name, ts, response_text, portfolio_id FROM responses
UNION ALL SELECT run_id, agent_name, ts, response_text, portfolio_id FROM answers"""
VIEWS["read0"] = r"""
SELECT *,
  CASE WHEN regexp_matches(upper(response_text), 'BULLISH|BUY|LONG') THEN 'BULLISH'
       WHEN regexp_matches(upper(response_text), 'BEARISH|SELL|SHORT') THEN 'BEARISH' ELSE 'NEUTRAL' END AS direction,
  CASE WHEN regexp_matches(upper(response_text), 'STRONG|HIGH') THEN 'STRONG'
       WHEN regexp_matches(upper(response_text), 'MODERATE|MEDIUM') THEN 'MODERATE' ELSE 'WEAK' END AS strength,
  TRY_CAST(nullif(regexp_extract(response_text, 'confidence[:\s]+(\d+(?:\.\d+)?)\s*%?', 1, 'i'), '') AS DOUBLE) AS stated,
  TRY_CAST(nullif(regexp_extract(response_text, '(\d+(?:\.\d+)?)\s*%', 1), '') AS DOUBLE) AS pct,
  TRY_CAST(nullif(regexp_extract(response_text, 'POSITION_SIZE[:\s]+(\d+(?:\.\d+)?)\s*%?', 1, 'i'), '') AS DOUBLE) AS sized,
  list_filter(list_transform(list_filter(string_split(upper(response_text), chr(10)), lambda x: contains(x, 'ASSET:')),
     lambda x: list_filter(['WTI','BRENT','NATGAS','XLE','USO','UNG','XOM','CVX','COP'], lambda a: contains(x, a))[1]),
     lambda y: y IS NOT NULL)[1] AS named
FROM texts"""
VIEWS["read_texts"] = """
SELECT *, CASE WHEN stated IS NOT NULL THEN least(CASE WHEN stated > 1 THEN stated / 100 ELSE stated END, 1.0::DOUBLE)
            WHEN pct IS NOT NULL THEN least(pct / 100, 1.0::DOUBLE) ELSE 0.5::DOUBLE END AS confidence,
       coalesce(named, 'XLE') AS asset,
       concat(strftime(ts, '%Y-%m-%dT%H:%M:%S'), CASE WHEN microsecond(ts) % 1000000 = 0 THEN '' ELSE strftime(ts, '.%f') END, '+00:00') AS "timestamp",
       strftime(ts, '%Y-%m-%d') AS date
FROM read0"""
VIEWS["signals"] = "SELECT * FROM read_texts WHERE agent_name <> 'PortfolioManager'"


def _parsed(inp: Inputs, name: str, column):
    return inp.responses().select("run_id", "agent_name", column.alias(name))


@query("resp_direction", q("SELECT run_id, agent_name, direction FROM signals"))
def resp_direction(inp):
    return _parsed(inp, "direction", P.direction_of("upper(response_text)"))


@query("resp_strength", q("SELECT run_id, agent_name, strength FROM signals"))
def resp_strength(inp):
    return _parsed(inp, "strength", P.strength_of("upper(response_text)"))


@query("resp_confidence", q("SELECT run_id, agent_name, confidence FROM signals"))
def resp_confidence(inp):
    return _parsed(inp, "confidence", P.confidence_of("upper(response_text)"))


@query("resp_asset", q("SELECT run_id, agent_name, asset FROM signals"))
def resp_asset(inp):
    return _parsed(inp, "asset", P.asset_of("upper(response_text)"))


@query("resp_position_size", q("""
SELECT run_id, agent_name, CASE WHEN sized IS NOT NULL THEN least(sized, 20.0::DOUBLE) ELSE 5.0::DOUBLE END AS position_size_pct FROM signals"""))
def resp_position_size(inp):
    return _parsed(inp, "position_size_pct", P.position_size_of("upper(response_text)", "5d"))


MODELS = ("anthropic.claude-v2", "amazon.titan-text-lite-v1", "meta.llama3-8b-instruct-v1:0", "mistral.mistral-7b-instruct-v0:2")


@query("resp_normalise_json", q("""
SELECT doc_id, CASE WHEN doc_id % 5 = 4 THEN '' ELSE regexp_replace(body, '^\\s+|\\s+$', '', 'g') END AS answer FROM padded""",
    padded="SELECT doc_id, concat('  ', coalesce(description, ''), chr(10)) AS body FROM posts"))
def resp_normalise_json(inp):
    """Answers wrapped the way each model family does; every fifth document lacks the text."""
    which = (F.col("doc_id") % 5).cast("int")
    text = F.concat(F.lit("  "), F.coalesce("description", F.lit("")), F.lit("\n"))
    body = (
        F.when(which == 0, F.to_json(F.struct(text.alias("completion"))))
        .when(which == 1, F.to_json(F.struct(F.array(F.struct(text.alias("outputText"))).alias("results"))))
        .when(which == 2, F.to_json(F.struct(text.alias("generation"))))
        .when(which == 3, F.to_json(F.struct(F.array(F.struct(text.alias("text"))).alias("outputs"))))
        .otherwise(F.lit("{}"))
    )
    model = F.get(F.array(*[F.lit(m) for m in (*MODELS, MODELS[0])]), which)
    rows = inp.posts().select("doc_id", model.alias("model"), body.alias("body"))
    return rows.select("doc_id", P.response_text("model", "body").alias("answer"))
