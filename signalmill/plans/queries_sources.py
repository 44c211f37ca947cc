"""Scans, payload ingestion, sinks and keyed tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import schemas
from ..constants import RETENTION_RULES
from ..operators import calls as C
from ..operators import decisions as D
from ..operators import lookups as J
from ..operators import signals as X
from ..operators import tables as T
from ..session import scratch_path
from ..sources import landed as L
from ..sources import payloads as P
from ..sources import series as S
from .bindings import KEYWORDS, SHOWN_SYMBOLS, Inputs
from .oracle_views import half_even, q
from . import queries_calls  # noqa: F401  (its views and SQL are used here)
from .queries_decisions import decisions
from .registry import ORACLES, day, query, sql_day, sql_stamp, stamp

LAST_ORDER = "(SELECT max(d) FROM bars_d)"
LAST_SHIP = "(SELECT max(d) FROM obs)"


def last_order(inp: Inputs):
    return inp.table("orders").agg(F.max(F.to_date("o_orderdate"))).scalar()


def last_ship(inp: Inputs):
    return inp.table("lineitem").agg(F.max(F.to_date("l_shipdate"))).scalar()


@query("ing_spot_prices", q(f"""
SELECT symbol AS commodity, close AS price, 'USD/bbl' AS unit, {sql_stamp('d')} AS "timestamp", 'eia' AS source
FROM ranked WHERE place <= 30 AND datediff('day', DATE '1970-01-01', d) % 11 <> 0""",
    ranked=f"""SELECT symbol, d, close, row_number() OVER (PARTITION BY symbol ORDER BY d DESC) AS place
FROM bars_d WHERE d >= {LAST_ORDER} - 30"""))
def ing_spot_prices(inp):
    rows = P.spot_prices(inp.spot_payloads(), last_order(inp), 30)
    return rows.withColumn("timestamp", stamp("timestamp"))


@query("ing_monthly_prices", q(f"""
SELECT symbol AS commodity, close AS price, 'USD/MMBtu' AS unit, {sql_stamp('m')} AS "timestamp", 'eia' AS source
FROM ranked WHERE place <= 12 AND datediff('day', DATE '1970-01-01', CAST(m AS DATE)) % 11 <> 0""",
    monthly="SELECT symbol, date_trunc('month', d) AS m, max(close) AS close FROM bars_d GROUP BY ALL",
    ranked=f"""SELECT symbol, m, close, row_number() OVER (PARTITION BY symbol ORDER BY m DESC) AS place
FROM monthly WHERE m >= date_trunc('month', {LAST_ORDER} - 365)"""))
def ing_monthly_prices(inp):
    rows = P.monthly_prices(inp.monthly_payloads(), last_order(inp), 365)
    return rows.withColumn("timestamp", stamp("timestamp"))


@query("ing_inventory_delta", q(f"""
SELECT series_id, {sql_day('p')} AS date, v AS inventory_mmbbl, {half_even('delta', 2)} AS change_mmbbl
FROM leveled WHERE place = 1"""))
def ing_inventory_delta(inp):
    return P.inventory_delta(inp.inventory_payloads())


@query("ing_series_window", q(f"""
SELECT series_id, {sql_day('d')} AS d, value FROM obs WHERE d >= {LAST_SHIP} - 90"""))
def ing_series_window(inp):
    return S.series_window(inp.obs(), last_ship(inp), 90).withColumn("d", day("d"))


@query("ing_zone_prices", q(f"""
SELECT concat('POWER_', series_id) AS commodity, value AS price, 'EUR/MWh' AS unit, {sql_stamp('d')} AS "timestamp",
       'entsoe' AS source FROM obs WHERE d >= {LAST_SHIP} - 7"""))
def ing_zone_prices(inp):
    return S.zone_prices(inp.obs(), last_ship(inp), 7).withColumn("timestamp", stamp("timestamp"))


@query("ing_news_rows", q(f"""
SELECT query, CASE WHEN doc_id % 13 = 0 THEN '' ELSE title END AS title, description,
       concat('https://example.invalid/p/', doc_id) AS url, {sql_stamp('stamp')} AS published_at, "group" AS source
FROM page WHERE place <= 20 AND doc_id % 19 <> 0""",
    dated="SELECT *, make_timestamp(created_utc * 1000000) AS stamp FROM posts",
    page="""SELECT *, row_number() OVER (PARTITION BY query ORDER BY stamp DESC) AS place
FROM dated WHERE doc_id % 17 <> 0 AND stamp >= (SELECT CAST(max(stamp) AS DATE) FROM dated) - 3"""))
def ing_news_rows(inp):
    newest = inp.table("documents").agg(
        F.to_date(F.timestamp_seconds(F.lit(788918400) + F.max("doc_id") * 7200))
    ).scalar()
    rows = P.news_rows(inp.article_payloads(), newest, 3, 20)
    return rows.drop("sentiment").withColumn("published_at", stamp("published_at"))


@query("ing_social_posts", q(f"""
SELECT title, nullif(substr(description, 1, 200), '') AS description,
       concat('https://reddit.com/r/', doc_id) AS url, {sql_stamp('make_timestamp(created_utc * 1000000)')} AS published_at,
       concat('reddit/r/', "group") AS source
FROM top WHERE place <= 25 AND (contains(lower(title), 'oil') OR contains(lower(title), 'hal') OR contains(lower(title), 'up'))""",
    top="""SELECT *, row_number() OVER (PARTITION BY "group" ORDER BY score DESC, doc_id) AS place FROM posts"""))
def ing_social_posts(inp):
    posts = inp.posts().select(
        "group", "score", F.col("doc_id").alias("post_id"), "title", F.col("description").alias("body"),
        F.concat(F.lit("/r/"), F.col("doc_id").cast("string")).alias("permalink"), "created_utc",
    )
    rows = P.social_posts(posts, KEYWORDS, limit=25)
    return rows.drop("sentiment").withColumn("published_at", stamp("published_at"))


def last_tick(inp: Inputs):
    return inp.table("events").agg(F.to_date(F.max("ts"))).scalar()


@query("scan_bars", q(f"""
SELECT symbol, {sql_stamp('ts')} AS ts, open, high, low, close, volume FROM bars_h
WHERE symbol IN ('purchase', 'view', 'click') AND ts >= (SELECT CAST(max(ts) AS DATE) FROM events) - 10"""))
def scan_bars(inp):
    return S.scan_bars(inp.bars_h(), last_tick(inp), SHOWN_SYMBOLS, 10).withColumn("ts", stamp("ts"))


@query("scan_fundamentals", """
SELECT concat('P', p_partkey) AS symbol, p_type AS sector, p_retailprice AS pe_ratio, NULL::DOUBLE AS forward_pe,
       NULL::DOUBLE AS ev_ebitda, NULL::DOUBLE AS dividend_yield, NULL::DOUBLE AS "52w_high", NULL::DOUBLE AS "52w_low",
       CASE WHEN p_size > 25 THEN p_retailprice * 2 END AS market_cap, CAST(p_size AS DOUBLE) AS beta
FROM part""")
def scan_fundamentals(inp):
    return P.fundamentals(inp.fundamentals_documents())


@query("scan_dated_json", q(f"""
SELECT {sql_day('ts')} AS date, symbol, {sql_stamp('ts')} AS ts, close, volume FROM bars_h"""))
def scan_dated_json(inp):
    path = scratch_path(inp.spark, "raw")
    L.write_dated(inp.bars_h().select(day("ts").alias("date"), "symbol", stamp("ts").alias("ts"), "close", "volume"), path)
    return L.read_dated(inp.spark, path, "symbol string, ts string, close double, volume bigint, date string")


@query("scan_dated_parquet", q(f"""
SELECT {sql_day('ts')} AS date, symbol, {sql_stamp('ts')} AS ts, close FROM bars_h"""))
def scan_dated_parquet(inp):
    path = scratch_path(inp.spark, "prices")
    L.write_dated(inp.bars_h().select(day("ts").alias("date"), "symbol", "ts", "close"), path, ["date", "symbol"], "parquet")
    schema = "ts timestamp_ntz, close double, date string, symbol string"
    return L.read_dated(inp.spark, path, schema, "parquet").withColumn("ts", stamp("ts"))


@query("list_dated_parquet", q(f"""
SELECT concat('date=', {sql_day('ts')}, '/symbol=', symbol) AS prefix, count(*) AS "rows" FROM bars_h GROUP BY ALL"""))
def list_dated_parquet(inp):
    path = scratch_path(inp.spark, "prices")
    L.write_dated(inp.bars_h().select(day("ts").alias("date"), "symbol", "ts", "close"), path, ["date", "symbol"], "parquet")
    files = L.listed_keys(inp.spark, path, "ts timestamp_ntz, close double, date string, symbol string")
    prefix = F.regexp_extract("key", r"(date=[^/]+/symbol=[^/]+)/", 1)
    return files.groupBy(prefix.alias("prefix")).agg(F.sum("rows").alias("rows"))


SIGNAL_ROW = "run_id bigint, agent_name string, asset string, direction string, strength string, confidence double, timestamp string, date string"
SIGNAL_COLUMNS = ["run_id", "agent_name", "asset", "direction", "strength", "confidence", "timestamp", "date"]


def signal_table(inp: Inputs):
    return X.signal_records(X.parsed(inp.responses())).select(*SIGNAL_COLUMNS)


KEYED = """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY date, agent_name ORDER BY "timestamp" DESC) AS place
FROM signals) WHERE place = 1"""
SHOWN = 'run_id, agent_name, asset, direction, strength, confidence, "timestamp", date'


def stored_signals(inp: Inputs):
    """The signals written in two batches and read back by key."""
    path = scratch_path(inp.spark, "signals")
    rows = signal_table(inp)
    noon = "2024-01-15T12:00:00"
    L.write_batch(rows.filter(F.col("timestamp") < noon), path, 0)
    L.write_batch(rows.filter(F.col("timestamp") >= noon), path, 1)
    return L.read_keyed(inp.spark, path, SIGNAL_ROW, schemas.KEYS["signals"], ["timestamp"])


@query("sink_upsert", q(f"SELECT {SHOWN} FROM keyed", keyed=KEYED))
def sink_upsert(inp):
    return stored_signals(inp)


@query("sink_merge", q(f"SELECT {SHOWN} FROM keyed", keyed=KEYED))
def sink_merge(inp):
    """Eight merges into a table that folds a folder with more than three live batches; what is read does not grow with them."""
    table = L.KeyedTable(inp.spark, scratch_path(inp.spark, "merged"), SIGNAL_ROW, schemas.KEYS["signals"], ["timestamp"], most=3)
    rows = signal_table(inp)
    for batch in range(8):
        table.merge(rows.filter(F.expr(f"CAST(substring(timestamp, 12, 2) AS int) div 3 = {batch}")), batch)
    return table.read()


@query("lookup_key", q(f"SELECT {SHOWN} FROM keyed WHERE date = '2024-01-10' AND agent_name = 'RiskManager'", keyed=KEYED))
def lookup_key(inp):
    """A full key of the stored table: only its folder is read."""
    return T.lookup(stored_signals(inp), {"date": "2024-01-10", "agent_name": "RiskManager"})


@query("query_key_desc", q(f"""
SELECT model_name, {sql_stamp('ts')} AS "timestamp", call_id, total_ms, cost_usd FROM calls
WHERE model_name = 'groq/purchase' ORDER BY ts DESC, call_id LIMIT 100"""))
def query_key_desc(inp):
    rows = T.newest_of_key(inp.calls(), {"model_name": "groq/purchase"}, "ts", 100)
    return rows.select("model_name", stamp("ts").alias("timestamp"), "call_id", "total_ms", "cost_usd")


@query("scan_limit", q(f"""SELECT {SHOWN} FROM signals ORDER BY "timestamp" DESC, agent_name, run_id LIMIT 100"""))
def scan_limit(inp):
    return T.first_rows(signal_table(inp), 100, "timestamp", ["agent_name", "run_id"])


@query("lookup_by_agent", q(f"SELECT {SHOWN} FROM signals WHERE agent_name = 'SentimentAgent'"))
def lookup_by_agent(inp):
    return T.by_agent(signal_table(inp), "SentimentAgent")


@query("flatten_run_summary", q("""
SELECT d.run_id, d.date, s.agent_name, s.asset, s.direction, s.strength, s.confidence,
       d.asset AS rec_asset, d.direction AS rec_direction, d.position_size_pct AS rec_position_size_pct
FROM decided d JOIN final_signals s USING (run_id)"""))
def flatten_run_summary(inp):
    flat = P.flatten_runs(D.run_summaries(decisions(inp)))
    return flat.drop("run_timestamp")


@query("retention_job", q("""
SELECT prefix, strftime(w, '%Y-%m-%d') AS date, place, n FROM (
  SELECT prefix, w, n, CASE prefix
         WHEN 'raw' THEN CASE WHEN datediff('day', w, newest) > 90 THEN 'archive/raw' ELSE 'raw' END
         WHEN 'signals' THEN CASE WHEN datediff('day', w, newest) <= 365 THEN 'signals' END
         WHEN 'results' THEN CASE WHEN datediff('day', w, newest) <= 30 THEN 'results' END ELSE prefix END AS place
  FROM (SELECT prefix, CAST(date_trunc('month', d) AS DATE) AS w, newest, count(*) AS n
        FROM bars_d, (SELECT max(d) AS newest FROM bars_d), (SELECT unnest(['raw', 'signals', 'results', 'other']) AS prefix) GROUP BY ALL)) WHERE place IS NOT NULL"""))
def retention_job(inp):
    """Monthly folders of four prefixes, after the rules have moved and removed what is too old; run twice."""
    spark, root = inp.spark, scratch_path(inp.spark, "aging")
    as_of = inp.table("orders").agg(F.max(F.to_date("o_orderdate"))).first()[0]
    month = day(F.date_trunc("month", "d")).alias("date")
    prefixes = F.explode(F.array(*[F.lit(p) for p in ("raw", "signals", "results", "other")])).alias("prefix")
    rows = inp.bars_d().select("symbol", "close", month).select("*", prefixes)
    L.write_dated(rows.withColumnRenamed("prefix", "under"), f"{root}/landed", ["under", "date"], "parquet")
    rules = [L.Retention(f"under={prefix}", days, action) for prefix, days, action in RETENTION_RULES]
    for _ in range(2):
        L.retain(spark, f"{root}/landed", as_of, rules, "../archive")
    out = None
    for place, kept in (("landed", "{0}"), ("archive", "archive/{0}")):
        part = L.read_dated(spark, f"{root}/{place}", "symbol string, close double, under string, date string", "parquet")
        part = part.groupBy("under", "date").agg(F.count("*").alias("n"))
        part = part.select(F.col("under").alias("prefix"), "date", F.format_string(kept.format("%s"), "under").alias("place"), "n")
        out = part if out is None else out.unionByName(part)
    return out


@query("retention_split", q(f"""
SELECT symbol, {sql_day('d')} AS d, CASE WHEN datediff('day', d, {LAST_ORDER}) > 365 THEN 'expire'
       WHEN datediff('day', d, {LAST_ORDER}) > 90 THEN 'archive' ELSE 'keep' END AS tier FROM bars_d"""))
def retention_split(inp):
    rows = T.retention(inp.bars_d(), last_order(inp), "d", 90, 365)
    return rows.select("symbol", day("d").alias("d"), "tier")


@query("scan_call_report", q("""
SELECT concat('report-', CAST(floor(call_id / 56) AS BIGINT)) AS reported_at, provider, model, CAST(call_id AS VARCHAR) AS prompt_id,
       prompt_tokens, completion_tokens, total_ms, tokens_per_sec, cost_usd, ok FROM calls"""))
def scan_call_report(inp):
    return P.call_report_rows(inp.call_reports()).drop("response_preview", "error")


@query("scan_call_report_summary", q("""
SELECT concat('report-', CAST(floor(call_id / 56) AS BIGINT)) AS reported_at, model_name, count(*) AS calls, max(total_ms) AS max_ms
FROM calls WHERE ok GROUP BY ALL"""))
def scan_call_report_summary(inp):
    return P.call_report_summaries(inp.call_reports()).select("reported_at", "model_name", "calls", "max_ms")


def reported(inp: Inputs):
    """The call log and its summary, saved as a report twice, and an older report beside it; all read again."""
    path = scratch_path(inp.spark, "reports")
    calls, summary = inp.calls(), C.call_summary(inp.calls())
    first = calls.filter("call_id < 56").withColumn("prompt_id", F.col("call_id").cast("string"))
    P.save_call_report(first, C.call_summary(first), path, "2024-01-01T00:00:00+00:00")
    for _ in range(2):
        P.save_call_report(calls.withColumn("prompt_id", F.col("call_id").cast("string")), summary, path, "2024-02-01T00:00:00+00:00", {"cpu": "x"})
    return P.load_call_report(inp.spark, path)


@query("call_report_saved", q("""
SELECT reported_at, provider, model, CAST(call_id AS VARCHAR) AS prompt_id, prompt_tokens, completion_tokens, total_ms, tokens_per_sec, cost_usd, ok
FROM calls, (VALUES ('2024-01-01T00:00:00+00:00', 56), ('2024-02-01T00:00:00+00:00', 1000000000)) t(reported_at, upto) WHERE call_id < upto"""))
def call_report_saved(inp):
    return reported(inp)[0].drop("response_preview", "error")


@query("call_report_saved_summary", ORACLES["call_summary"])
def call_report_saved_summary(inp):
    """The summary of the newest saved report, as it was printed when it was saved."""
    return reported(inp)[1].filter("reported_at = '2024-02-01T00:00:00+00:00'").drop("reported_at")


@query("anti_seen_urls", q("""
SELECT doc_id, url FROM posts WHERE url NOT IN (SELECT url FROM posts WHERE query = 'en')"""))
def anti_seen_urls(inp):
    posts = inp.posts().select("doc_id", "query", "url")
    return J.unseen(posts, posts.filter(F.col("query") == "en")).select("doc_id", "url")


@query("proj_existing_cols", q("""SELECT agent_name, asset, direction, strength, confidence, "timestamp" FROM signals"""))
def proj_existing_cols(inp):
    return T.existing_columns(
        signal_table(inp), ["agent_name", "asset", "direction", "strength", "confidence", "timestamp", "missing_column"]
    )


@query("agent_names", q("SELECT DISTINCT agent_name FROM signals"))
def agent_names(inp):
    return T.agent_names(signal_table(inp))


@query("filter_agent_log", q("""
SELECT agent_name, direction, asset, substr("timestamp", 1, 16) AS minute, response_text AS reasoning FROM signals
WHERE agent_name = 'TechnicalAnalyst' ORDER BY "timestamp" DESC LIMIT 10"""))
def filter_agent_log(inp):
    return T.agent_log(X.signal_records(X.parsed(inp.responses())), "TechnicalAnalyst")


@query("sql_latest_signals", q("""
SELECT date, agent_name, direction, strength, confidence FROM keyed ORDER BY date DESC, agent_name LIMIT 20""", keyed=KEYED))
def sql_latest_signals(inp):
    return T.latest_signals_sql(T.last_write(signal_table(inp), schemas.KEYS["signals"], ["timestamp"]))


@query("sql_direction_distribution", q("""
SELECT date, CAST(sum(CASE WHEN direction = 'BULLISH' THEN 1 ELSE 0 END) AS BIGINT) AS bullish,
       CAST(sum(CASE WHEN direction = 'BEARISH' THEN 1 ELSE 0 END) AS BIGINT) AS bearish FROM signals GROUP BY date"""))
def sql_direction_distribution(inp):
    return T.direction_distribution_sql(signal_table(inp))


@query("portfolio_view", q("""
SELECT portfolio_id, symbol, size_pct FROM positions ORDER BY portfolio_id, symbol LIMIT 50"""))
def portfolio_view(inp):
    return T.position_view(inp.positions())
