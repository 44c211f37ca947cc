"""Metric rows, windows, alarms, queues and new-file streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import schemas
from ..functions.numeric import half_even as he
from ..functions.numeric import rounded
from ..operators import metrics as M
from ..operators import signals as X
from ..session import scratch_path
from ..sources import landed as L
from ..streaming import queue as Q
from ..streaming import triggers as G
from ..streaming import windows as S
from .bindings import Inputs
from .oracle_views import VIEWS, half_even, q
from .queries_dated import DATED, dated_recommendations
from .queries_market import snapshots
from .registry import day, query, sql_day, sql_stamp, stamp

HOUR_RULES = (("IngestionFailures", 3.0, False), ("ThrottleCount", 3.0, False), ("AgentLatencyMs", 200.0, True))


VIEWS["emitted"] = """
SELECT 'SignalsEmitted' AS name, 1.0::DOUBLE AS value, ts, agent_name AS agent, direction FROM signals
UNION ALL SELECT 'LLMCallLatencyMs', total_ms, ts, NULL, NULL FROM calls
UNION ALL SELECT 'AgentLatencyMs', total_ms, ts, agent_name, NULL FROM calls
UNION ALL SELECT 'GroqKeyThrottles', 1, ts, NULL, NULL FROM events WHERE event_type = 'signup'
UNION ALL SELECT 'IngestionFailures', 1, ts, NULL, NULL FROM events WHERE event_type = 'error'"""


@query("metric_rows", q(f"""
SELECT 'SignalsEmitted' AS name, 1.0::DOUBLE AS value, 'Count' AS unit, {sql_stamp('ts')} AS "timestamp",
       concat('Agent=', agent_name, ';Direction=', direction, ';Environment=dev') AS dims FROM signals
UNION ALL SELECT 'LLMCallLatencyMs', total_ms, 'Milliseconds', {sql_stamp('ts')}, concat('Environment=dev;Model=', model) FROM calls
UNION ALL SELECT 'AgentLatencyMs', total_ms, 'Milliseconds', {sql_stamp('ts')}, concat('Agent=', agent_name, ';Environment=dev') FROM calls
UNION ALL SELECT 'GroqKeyThrottles', 1, 'Count', {sql_stamp('ts')}, concat('Environment=dev;KeyIndex=', user_id % 3) FROM events WHERE event_type = 'signup'
UNION ALL SELECT 'IngestionFailures', 1, 'Count', {sql_stamp('ts')}, concat('Environment=dev;Source=', props) FROM events WHERE event_type = 'error'"""))
def metric_rows(inp):
    return emitted(inp).select("name", "value", "unit", stamp("timestamp").alias("timestamp"), M.dims_text(F.col("dims")).alias("dims"))


def emitted(inp: Inputs):
    """Metric rows of all emitters."""
    events, calls = inp.table("events"), inp.calls()
    rows = M.signals_emitted(X.parsed(inp.responses()))
    rows = rows.unionByName(M.call_latency(calls))
    rows = rows.unionByName(M.agent_latency(calls.withColumn("latency_ms", F.col("total_ms"))))
    throttled = events.filter(F.col("event_type") == "signup").withColumn("key_index", F.col("user_id") % 3)
    rows = rows.unionByName(M.key_throttles(throttled))
    failed = events.filter(F.col("event_type") == "error").withColumnRenamed("props", "source")
    return rows.unionByName(M.ingestion_failures(failed))


@query("metric_stat_sum", q(f"""
SELECT name, direction, {sql_stamp("time_bucket(INTERVAL '15 minutes', ts)")} AS start, count(*) AS n, sum(value) AS total
FROM emitted WHERE name = 'SignalsEmitted' AND agent = 'RiskManager' GROUP BY ALL"""))
def metric_stat_sum(inp):
    """Sums per direction of one agent's signals over 15 minutes, from counts per 5 minutes and dimension set."""
    counts = M.value_counts(emitted(inp).filter("name = 'SignalsEmitted'"))
    rows = M.statistics(counts, ["Sum"], ["Direction"], {"Agent": "RiskManager", "Environment": "dev"}, 900)
    return rows.selectExpr("name", "Direction AS direction", "date_format(start, 'yyyy-MM-dd HH:mm:ss') AS start", "SampleCount AS n", "Sum AS total")


@query("metric_stat_p95", q(f"""
SELECT name, {sql_stamp('start')} AS start, n, {half_even('p50', 6)} AS p50, {half_even('p95', 6)} AS p95, low, high FROM cut""",
    cut="""SELECT name, time_bucket(INTERVAL '15 minutes', ts) AS start, count(*) AS n, quantile_cont(value, 0.5) AS p50, quantile_cont(value, 0.95) AS p95,
       min(value) AS low, max(value) AS high FROM emitted WHERE name IN ('AgentLatencyMs', 'LLMCallLatencyMs') GROUP BY ALL"""))
def metric_stat_p95(inp):
    """Exact percentiles over all agents and all models, from the same kind of counts."""
    counts = M.value_counts(emitted(inp).filter("name IN ('AgentLatencyMs', 'LLMCallLatencyMs')"))
    rows = M.statistics(counts, ["p50", "p95", "Minimum", "Maximum"], seconds=900)
    return rows.select(
        "name", stamp("start").alias("start"), F.col("SampleCount").alias("n"), *rounded({"p50": 6, "p95": 6}), F.col("Minimum").alias("low"), F.col("Maximum").alias("high")
    )


QUARTER = "time_bucket(INTERVAL '15 minutes', ts)"


@query("metric_latency_15m", q(f"""
SELECT metric, {sql_stamp('start')} AS start, n, {half_even('p50', 6)} AS p50, {half_even('p95', 6)} AS p95 FROM pct""",
    pct=f"""SELECT metric, {QUARTER} AS start, count(*) AS n, quantile_cont(value, 0.5) AS p50, quantile_cont(value, 0.95) AS p95
FROM metrics WHERE metric = 'AgentLatencyMs' GROUP BY ALL"""))
def metric_latency_15m(inp):
    rows = M.windowed_percentiles(inp.metrics().filter(F.col("metric") == "AgentLatencyMs"), ["metric"])
    return rows.select("metric", stamp("start").alias("start"), "n", *rounded({"p50": 6, "p95": 6}))


@query("call_latency_15m", q(f"""
SELECT provider, {sql_stamp('start')} AS start, n, {half_even('p50', 6)} AS p50, {half_even('p95', 6)} AS p95 FROM pct""",
    pct=f"""SELECT provider, {QUARTER} AS start, count(*) AS n, quantile_cont(total_ms, 0.5) AS p50, quantile_cont(total_ms, 0.95) AS p95
FROM calls GROUP BY ALL"""))
def call_latency_15m(inp):
    rows = M.windowed_percentiles(inp.calls().withColumnRenamed("total_ms", "value"), ["provider"])
    return rows.select("provider", stamp("start").alias("start"), "n", *rounded({"p50": 6, "p95": 6}))


VIEWS["counts_15m"] = f"SELECT metric, agent, {QUARTER} AS start, sum(value) AS total, count(*) AS n FROM metrics GROUP BY ALL"
COUNTS_SQL = q(f"SELECT metric, agent, {sql_stamp('start')} AS start, {half_even('total', 6)} AS total, n FROM counts_15m")


@query("metric_counts_15m", COUNTS_SQL)
def metric_counts_15m(inp):
    rows = M.windowed_sums(inp.metrics(), ["metric", "agent"])
    return rows.select("metric", "agent", stamp("start").alias("start"), he("total", 6).alias("total"), "n")


@query("metric_directions_15m", q(f"""
SELECT direction, {sql_stamp(QUARTER)} AS start, count(*) AS n FROM signals GROUP BY ALL"""))
def metric_directions_15m(inp):
    rows = M.windowed_sums(X.parsed(inp.responses()).withColumn("value", F.lit(1.0)), ["direction"])
    return rows.select("direction", stamp("start").alias("start"), "n")


def _alarm_views(seconds: int, rules) -> dict[str, str]:
    listed = ", ".join(f"('{m}', {t}::DOUBLE, {str(s).lower()})" for m, t, s in rules)
    return {
        "periods": f"SELECT metric, time_bucket(INTERVAL '{seconds} seconds', ts) AS start, sum(value) AS total FROM metrics GROUP BY ALL",
        "rules": f"SELECT * FROM (VALUES {listed}) t(metric, threshold, strict)",
        "breaches": "SELECT *, CASE WHEN strict THEN total > threshold ELSE total >= threshold END AS breaching FROM periods JOIN rules USING (metric)",
        "states": f"""SELECT b.*, b.breaching AND coalesce(a.breaching, false) AS alarm FROM breaches b
LEFT JOIN breaches a ON a.metric = b.metric AND a.start = b.start - INTERVAL '{seconds} seconds'""",
        "changes": f"""SELECT b.*, b.alarm <> coalesce(a.alarm, false) AS changed FROM states b
LEFT JOIN states a ON a.metric = b.metric AND a.start = b.start - INTERVAL '{seconds} seconds'""",
    }


ALARM_SQL = f"""SELECT metric, {sql_stamp('start')} AS start, {half_even('total', 6)} AS total, threshold, breaching,
       CASE WHEN alarm THEN 'ALARM' ELSE 'OK' END AS state, changed FROM changes"""
FIVE_RULES = (("IngestionFailures", 3.0, False), ("ThrottleCount", 10.0, False), ("AgentLatencyMs", 30000.0, True))


def _alarms(rows):
    return rows.withColumn("start", stamp("start")).withColumn("total", he("total", 6))


@query("alarm_eval", q(ALARM_SQL, **_alarm_views(300, FIVE_RULES)))
def alarm_eval(inp):
    return _alarms(M.alarms(inp.metrics(), FIVE_RULES))


@query("alarm_eval_hourly", q(ALARM_SQL, **_alarm_views(3600, HOUR_RULES)))
def alarm_eval_hourly(inp):
    return _alarms(M.alarms(inp.metrics(), HOUR_RULES, 3600))


ROW_RULES = [
    M.Alarm("IngestionFailures", 3.0), M.Alarm("GroqKeyThrottles", 3.0), M.Alarm("SignalsEmitted", 2.0, True, "Sum", (("Agent", "RiskManager"),)),
    M.Alarm("AgentLatencyMs", 1500.0, True, "p95"),
]


def _row_alarm_views(rules) -> dict[str, str]:
    return _alarm_views(3600, [(r.metric, r.threshold, r.strict) for r in rules]) | {"periods": """
SELECT name AS metric, time_bucket(INTERVAL '1 hour', ts) AS start, sum(value) AS total FROM emitted
WHERE name IN ('IngestionFailures', 'GroqKeyThrottles') OR (name = 'SignalsEmitted' AND agent = 'RiskManager') GROUP BY ALL
UNION ALL SELECT name, time_bucket(INTERVAL '1 hour', ts), quantile_cont(value, 0.95) FROM emitted WHERE name = 'AgentLatencyMs' GROUP BY ALL"""}


@query("alarm_rows", q(ALARM_SQL, **_row_alarm_views(ROW_RULES)))
def alarm_rows(inp):
    """Alarms over the emitters' own rows: sums, a sum of one dimension, and a 95th percentile."""
    return _alarms(M.row_alarms(emitted(inp), ROW_RULES, 3600))


# --- streams over files ------------------------------------------------------------------

def _landed_metrics(inp: Inputs) -> str:
    """The metric table written to its own folder, as a producer would land it."""
    path = scratch_path(inp.spark, "metrics")
    inp.metrics().write.parquet(path)
    return path


METRIC_ROW = "ts timestamp_ntz, metric string, value double, agent string"


@query("stream_counts_15m", COUNTS_SQL)
def stream_counts_15m(inp):
    """Windows as they change, keyed by window: what is open is corrected, what the watermark has passed leaves the state."""
    stream = inp.spark.readStream.schema(METRIC_ROW).parquet(_landed_metrics(inp))
    sums = S.stream_sums(stream, ["metric", "agent"])
    out = scratch_path(inp.spark, "windows")
    S.store_windows(sums, scratch_path(inp.spark, "state"), out, mode="update")
    schema = f"{S.WINDOW_ROWS}, agent string"
    rows = L.read_keyed(inp.spark, out, schema, ["metric", "agent", "start"])
    return rows.select("metric", "agent", stamp("start").alias("start"), he("total", 6).alias("total"), "n")


def _closed(seconds: int) -> str:
    """The condition that a window is closed: its end is not after the newest time less the watermark's delay."""
    return f"start + INTERVAL '{seconds} seconds' <= (SELECT max(ts) FROM metrics) - INTERVAL '{S.WATERMARK}'"


_HOURLY = _alarm_views(3600, HOUR_RULES)


@query("stream_alarms", q(ALARM_SQL, **(_HOURLY | {"periods": f"SELECT * FROM ({_HOURLY['periods']}) WHERE {_closed(3600)}"})))
def stream_alarms(inp):
    """Alarm states over the windows an append-mode stream has closed; the newest windows are still open."""
    stream = inp.spark.readStream.schema(METRIC_ROW).parquet(_landed_metrics(inp))
    out = scratch_path(inp.spark, "windows")
    S.store_windows(S.stream_sums(stream, ["metric"], 3600), scratch_path(inp.spark, "state"), out)
    return _alarms(S.alarm_states(inp.spark, out, HOUR_RULES, 3600))


@query("stream_latency_15m", q(f"""
SELECT metric, {sql_stamp('start')} AS start, n, {half_even('p50', 6)} AS p50, {half_even('p95', 6)} AS p95 FROM pct WHERE {_closed(900)}""",
    pct=f"""SELECT metric, {QUARTER} AS start, count(*) AS n, quantile_cont(value, 0.5) AS p50, quantile_cont(value, 0.95) AS p95
FROM metrics GROUP BY ALL"""))
def stream_latency_15m(inp):
    """Exact p50 and p95 of the windows an append-mode stream has closed, from the value counts it stores."""
    stream = inp.spark.readStream.schema(METRIC_ROW).parquet(_landed_metrics(inp))
    out = scratch_path(inp.spark, "windows")
    S.store_windows(S.stream_value_counts(stream, ["metric"]), scratch_path(inp.spark, "state"), out)
    schema = "metric string, start timestamp, value double, n bigint"
    counts = L.read_keyed(inp.spark, out, schema, ["metric", "start", "value"])
    return S.stored_percentiles(counts, ["metric"]).select("metric", stamp("start").alias("start"), "n", *rounded({"p50": 6, "p95": 6}))


@query("stream_alarm_states", q(ALARM_SQL, **(_row_alarm_views(ROW_RULES) | {
    "periods": f"""SELECT * FROM ({_row_alarm_views(ROW_RULES)['periods']})
WHERE start + INTERVAL '3600 seconds' <= (SELECT max(ts) FROM emitted) - INTERVAL '{S.WATERMARK}'"""})))
def stream_alarm_states(inp):
    """Alarms judged window by window as a stream of metric rows closes them, landed and drained in two goes."""
    spark = inp.spark
    landing, state, out = (scratch_path(spark, name) for name in ("emitted", "state", "alarms"))
    rows = emitted(inp)
    for low, high in (("2000-01-01", "2024-01-16"), ("2024-01-16", "2100-01-01")):
        rows.filter(f"timestamp >= '{low}' AND timestamp < '{high}'").write.mode("append").parquet(landing)
        stream = spark.readStream.schema("name string, value double, unit string, timestamp timestamp_ntz, dims map<string,string>").parquet(landing)
        S.watch_alarms(S.stream_metric_counts(stream, 3600), state, out, ROW_RULES, 3600)
    return _alarms(S.judged_alarms(spark, out))


@query("queue_consume_dlq", """
SELECT CAST(event_id AS VARCHAR) AS message_id, CASE WHEN event_type = 'error' THEN 'dead' ELSE 'ok' END AS status,
       CASE WHEN event_type = 'error' THEN 3 ELSE 1 END AS attempt FROM events
UNION ALL SELECT concat('line:', sha256(concat('{broken ', CAST(event_id AS VARCHAR)))), 'dead', 3 FROM events WHERE event_id % 50 = 7""")
def queue_consume_dlq(inp):
    """Messages from events, the bodies of errors cut open, some without an attempt, and lines that are no messages; bad
    ones are redelivered until they are dead."""
    body = F.to_json(F.struct(F.col("event_type"), day("ts").alias("date"), F.lit("k").alias("s3_key")))
    landing, out, state = (scratch_path(inp.spark, name) for name in ("queue", "outcome", "state"))
    events = inp.table("events")
    events.select(
        F.col("event_id").cast("string").alias("message_id"), F.when(F.col("event_id") % 50 != 8, 1).alias("attempt"),
        F.when(F.col("event_type") == "error", F.regexp_replace(body, r"\}$", "")).otherwise(body).alias("body"),
    ).write.json(landing)
    events.filter("event_id % 50 = 7").select(F.concat(F.lit("{broken "), F.col("event_id").cast("string"))).write.mode("append").text(landing)
    Q.consume(inp.spark, landing, out, state)
    while Q.reland(inp.spark, out, landing):
        Q.consume(inp.spark, landing, out, state)
    return Q.outcome(inp.spark, out).select("message_id", "status", "attempt")


@query("snapshot_trigger", q(f"""
SELECT 'new_snapshot' AS event_type, {sql_day('d')} AS date, concat('raw/', {sql_day('d')}, '/combined.json') AS s3_key
FROM (SELECT DISTINCT d FROM quotes)"""))
def snapshot_trigger(inp):
    """Every landed snapshot announced once."""
    spark = inp.spark
    landing, out = scratch_path(spark, "snapshots"), scratch_path(spark, "events")
    snapshots(inp).write.json(landing)
    G.on_new_snapshot(
        spark, landing, scratch_path(spark, "state"), schemas.MARKET_SNAPSHOT,
        lambda batch, number: L.write_batch(batch, out, number, ["event_type"]),
    )
    return L.read_keyed(spark, out, "event_type string, date string, s3_key string", ["date"])


@query("snapshot_chain", q("""
SELECT run_id, date, asset, direction, strength, confidence, position_size_pct FROM decided WHERE date IN (SELECT strftime(d, '%Y-%m-%d') FROM quotes)""", **DATED))
def snapshot_chain(inp):
    """Snapshots land in two goes, the second brings some dates again; each run of their dates is decided and stored once."""
    spark = inp.spark
    landing, state = scratch_path(spark, "snapshots"), scratch_path(spark, "state")
    stored = L.KeyedTable(
        spark, scratch_path(spark, "recommendations"),
        "run_id bigint, date string, asset string, direction string, strength string, confidence double, position_size_pct double, month string",
        ["month", "date", "run_id"], by="month",
    )
    def decide(dates):
        return dated_recommendations(inp, dates).withColumn("month", F.substring("date", 1, 7))

    every = snapshots(inp)
    for part in ("date < '1995-05-01'", "date >= '1995-04-01'"):
        every.filter(part).write.mode("append").json(landing)
        G.decide_on_snapshots(spark, landing, state, schemas.MARKET_SNAPSHOT, decide, stored)
    return stored.read().select("run_id", "date", "asset", "direction", "strength", "confidence", "position_size_pct")


@query("incremental_catalog", q(f"""
SELECT {sql_day('ts')} AS date, symbol, {sql_stamp('ts')} AS ts, close FROM bars_h"""))
def incremental_catalog(inp):
    """Folders landed in two goes; the second run picks up the new ones only."""
    spark = inp.spark
    landing, table, state = (scratch_path(spark, name) for name in ("landing", "catalog", "state"))
    rows = inp.bars_h().select(day("ts").alias("date"), "symbol", "ts", "close")
    schema = "symbol string, ts timestamp_ntz, close double, date string"
    for early in (True, False):
        half = F.col("date") < "2024-01-16"
        L.write_dated(rows.filter(half if early else ~half), landing, ["date"], "parquet")
        G.catalog_new(spark, landing, table, state, schema)
    return L.read_keyed(spark, table, schema, ["symbol", "ts"]).withColumn("ts", stamp("ts"))
