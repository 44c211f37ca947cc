"""Call-log costs, statistics and rankings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..constants import PRICE_PER_THOUSAND
from ..functions.numeric import rounded
from ..operators import calls as C
from ..operators import lookups as J
from ..operators import tables as T
from .bindings import CALL_PRICES
from .oracle_views import VIEWS, half_even, q
from .registry import query, sql_stamp, stamp

VIEWS["ok_calls"] = "SELECT * FROM calls WHERE ok"
VIEWS["placed"] = """
SELECT provider, model, total_ms, row_number() OVER (PARTITION BY provider, model ORDER BY total_ms) - 1 AS place,
       count(*) OVER (PARTITION BY provider, model) AS n FROM ok_calls"""
VIEWS["places"] = """
SELECT provider, model, max(CASE WHEN place = floor(n * 0.95::DOUBLE) THEN total_ms END) AS p95,
       (max(CASE WHEN place = floor((n - 1) / 2) THEN total_ms END) + max(CASE WHEN place = floor(n / 2) THEN total_ms END)) / 2 AS median,
       max(CASE WHEN place = greatest(0, floor(n * 0.25::DOUBLE) - 1) THEN total_ms END) AS p25,
       max(CASE WHEN place = least(n - 1, floor(n * 0.75::DOUBLE)) THEN total_ms END) AS p75
FROM placed GROUP BY provider, model"""
VIEWS["sum0"] = """
SELECT provider, model, count(*) AS calls, avg(total_ms) AS a_ms, min(total_ms) AS lo_ms, max(total_ms) AS hi_ms,
       avg(tokens_per_sec) AS a_tps, coalesce(stddev_samp(tokens_per_sec), 0) AS s_tps, max(tokens_per_sec) AS hi_tps,
       coalesce(stddev_samp(total_ms), 0) AS s_ms, CAST(sum(CAST(cost_usd AS DECIMAL(28,8))) AS DOUBLE) AS cost,
       CAST(sum(CAST(cost_usd AS DECIMAL(28,8))) AS DOUBLE) / count(*) * 1000 AS per_1k, avg(completion_tokens) AS a_tok
FROM ok_calls GROUP BY provider, model"""
VIEWS["call_sum"] = f"""
SELECT provider, model, substr(split_part(model, '/', -1), 1, 25) AS label, calls, {half_even('a_ms', 1)} AS avg_ms,
       {half_even('median', 1)} AS median_ms, {half_even('p95', 1)} AS p95_ms, {half_even('lo_ms', 1)} AS min_ms,
       {half_even('hi_ms', 1)} AS max_ms, {half_even('a_tps', 1)} AS avg_tps, {half_even('s_tps', 1)} AS std_tps,
       {half_even('hi_tps', 1)} AS max_tps, {half_even('s_ms', 1)} AS std_ms, {half_even('cost', 8)} AS total_cost_usd,
       {half_even('per_1k', 4)} AS cost_per_1k_calls, {half_even('a_tok', 1)} AS avg_completion_tokens, a_ms, s_ms
FROM sum0 JOIN places USING (provider, model)"""
SUMMARY = "* EXCLUDE (a_ms, s_ms)"


@query("join_pricing", q("""
SELECT call_id, model, coalesce(price_in, 0) AS price_in, coalesce(price_out, 0) AS price_out FROM calls0 LEFT JOIN prices USING (model)"""))
def join_pricing(inp):
    return J.with_prices(inp.calls(), CALL_PRICES).select("call_id", "model", "price_in", "price_out")


LANG_MODEL = {"en": "amazon.titan-text-express-v1", "de": "anthropic.claude-v2", "fr": "meta.llama3-8b-instruct-v1:0"}
VIEWS["k_prices"] = "SELECT * FROM (VALUES " + ", ".join(
    f"('{m}', {i}::DOUBLE, {o}::DOUBLE)" for m, (i, o) in PRICE_PER_THOUSAND.items()
) + ") t(model, price_in, price_out)"
VIEWS["doc_calls"] = """
SELECT doc_id, CASE lang WHEN 'en' THEN 'amazon.titan-text-express-v1' WHEN 'de' THEN 'anthropic.claude-v2'
                WHEN 'fr' THEN 'meta.llama3-8b-instruct-v1:0' ELSE 'other' END AS model,
       CASE WHEN lang = 'de' THEN n_chars ELSE len(list_filter(string_split_regex(text, '\\s+'), lambda w: w <> '')) * 4 // 3 END AS prompt_tokens,
       n_chars // 10 AS completion_tokens FROM documents"""
VIEWS["doc_cost"] = """
SELECT doc_id, d.model, prompt_tokens, completion_tokens, coalesce(price_in, 0.001::DOUBLE) AS price_in, coalesce(price_out, 0.002::DOUBLE) AS price_out,
       prompt_tokens / 1000 * coalesce(price_in, 0.001::DOUBLE) + completion_tokens / 1000 * coalesce(price_out, 0.002::DOUBLE) AS cost
FROM doc_calls d LEFT JOIN k_prices p ON p.model = d.model"""


def document_calls(inp):
    lang = F.col("lang")
    model = F.lit("other")
    for code, name in LANG_MODEL.items():
        model = F.when(lang == code, name).otherwise(model)
    return inp.table("documents").select(
        "doc_id", model.alias("model"), F.col("text").alias("prompt"), F.lit("").alias("answer"),
        F.when(lang == "de", F.col("n_chars")).alias("input_tokens"),
        F.call_function("div", F.col("n_chars"), F.lit(10)).alias("output_tokens"),
    )


@query("join_pricing_1k", q("SELECT doc_id, model, price_in, price_out FROM doc_cost"))
def join_pricing_1k(inp):
    return J.with_prices_per_thousand(document_calls(inp)).select("doc_id", "model", "price_in", "price_out")


@query("call_cost", q("SELECT call_id, cost_usd FROM calls"))
def call_cost(inp):
    return inp.calls().select("call_id", "cost_usd")


@query("call_cost_1k", q(f"SELECT doc_id, prompt_tokens, completion_tokens, {half_even('cost', 6)} AS cost_usd FROM doc_cost"))
def call_cost_1k(inp):
    return C.with_cost_per_thousand(document_calls(inp)).select("doc_id", "prompt_tokens", "completion_tokens", "cost_usd")


@query("call_throughput", q(f"""
SELECT call_id, tokens_per_sec, {half_even('tps_ns', 1)} AS eval_tokens_per_sec
FROM (SELECT *, CASE WHEN call_id % 7 = 0 THEN 0 ELSE completion_tokens / (completion_tokens * 1000 / 1e9::DOUBLE) END AS tps_ns FROM calls)"""))
def call_throughput(inp):
    calls = inp.calls().selectExpr("*", "CASE WHEN call_id % 7 = 0 THEN 0 ELSE completion_tokens * 1000 END AS eval_ns")
    return C.with_eval_throughput(calls).select("call_id", "tokens_per_sec", "eval_tokens_per_sec")


@query("call_record", q("""
SELECT concat(CASE WHEN agent_name = 'agent0' THEN 'unknown' ELSE provider END, '/', model) AS model_name, CAST(call_id AS VARCHAR) AS call_id,
       agent_name, CASE WHEN agent_name = 'agent0' THEN 'unknown' ELSE provider END AS provider, model, prompt_tokens, completion_tokens,
       CASE WHEN agent_name = 'agent1' THEN 0 ELSE prompt_tokens + completion_tokens END AS total_tokens, total_ms, total_ms AS ttft_ms,
       tokens_per_sec, cost_usd, CAST(-1 AS INT) AS key_index FROM calls"""))
def call_record(inp):
    """Records of a log in which some fields were never reported."""
    agent = F.col("agent_name")
    raw = inp.calls().drop("cost_usd", "model_name").withColumns({
        "provider": F.when(agent != "agent0", F.col("provider")),
        "total_tokens": F.when(agent != "agent1", F.col("prompt_tokens") + F.col("completion_tokens")),
        "key_index": F.lit(None).cast("int"),
        "call_id": F.col("call_id").cast("string"),
        "timestamp": stamp("ts"),
    })
    return C.call_records(raw, CALL_PRICES).drop("timestamp")


@query("filter_ok_calls", q("SELECT call_id, total_ms FROM calls WHERE ok"))
def filter_ok_calls(inp):
    return C.ok_calls(inp.calls()).select("call_id", "total_ms")


@query("failed_call_rows", q("""
SELECT call_id, CAST(0 AS INTEGER) AS total_ms, CAST(0 AS INTEGER) AS cost_usd, substr(repeat(model, 40), 1, 120) AS error FROM calls WHERE NOT ok"""))
def failed_call_rows(inp):
    failed = C.failed_rows(inp.calls().withColumn("error", F.expr("repeat(model, 40)")))
    return failed.select("call_id", "total_ms", "cost_usd", "error")


@query("call_summary", q(f"SELECT {SUMMARY} FROM call_sum"))
def call_summary(inp):
    return C.call_summary(inp.calls())


@query("call_ranking", q(f"""
SELECT {SUMMARY}, CASE WHEN cost_per_1k_calls > 0 THEN concat('$', printf('%.4f', cost_per_1k_calls)) ELSE 'FREE' END AS cost_shown FROM call_sum"""))
def call_ranking(inp):
    return C.call_ranking(C.call_summary(inp.calls()))


@query("call_winners", q("""
SELECT (SELECT model FROM call_sum ORDER BY avg_ms, provider, model LIMIT 1) AS fastest,
       (SELECT model FROM call_sum ORDER BY avg_tps DESC, provider, model LIMIT 1) AS highest_tps, max(avg_tps) AS highest_tps_value,
       (SELECT model FROM call_sum WHERE provider = 'groq' ORDER BY cost_per_1k_calls, provider, model LIMIT 1) AS cheapest_cloud,
       min(CASE WHEN provider = 'groq' THEN cost_per_1k_calls END) AS cheapest_cost_per_1k FROM call_sum"""))
def call_winners(inp):
    return C.call_winners(C.call_summary(inp.calls()))


@query("call_dispersion", q(f"""
SELECT provider, model, avg_ms, std_ms, {half_even('(std_ms / greatest(avg_ms, 1.0::DOUBLE) * 100)', 4)} AS cv_pct,
       concat('μ=', printf('%.0f', {half_even('a_ms', 0)}), '  σ=', printf('%.0f', {half_even('s_ms', 0)}), '  CV=',
              printf('%.1f', {half_even('(s_ms / a_ms * 100)', 1)}), '%') AS stat_label FROM call_sum"""))
def call_dispersion(inp):
    return C.call_dispersion(inp.calls())


@query("call_efficiency", q(f"""
SELECT provider, model, {half_even('score', 6)} AS efficiency FROM (SELECT *, CASE WHEN cost_per_1k_calls > 0 THEN avg_tps / cost_per_1k_calls
       ELSE avg_tps * 1000 / greatest(avg_ms, 1.0::DOUBLE) END AS score FROM call_sum)"""))
def call_efficiency(inp):
    return C.call_efficiency(C.call_summary(inp.calls()))


@query("call_iqr_index", q("SELECT provider, model, p25, median AS p50, p75, p75 - p25 AS iqr FROM places"))
def call_iqr_index(inp):
    return C.call_iqr(inp.calls())


VIEWS["box0"] = """
SELECT model_name, quantile_cont(total_ms, 0.25) AS q1, quantile_cont(total_ms, 0.5) AS median, quantile_cont(total_ms, 0.75) AS q3 FROM calls GROUP BY model_name"""
VIEWS["box"] = """
SELECT model_name, count(*) AS n, any_value(q1) AS q1, any_value(median) AS median, any_value(q3) AS q3,
       least(min(CASE WHEN total_ms >= q1 - 1.5 * (q3 - q1) THEN total_ms END), any_value(q1)) AS whisker_low,
       greatest(max(CASE WHEN total_ms <= q3 + 1.5 * (q3 - q1) THEN total_ms END), any_value(q3)) AS whisker_high,
       count_if(total_ms < q1 - 1.5 * (q3 - q1) OR total_ms > q3 + 1.5 * (q3 - q1)) AS outliers
FROM calls JOIN box0 USING (model_name) GROUP BY model_name"""


@query("call_box_stats", q(f"""
SELECT model_name, n, {half_even('q1', 6)} AS q1, {half_even('median', 6)} AS median, {half_even('q3', 6)} AS q3,
       {half_even('whisker_low', 6)} AS whisker_low, {half_even('whisker_high', 6)} AS whisker_high, CAST(outliers AS BIGINT) AS outliers FROM box"""))
def call_box_stats(inp):
    rows = C.call_box(inp.calls(), ["model_name"], "total_ms")
    shown = ("q1", "median", "q3", "whisker_low", "whisker_high")
    return rows.select("model_name", "n", *rounded({c: 6 for c in shown}), "outliers")


VIEWS["dash_placed"] = """
SELECT *, row_number() OVER (PARTITION BY model_name ORDER BY total_ms) - 1 AS place,
       (count(*) OVER (PARTITION BY model_name) - 1) * 0.95::DOUBLE AS "at" FROM calls"""
VIEWS["dash0"] = """
SELECT model_name, count(call_id) AS calls, avg(total_ms) AS a_ms, avg(tokens_per_sec) AS a_tps, max("at") - floor(max("at")) AS t,
       max(CASE WHEN place = floor("at") THEN total_ms END) AS lo, max(CASE WHEN place = ceil("at") THEN total_ms END) AS hi,
       CAST(sum(CAST(cost_usd AS DECIMAL(28,8))) AS DOUBLE) AS cost FROM dash_placed GROUP BY model_name"""
VIEWS["dash1"] = "SELECT *, CASE WHEN t >= 0.5 THEN hi - (hi - lo) * (1 - t) ELSE lo + (hi - lo) * t END AS p95 FROM dash0"


def _two(column: str) -> str:
    return f"round_even({column} * 100, 0) / 100"


@query("call_dashboard_summary", q(f"""
SELECT model_name, calls, {_two('a_ms')} AS avg_total_ms, {_two('p95')} AS p95_total_ms,
       {_two('a_tps')} AS avg_tokens_sec, {_two('cost')} AS total_cost_usd FROM dash1"""))
def call_dashboard_summary(inp):
    return C.dashboard_summary(inp.calls())


@query("cost_agent_model", q("""
SELECT agent_name, model_name, CAST(sum(CAST(cost_usd AS DECIMAL(28,8))) AS DOUBLE) AS cost_usd FROM calls GROUP BY ALL"""))
def cost_agent_model(inp):
    return C.cost_by_agent_model(inp.calls())


@query("latency_timeline", q(f"SELECT {sql_stamp('ts')} AS ts, total_ms, model_name FROM calls"))
def latency_timeline(inp):
    rows = inp.calls().withColumn("timestamp", stamp("ts"))
    return C.latency_timeline(rows).withColumn("ts", stamp("ts"))


@query("sql_model_latency_cost", q("""
SELECT model_name, round(avg(total_ms), 0) AS avg_latency_ms, round(avg(cost_usd), 6) AS avg_cost_usd FROM calls GROUP BY model_name"""))
def sql_model_latency_cost(inp):
    return T.model_latency_cost_sql(inp.calls())
