"""Call-log costs, statistics and rankings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import PRICE_PER_MILLION
from ..functions.numeric import half_even, half_even_sql, ratio_sql, rounded, scaled_round_sql
from ..functions.parsing import estimated_tokens_sql
from .lookups import with_prices, with_prices_per_thousand
from .order_stats import box_bounds, quantiles, ranked_values

CLOUD_PROVIDER = "groq"
MODEL = ["provider", "model"]
EXACT_COST = "CAST(sum(CAST(cost_usd AS decimal(28,8))) AS double)"
MIDDLE = {"_mid_lo": "floor((n - 1) / 2)", "_mid_hi": "floor(n / 2)"}
MEDIAN = "(_mid_lo + _mid_hi) / 2"

# decimals kept per statistic
SUMMARY_DIGITS = {
    "avg_ms": 1, "median_ms": 1, "p95_ms": 1, "min_ms": 1, "max_ms": 1, "avg_tps": 1, "std_tps": 1,
    "max_tps": 1, "std_ms": 1, "total_cost_usd": 8, "cost_per_1k_calls": 4, "avg_completion_tokens": 1,
}


def with_cost(calls: DataFrame, prices=PRICE_PER_MILLION) -> DataFrame:
    """Adds cost_usd from prices per million tokens; an unlisted model costs 0."""
    cost = "(prompt_tokens * price_in + completion_tokens * price_out) / 1000000 AS cost_usd"
    priced = with_prices(calls, prices).selectExpr(*calls.columns, cost)
    return priced.withColumn("cost_usd", half_even("cost_usd", 8))


def with_cost_per_thousand(calls: DataFrame) -> DataFrame:
    """Adds token counts and cost_usd from prices per thousand tokens.

    Expects model, prompt, answer and usage counts; a missing count is estimated from the words.
    """
    counted = calls.selectExpr(
        "*",
        f"coalesce(input_tokens, {estimated_tokens_sql('prompt')}) AS prompt_tokens",
        f"coalesce(output_tokens, {estimated_tokens_sql('answer')}) AS completion_tokens",
    )
    cost = "prompt_tokens / 1000 * price_in + completion_tokens / 1000 * price_out AS cost_usd"
    priced = with_prices_per_thousand(counted).selectExpr(*counted.columns, cost)
    return priced.withColumn("cost_usd", half_even("cost_usd", 6))


def with_throughput(calls: DataFrame, digits: int = 1) -> DataFrame:
    """Adds tokens_per_sec, 0 when no time passed."""
    raw = calls.selectExpr("*", f"{ratio_sql('completion_tokens', 'total_ms / 1000')} AS tokens_per_sec")
    return raw.withColumn("tokens_per_sec", half_even("tokens_per_sec", digits))


def with_eval_throughput(calls: DataFrame, digits: int = 1) -> DataFrame:
    """Adds eval_tokens_per_sec of a local run that reports nanoseconds in eval_ns."""
    raw = calls.selectExpr("*", f"{ratio_sql('completion_tokens', 'eval_ns / 1e9d')} AS eval_tokens_per_sec")
    return raw.withColumn("eval_tokens_per_sec", half_even("eval_tokens_per_sec", digits))


def call_records(calls: DataFrame, prices=PRICE_PER_MILLION) -> DataFrame:
    """Normalised record; absent values get their defaults."""
    defaults = {
        "provider": "'unknown'", "model": "'unknown'", "prompt_tokens": "0", "completion_tokens": "0",
        "total_tokens": "0", "total_ms": "0", "tokens_per_sec": "0", "key_index": "-1",
    }
    filled = calls.selectExpr(
        "timestamp", "call_id", "agent_name", *[f"coalesce({c}, {default}) AS {c}" for c, default in defaults.items()]
    )
    return with_cost(filled, prices).selectExpr(
        "concat(provider, '/', model) AS model_name", "timestamp", "call_id", "agent_name", "provider", "model",
        "prompt_tokens", "completion_tokens", "total_tokens", "total_ms", "total_ms AS ttft_ms", "tokens_per_sec",
        "cost_usd", "key_index",
    )


def ok_calls(calls: DataFrame) -> DataFrame:
    return calls.filter("coalesce(ok, false)")


def failed_rows(calls: DataFrame, limit: int = 120) -> DataFrame:
    """Failed calls with zeroed measures and the shortened error text."""
    measures = ("prompt_tokens", "completion_tokens", "total_ms", "tokens_per_sec", "cost_usd")
    zeros = {c: F.lit(0) for c in measures}
    return calls.filter("NOT coalesce(ok, false)").withColumns({**zeros, "error": F.substring("error", 1, limit)})


def _joined(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """NULL-safe one-to-one join of two tables with one row per group."""
    other = right.selectExpr(*[f"{k} AS _r_{k}" for k in keys], *[c for c in right.columns if c not in keys])
    same = F.expr(" AND ".join(f"{k} <=> _r_{k}" for k in keys))
    return left.join(other, same).drop(*[f"_r_{k}" for k in keys])


def raw_summary(calls: DataFrame) -> DataFrame:
    """Unrounded statistics of successful calls per provider and model."""
    ok = ok_calls(calls)
    figures = {
        "calls": "count(*)", "avg_ms": "avg(total_ms)", "min_ms": "min(total_ms)", "max_ms": "max(total_ms)",
        "avg_tps": "avg(tokens_per_sec)", "std_tps": "coalesce(stddev_samp(tokens_per_sec), 0d)",
        "max_tps": "max(tokens_per_sec)", "std_ms": "coalesce(stddev_samp(total_ms), 0d)",
        "total_cost_usd": EXACT_COST, "avg_completion_tokens": "avg(completion_tokens)",
    }
    stats = ok.groupBy(*MODEL).agg(*[F.expr(f"{text} AS {name}") for name, text in figures.items()])
    places = ranked_values(ok, MODEL, "total_ms", {**MIDDLE, "p95_ms": "floor(n * 0.95d)"})
    places = places.selectExpr(*MODEL, f"{MEDIAN} AS median_ms", "p95_ms")
    return _joined(stats, places, MODEL).selectExpr("*", "total_cost_usd / calls * 1000 AS cost_per_1k_calls")


def call_summary(calls: DataFrame) -> DataFrame:
    """The rounded summary; label is the last path part of the model, at most 25 characters."""
    label = F.expr("substring(substring_index(model, '/', -1), 1, 25) AS label")
    return raw_summary(calls).select(*MODEL, label, "calls", *rounded(SUMMARY_DIGITS))


def call_ranking(summary: DataFrame) -> DataFrame:
    """Fastest first, with the cost as shown."""
    shown = "CASE WHEN cost_per_1k_calls > 0 THEN concat('$', format_string('%.4f', cost_per_1k_calls)) ELSE 'FREE' END"
    return summary.selectExpr("*", f"{shown} AS cost_shown").orderBy("avg_ms", *MODEL)


def call_winners(summary: DataFrame, cloud: str = CLOUD_PROVIDER) -> DataFrame:
    """One row: fastest, highest throughput, cheapest cloud model; ties by provider and model name."""
    name = ", ".join(MODEL)
    is_cloud = f"provider = '{cloud}'"
    return summary.selectExpr(
        f"min_by(model, struct(avg_ms, {name})) AS fastest",
        f"min_by(model, struct(-avg_tps, {name})) AS highest_tps",
        "max(avg_tps) AS highest_tps_value",
        f"min_by(model, CASE WHEN {is_cloud} THEN struct(cost_per_1k_calls, {name}) END) AS cheapest_cloud",
        f"min(CASE WHEN {is_cloud} THEN cost_per_1k_calls END) AS cheapest_cost_per_1k",
    )


def call_dispersion(calls: DataFrame) -> DataFrame:
    """Mean, deviation and the two variation coefficients shown for a model."""
    cv = "CASE WHEN avg_ms <> 0 THEN std_ms / avg_ms * 100 ELSE 0d END AS cv"
    raw = raw_summary(calls).selectExpr(
        *MODEL, "avg_ms AS mu", "std_ms AS sigma", cv,
        f"{half_even_sql('avg_ms', 1)} AS avg_ms", f"{half_even_sql('std_ms', 1)} AS std_ms",
    ).selectExpr("*", "std_ms / greatest(avg_ms, 1d) * 100 AS cv_pct")
    whole = {c: f"format_string('%.{d}f', {half_even_sql(c, d)})" for c, d in (("mu", 0), ("sigma", 0), ("cv", 1))}
    label = f"concat('μ=', {whole['mu']}, '  σ=', {whole['sigma']}, '  CV=', {whole['cv']}, '%') AS stat_label"
    return raw.selectExpr(*MODEL, "avg_ms", "std_ms", f"{half_even_sql('cv_pct', 4)} AS cv_pct", label)


def call_efficiency(summary: DataFrame) -> DataFrame:
    """Tokens per second per dollar, or per second of latency when the model is free."""
    score = (
        "CASE WHEN cost_per_1k_calls > 0 THEN avg_tps / cost_per_1k_calls"
        " ELSE avg_tps * 1000 / greatest(avg_ms, 1d) END AS efficiency"
    )
    return summary.selectExpr(*MODEL, score).withColumn("efficiency", half_even("efficiency", 6))


def call_iqr(calls: DataFrame) -> DataFrame:
    """Quartiles picked by index, and the median."""
    found = ranked_values(ok_calls(calls), MODEL, "total_ms", {
        **MIDDLE, "p25": "greatest(0, floor(n * 0.25d) - 1)", "p75": "least(n - 1, floor(n * 0.75d))",
    })
    return found.selectExpr(*MODEL, "p25", f"{MEDIAN} AS p50", "p75", "p75 - p25 AS iqr")


def call_box(calls: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Box plot figures per group: quartiles, whiskers inside 1.5 IQR, number of outliers."""
    return box_bounds(calls, keys, value)


def dashboard_summary(calls: DataFrame, key: str = "model_name", approximate: bool = False) -> DataFrame:
    """Count, mean, interpolated p95, mean throughput and total cost per model, two digits.

    ``approximate`` trades the exact p95 for a mergeable sketch when a log is huge.
    """
    figures = {
        "calls": "count(call_id)", "avg_total_ms": "avg(total_ms)", "avg_tokens_sec": "avg(tokens_per_sec)",
        "total_cost_usd": EXACT_COST,
    }
    if approximate:
        figures["p95_total_ms"] = "percentile_approx(total_ms, 0.95, 10000)"
    stats = calls.groupBy(key).agg(*[F.expr(f"{text} AS {name}") for name, text in figures.items()])
    if not approximate:
        stats = _joined(stats, quantiles(calls, [key], "total_ms", {"p95_total_ms": 0.95}).drop("n"), [key])
    measures = ("avg_total_ms", "p95_total_ms", "avg_tokens_sec", "total_cost_usd")
    return stats.selectExpr(key, "calls", *[f"{scaled_round_sql(c, 2)} AS {c}" for c in measures])


def cost_by_agent_model(calls: DataFrame, key: str = "model_name") -> DataFrame:
    return calls.groupBy("agent_name", key).agg(F.expr(f"{EXACT_COST} AS cost_usd"))


def latency_timeline(calls: DataFrame) -> DataFrame:
    return calls.selectExpr("to_timestamp(timestamp) AS ts", "total_ms", "model_name")
