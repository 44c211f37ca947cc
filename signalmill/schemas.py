"""Declared record schemas and their unique keys."""

from __future__ import annotations

PRICE_BAR = (
    "symbol string, timestamp timestamp, open double, high double, low double, "
    "close double, volume double, source string"
)
ENERGY_PRICE = "commodity string, price double, unit string, timestamp timestamp, source string"
MACRO_INDICATOR = "series_id string, name string, value double, timestamp timestamp, source string"
MARKET_SNAPSHOT = (
    "date string, source string, timestamp timestamp, prices map<string,double>, "
    "macro map<string,double>, news_count int, sentiment_score double, s3_raw_key string"
)
AGENT_SIGNAL = (
    "agent_name string, asset string, direction string, strength string, confidence double, "
    "reasoning string, timestamp timestamp, raw_data string"
)
RECOMMENDATION = (
    "asset string, direction string, strength string, confidence double, position_size_pct double, "
    "entry_rationale string, risk_notes string, contributing_agents array<string>, timestamp timestamp"
)
POSITION = (
    "symbol string, direction string, entry_price double, current_price double, size_pct double, "
    "pnl_pct double, opened_at timestamp, date string"
)
NEWS_ARTICLE = (
    "title string, description string, url string, published_at timestamp, source string, sentiment double"
)
CALL_RECORD = (
    "model_name string, timestamp string, call_id string, agent_name string, provider string, "
    "model string, prompt_tokens bigint, completion_tokens bigint, total_tokens bigint, "
    "total_ms double, ttft_ms double, tokens_per_sec double, cost_usd double, key_index int"
)
CALL_RESULT = (
    "provider string, model string, prompt_id string, prompt_tokens bigint, completion_tokens bigint, "
    "total_ms double, tokens_per_sec double, cost_usd double, response_preview string, "
    "error string, ok boolean"
)
CALL_SUMMARY = (
    "provider string, model string, label string, calls bigint, avg_ms double, median_ms double, "
    "p95_ms double, min_ms double, max_ms double, avg_tps double, std_tps double, max_tps double, "
    "std_ms double, total_cost_usd double, cost_per_1k_calls double, avg_completion_tokens double"
)
METRIC = "name string, value double, unit string, timestamp timestamp, dims map<string,string>"

# payload documents as they land
SERIES_PAYLOAD = "response struct<data: array<struct<period: string, value: string>>>"
ARTICLES_PAYLOAD = (
    "articles array<struct<title: string, description: string, url: string, "
    "publishedAt: string, source: struct<name: string>>>"
)
FUNDAMENTALS_PAYLOAD = (
    "sector string, trailingPE double, forwardPE double, enterpriseToEbitda double, "
    "dividendYield double, fiftyTwoWeekHigh double, fiftyTwoWeekLow double, marketCap double, beta double"
)

KEYS = {
    "snapshots": ("date", "source"),
    "signals": ("date", "agent_name"),
    "calls": ("model_name", "timestamp"),
    "positions": ("symbol", "date"),
}
