"""The same bindings as SQL text for the comparison engine."""

from __future__ import annotations

import re

from .bindings import CALL_PRICES

VIEWS: dict[str, str] = {}


def half_even(value: str, digits: int) -> str:
    """Rounding of the binary value, ties to even, with exact error of the scaled product.

    ``value`` should be a plain column: it is repeated.
    """
    s = f"CAST({10**digits} AS DOUBLE)"
    v = f"CAST({value} AS DOUBLE)"
    hi = f"({v} * 134217729.0::DOUBLE - ({v} * 134217729.0::DOUBLE - {v}))"
    p = f"({v} * {s})"
    err = f"(({hi} * {s} - {p}) + ({v} - {hi}) * {s})"
    above = f"(({p} - floor({p}) - 0.5::DOUBLE) + {err})"
    odd = f"(floor({p}) - 2 * floor(floor({p}) / 2) = 1)"
    step = f"CASE WHEN {above} > 0 OR ({above} = 0 AND {odd}) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END"
    return f"(CASE WHEN abs({v}) * {s} < 4503599627370496.0 THEN (floor({p}) + {step}) / {s} ELSE {v} END)"


def fixed(value: str, digits: int) -> str:
    return f"printf('%.{digits}f', {half_even(value, digits)})"


def q(body: str, **local: str) -> str:
    """``body`` behind the CTEs it mentions, directly or through other CTEs; ``local`` adds its own."""
    views = {**VIEWS, **local}
    needed: list[str] = []

    def need(text: str, self_name: str | None = None) -> None:
        for name, definition in views.items():
            if name != self_name and name not in needed and re.search(rf"\b{name}\b", text):
                need(definition, name)
                needed.append(name)

    need(body)
    if not needed:
        return body
    ctes = ",\n".join(f"{name} AS ({views[name]})" for name in needed)
    return f"WITH RECURSIVE {ctes}\n{body}"


VIEWS["bars_h"] = """
SELECT event_type AS symbol, date_trunc('hour', ts) AS ts, min_by(value, ts) AS open, max(value) AS high,
       min(value) AS low, max_by(value, ts) AS close, count(*) AS volume
FROM events GROUP BY ALL"""
VIEWS["bars_d"] = """
SELECT o_orderpriority AS symbol, CAST(o_orderdate AS DATE) AS d, max(o_totalprice) AS close, count(*) AS volume
FROM orders GROUP BY ALL"""
VIEWS["obs"] = """
SELECT concat(l_returnflag, l_linestatus) AS series_id, CAST(l_shipdate AS DATE) AS d, max(l_extendedprice) AS value
FROM lineitem GROUP BY ALL"""
VIEWS["gen_mix"] = """
SELECT l_linestatus AS zone, CAST(l_shipdate AS DATE) AS d, l_returnflag AS fuel, sum(l_quantity) AS mw
FROM lineitem GROUP BY ALL"""
VIEWS["responses"] = """
SELECT CAST(floor(event_id / 4) AS BIGINT) AS run_id,
       CASE event_id % 4 WHEN 0 THEN 'MarketDataAgent' WHEN 1 THEN 'TechnicalAnalyst'
                         WHEN 2 THEN 'SentimentAgent' ELSE 'RiskManager' END AS agent_name,
       ts,
       concat('DIRECTION: ', CASE event_type WHEN 'click' THEN 'BULLISH' WHEN 'purchase' THEN 'bullish bias'
                 WHEN 'error' THEN 'BEARISH' WHEN 'view' THEN 'sell' ELSE 'NEUTRAL' END, chr(10),
              'STRENGTH: ', CASE user_id % 3 WHEN 0 THEN 'STRONG' WHEN 1 THEN 'MODERATE' ELSE 'WEAK' END, chr(10),
              CASE WHEN user_id % 10 = 0 THEN 'about ' ELSE 'CONFIDENCE: ' END,
              CAST(CAST(floor(value) AS INT) % 120 AS VARCHAR), CASE WHEN user_id % 10 = 1 THEN '' ELSE '%' END, chr(10),
              'ASSET: ', CASE user_id % 5 WHEN 0 THEN 'WTI' WHEN 1 THEN 'XLE (not USO)' WHEN 2 THEN 'none'
                 WHEN 3 THEN 'USO or NATGAS' ELSE 'cvx' END, chr(10),
              CASE WHEN user_id % 2 = 0 THEN concat('POSITION_SIZE: ', CAST(user_id % 30 AS VARCHAR), '%', chr(10)) ELSE '' END,
              'REASONING: text ', CAST(event_id AS VARCHAR)) AS response_text,
       CAST(CAST(floor(event_id / 4) AS BIGINT) % 25 AS INTEGER) AS portfolio_id
FROM events"""
VIEWS["answers"] = """
SELECT run_id, 'PortfolioManager' AS agent_name, max(ts) AS ts,
       CASE WHEN run_id % 3 = 0 THEN replace(max_by(response_text, ts), 'ASSET:', 'Asset -')
            ELSE max_by(response_text, ts) END AS response_text, portfolio_id
FROM responses GROUP BY run_id, portfolio_id"""
VIEWS["prices"] = "SELECT * FROM (VALUES " + ", ".join(
    f"('{m}', {i}::DOUBLE, {o}::DOUBLE)" for m, (i, o) in CALL_PRICES.items()
) + ") t(model, price_in, price_out)"
VIEWS["calls0"] = """
SELECT event_id AS call_id, ts, CASE WHEN event_type IN ('view','click') THEN 'ollama' ELSE 'groq' END AS provider,
       event_type AS model, concat('agent', CAST(user_id % 4 AS VARCHAR)) AS agent_name,
       user_id + 50 AS prompt_tokens, CAST(floor(value) AS BIGINT) + 1 AS completion_tokens,
       value * 10 + 1 AS total_ms, (event_id % 17 <> 0) AS ok
FROM events"""
VIEWS["calls1"] = """
SELECT c.*, completion_tokens / (total_ms / 1000) AS tps0,
       (prompt_tokens * coalesce(price_in, 0) + completion_tokens * coalesce(price_out, 0)) / 1000000 AS cost0
FROM calls0 c LEFT JOIN prices USING (model)"""
VIEWS["calls"] = f"""
SELECT * EXCLUDE (tps0, cost0), {half_even('tps0', 1)} AS tokens_per_sec, {half_even('cost0', 8)} AS cost_usd,
       concat(provider, '/', model) AS model_name
FROM calls1"""
VIEWS["posts"] = """
SELECT doc_id, lang AS query, source AS "group", split_part(text, chr(10), 1) AS title,
       CASE WHEN strpos(text, chr(10)) > 0 THEN substr(text, strpos(text, chr(10)) + 1) END AS description,
       concat('https://example.invalid/', CAST(doc_id % 700 AS VARCHAR)) AS url, n_chars AS score,
       788918400 + doc_id * 7200 AS created_utc
FROM documents"""
VIEWS["positions"] = """
SELECT c_nationkey AS portfolio_id, c_mktsegment AS symbol, ((min(c_custkey) * 7) % 37) * 0.75::DOUBLE AS size_pct
FROM customer GROUP BY ALL"""
VIEWS["metrics"] = """
SELECT ts, CASE event_type WHEN 'error' THEN 'IngestionFailures' WHEN 'signup' THEN 'ThrottleCount'
              WHEN 'purchase' THEN 'SignalsEmitted' ELSE 'AgentLatencyMs' END AS metric,
       CASE WHEN event_type IN ('view','click') THEN value ELSE 1.0::DOUBLE END AS value,
       concat('agent', CAST(user_id % 5 AS VARCHAR)) AS agent
FROM events"""
