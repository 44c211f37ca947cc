"""Weighted aggregation of a run's signals into one recommendation."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import (
    AGENT_WEIGHTS, DEFAULT_ASSET, DEFAULT_WEIGHT, NO_FLAGS_TEXT, PORTFOLIO_AGENT, STRENGTH_FACTORS, WEAK_FACTOR,
)
from ..functions.lookup import quoted
from ..functions.numeric import half_even
from ..functions.parsing import position_size_of, stated_asset_sql
from ..functions.times import iso_date, iso_utc
from .lookups import with_agent_weight
from .risk import OVERRIDDEN_DIRECTION, OVERRIDDEN_STRENGTH, flag_lists
from .signals import parsed

MAX_SIZE_PCT = 20.0
SIGNAL_FIELDS = ("agent_name", "asset", "direction", "strength", "confidence")


def contribution_sql(weight: str, signal: str = "") -> str:
    """weight x sign x factor x confidence; ``signal`` prefixes the signal's fields, as in ``s.``."""
    factors = " ".join(f"WHEN '{name}' THEN {value}d" for name, value in STRENGTH_FACTORS.items())
    return (
        f"{weight} * CASE {signal}direction WHEN 'BULLISH' THEN 1d WHEN 'BEARISH' THEN -1d ELSE 0d END"
        f" * CASE {signal}strength {factors} ELSE {WEAK_FACTOR}d END * {signal}confidence"
    )


def scores(signals: DataFrame, weights: Mapping[str, float] = AGENT_WEIGHTS) -> DataFrame:
    """Weighted score per run over all its signals.

    Listed agents are added in their fixed order, so the double result does not depend on row order;
    whatever unlisted agents add comes last, summed exactly.
    """
    rows = with_agent_weight(signals, weights).selectExpr(
        "run_id", "agent_name", f"{contribution_sql('weight')} AS _part"
    )
    parts = [f"sum(CASE WHEN agent_name = {quoted([a])} THEN _part END)" for a in weights]
    unlisted = f"NOT coalesce(agent_name IN ({quoted(weights)}), false)"
    parts.append(f"CAST(sum(CASE WHEN {unlisted} THEN CAST(_part AS decimal(38,18)) END) AS double)")
    total = " + ".join(["0d", *[f"coalesce({p}, 0d)" for p in parts]])
    return rows.groupBy("run_id").agg(F.expr(f"{total} AS score")).select("run_id", half_even("score", 4).alias("score"))


# dampening by flags and size from the score, over columns score and n_flags
DAMPED = "CASE WHEN n_flags > 0 THEN score * 0.5d ELSE score END"
SIZED = f"least(abs(score) * 10, {MAX_SIZE_PCT}d)"


def run_rows(
    signals: DataFrame, weights: Mapping[str, float] = AGENT_WEIGHTS, extra: Mapping[str, str] | None = None,
) -> DataFrame:
    """One row per run with ``signals``: its agents' latest signals, listed agents in their order, then others by name.

    A pivot with one slot per listed agent: map-side combining keeps a repeated run small, and everything a run needs is
    gathered by a single shuffle. An agent without a row is simply not in the array. What distinct rows of other agents
    a run holds come together before the latest of each is taken; a run is a handful of rows.
    """
    record = f"struct({', '.join(SIGNAL_FIELDS)})"
    named = {"ts": "max(ts)", **(extra or {})}
    slots = [f"_a{i}" for i in range(len(weights))]
    for slot, agent in zip(slots, weights):
        of_agent = f"agent_name = {quoted([agent])}"
        named[slot] = f"max_by({record}, ts) FILTER (WHERE {of_agent})"
    other = f"agent_name IS NOT NULL AND agent_name NOT IN ({quoted([*weights, PORTFOLIO_AGENT])})"
    named["_others"] = f"collect_set(struct(agent_name AS a, ts AS t, {record} AS s)) FILTER (WHERE {other})"
    runs = signals.groupBy("run_id").agg(*[F.expr(f"{text} AS {name}") for name, text in named.items()])
    names = "array_sort(array_distinct(transform(_others, o -> o.a)))"
    others = f"transform({names}, a -> array_max(filter(_others, o -> o.a = a)).s)"
    return runs.withColumn("signals", F.expr(f"concat(array_compact(array({', '.join(slots)})), {others})")).drop(*slots, "_others")


def common_asset_sql(signals: str = "signals") -> str:
    """Most frequent asset of a run's signals, the first seen among equals."""
    ranked = (
        f"transform({signals}, (s, i) -> named_struct("
        f"'count', size(filter({signals}, other -> other.asset = s.asset)), 'place', -i, 'asset', s.asset))"
    )
    return f"coalesce(array_max({ranked}).asset, '{DEFAULT_ASSET}')"


def score_sql(weights: Mapping[str, float] = AGENT_WEIGHTS, signals: str = "signals") -> str:
    """The unrounded score of a run's signal array, added in array order."""
    cases = " ".join(f"WHEN {quoted([a])} THEN {w}d" for a, w in weights.items())
    part = contribution_sql(f"CASE s.agent_name {cases} ELSE {DEFAULT_WEIGHT}d END", "s.")
    return f"aggregate({signals}, 0d, (total, s) -> total + {part})"


def run_decisions(
    responses: DataFrame,
    flags: DataFrame,
    best_asset: DataFrame | None = None,
    social_direction: DataFrame | None = None,
    weights: Mapping[str, float] = AGENT_WEIGHTS,
    key: str = "portfolio_id",
    market_flags: DataFrame | None = None,
) -> DataFrame:
    """The whole chain over all runs: texts, flags and market evidence to one recommendation per run.

    ``responses`` holds the agents' texts and, as agent PortfolioManager, the final answer.
    ``flags`` are risk flag rows per portfolio; ``market_flags`` (flag_order, symbol, flag) hold for every run, also one
    without portfolio or positions, and come first. ``best_asset`` and ``social_direction`` (direction) are one-row
    tables. Each of the four may instead hold rows per date ``d``: a run then sees those of its own date.
    A run without any specialist row gives no recommendation; a missing agent is left out.
    """
    answer = "max_by(struct(response_text, direction, strength, confidence), ts)"
    runs = run_rows(parsed(responses), weights, {
        key: f"max({key})", "answer": f"{answer} FILTER (WHERE agent_name = '{PORTFOLIO_AGENT}')",
    })
    runs = runs.filter("size(signals) > 0 AND answer IS NOT NULL").withColumn("d", F.to_date("ts"))
    lists = flag_lists(flags, key)
    runs = runs.join(lists, [c for c in (key, "d") if c in lists.columns], "left")
    runs = _with_market_flags(runs, market_flags)
    runs = _with_context(runs, best_asset, "best_asset")
    if social_direction is not None:
        social_direction = social_direction.withColumnRenamed("direction", "social_direction")
    runs = _with_context(runs, social_direction, "social_direction")
    return recommended(runs.withColumn("n_flags", F.expr("coalesce(n_flags, 0)")), key, weights)


def _with_market_flags(runs: DataFrame, market_flags: DataFrame | None) -> DataFrame:
    """Puts the market's flags before the run's own; n_flags counts both, flags is NULL if there are none."""
    if market_flags is None:
        return runs
    listed = F.expr("transform(sort_array(collect_list(struct(flag_order, symbol, flag))), f -> f.flag) AS _market")
    if "d" in market_flags.columns:
        runs = runs.join(market_flags.groupBy("d").agg(listed), "d", "left")
    else:
        runs = runs.withColumn("_market", market_flags.agg(listed).scalar())
    runs = runs.withColumn("_all", F.expr("concat(coalesce(_market, array()), coalesce(flags, array()))"))
    counted = {"n_flags": F.size("_all").cast("long"), "flags": F.expr("CASE WHEN size(_all) > 0 THEN _all END")}
    return runs.withColumns(counted).drop("_market", "_all")


def _with_context(runs: DataFrame, context: DataFrame | None, name: str) -> DataFrame:
    """Adds the column ``name``: of the run's date, of the only row, or NULL without a context."""
    if context is None:
        return runs.withColumn(name, F.lit(None).cast("string"))
    if "d" in context.columns:
        return runs.join(context.select("d", name), "d", "left")
    return runs.withColumn(name, context.select(name).scalar())


def recommended(runs: DataFrame, key: str, weights: Mapping[str, float] = AGENT_WEIGHTS) -> DataFrame:
    """Score, size and final answer per run row (signals, answer, n_flags, flags, best_asset, social_direction)."""
    asset = (
        "CASE s.agent_name WHEN 'TechnicalAnalyst' THEN coalesce(best_asset, s.asset)"
        f" WHEN 'SentimentAgent' THEN '{DEFAULT_ASSET}' WHEN 'RiskManager' THEN '{DEFAULT_ASSET}' ELSE s.asset END"
    )
    direction = (
        f"CASE WHEN s.agent_name = 'RiskManager' THEN {OVERRIDDEN_DIRECTION.format(parsed='s.direction')}"
        " WHEN s.agent_name = 'SentimentAgent' AND s.direction = 'NEUTRAL'"
        " THEN coalesce(social_direction, s.direction) ELSE s.direction END"
    )
    strength = (
        f"CASE WHEN s.agent_name = 'RiskManager' THEN {OVERRIDDEN_STRENGTH.format(parsed='s.strength')} ELSE s.strength END"
    )
    overridden = (
        f"transform(signals, s -> named_struct('agent_name', s.agent_name, 'asset', {asset},"
        f" 'direction', {direction}, 'strength', {strength}, 'confidence', s.confidence))"
    )
    # every step names its result: a later expression uses it several times
    runs = runs.withColumn("signals", F.expr(overridden)).withColumn("raw_score", F.expr(score_sql(weights)))
    runs = runs.withColumn("raw_score", half_even("raw_score", 4))
    runs = runs.withColumn("score", F.expr(DAMPED.replace("score", "raw_score")))
    runs = runs.withColumn("suggested_size_pct", F.expr(SIZED))
    runs = runs.withColumn("_upper", F.upper("answer.response_text"))
    text = "answer.response_text"
    return runs.select(
        "run_id", key, "ts", "signals", "n_flags", "flags", "raw_score", "score", "suggested_size_pct",
        iso_date("ts").alias("date"),
        F.expr(f"coalesce({stated_asset_sql('_upper')}, {common_asset_sql()}) AS asset"),
        "answer.direction", "answer.strength", "answer.confidence",
        position_size_of("_upper", "suggested_size_pct").alias("position_size_pct"),
        F.col(text).alias("entry_rationale"),
        F.expr(f"coalesce(array_join(flags, ', '), '{NO_FLAGS_TEXT}') AS risk_notes"),
        F.expr("transform(signals, s -> s.agent_name) AS contributing_agents"),
    )


def run_summaries(decisions: DataFrame) -> DataFrame:
    """The stored document of a run: its signals and its recommendation."""
    fields = ", ".join(f"'{c}', s.{c}" for c in SIGNAL_FIELDS)
    stamped = decisions.withColumn("timestamp", iso_utc("ts"))
    document = (
        "to_json(named_struct('run_id', run_id, 'run_timestamp', timestamp,"
        f" 'signals', transform(signals, s -> named_struct({fields}, 'timestamp', timestamp)),"
        " 'recommendation', struct(asset, direction, strength, confidence, position_size_pct, entry_rationale,"
        " risk_notes, contributing_agents, timestamp)))"
    )
    return stamped.selectExpr("run_id", "date", f"{document} AS body")


def strong_only(decisions: DataFrame) -> DataFrame:
    return decisions.filter("strength = 'STRONG'")


def notifications(decisions: DataFrame) -> DataFrame:
    """Subject and JSON message of every STRONG recommendation."""
    body = (
        "to_json(struct(asset, direction, strength, confidence, position_size_pct, entry_rationale, risk_notes,"
        " contributing_agents, date))"
    )
    return strong_only(decisions).selectExpr(
        "run_id", "concat('STRONG ', direction, ' signal: ', asset) AS subject", f"{body} AS message"
    )


def latest_recommendation(records: DataFrame, agent: str = PORTFOLIO_AGENT) -> DataFrame:
    """The newest row of the portfolio agent: one row, found by a partial aggregate."""
    newest = F.expr("max_by(struct(*), struct(timestamp, run_id)) AS r")
    return records.filter(F.col("agent_name") == agent).agg(newest).filter("r IS NOT NULL").select("r.*")


def asset_votes(signals: DataFrame) -> DataFrame:
    """The fallback asset of every run."""
    return run_rows(signals).selectExpr("run_id", f"{common_asset_sql()} AS asset")
