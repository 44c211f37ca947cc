"""Response texts to signal rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import AGENT_WEIGHTS, DEFAULT_ASSET, DIRECTIONS, STRENGTHS
from ..functions import parsing as P
from ..functions.lookup import quoted
from ..functions.times import iso_date, iso_utc
from .risk import OVERRIDDEN_DIRECTION, OVERRIDDEN_STRENGTH, flag_counts
from .sentiment import directed

AGENTS = tuple(AGENT_WEIGHTS)


def parsed(responses: DataFrame) -> DataFrame:
    """Adds direction, strength, confidence and asset read from response_text."""
    return responses.withColumn("_upper", F.upper("response_text")).select(
        *responses.columns,
        P.direction_of("_upper").alias("direction"),
        P.strength_of("_upper").alias("strength"),
        P.confidence_of("_upper").alias("confidence"),
        P.asset_of("_upper").alias("asset"),
    )


def signal_records(signals: DataFrame) -> DataFrame:
    """Stored form: ISO timestamp, its UTC date as key, evidence as JSON text."""
    evidence = "raw_data" if "raw_data" in signals.columns else "to_json(struct(direction, strength, confidence)) AS raw_data"
    return signals.select(
        "run_id", "agent_name", "asset", "direction", "strength", "confidence",
        F.col("response_text").alias("reasoning"), iso_utc("ts").alias("timestamp"), iso_date("ts").alias("date"),
        F.expr(evidence),
    )


def agent_rows(responses: DataFrame, agent: str) -> DataFrame:
    return parsed(responses.filter(F.col("agent_name") == agent))


def market_signal(responses: DataFrame, snapshot: DataFrame | None = None) -> DataFrame:
    """Market agent rows; ``snapshot`` is a one-row table with the prices and macro maps kept as evidence."""
    rows = agent_rows(responses, "MarketDataAgent")
    if snapshot is None:
        return rows
    return rows.withColumn("raw_data", snapshot.selectExpr("max(to_json(struct(prices, macro)))").scalar())


def technical_signal(responses: DataFrame, best_asset: DataFrame) -> DataFrame:
    """Technical agent rows; the asset is the best scored one, whatever the text names."""
    return agent_rows(responses, "TechnicalAnalyst").withColumn("asset", best_asset.scalar())


def sentiment_signal(responses: DataFrame, margin: DataFrame) -> DataFrame:
    """Sentiment agent rows; a NEUTRAL text falls back to the one-row ``margin`` direction."""
    fallback = margin.select("direction").scalar()
    return agent_rows(responses, "SentimentAgent").withColumns(
        {"direction": directed(F.col("direction"), fallback), "asset": F.lit(DEFAULT_ASSET)}
    )


def risk_signal(responses: DataFrame, flags: DataFrame, key: str = "portfolio_id") -> DataFrame:
    """Risk agent rows; active flags of the run's portfolio override direction and strength."""
    rows = agent_rows(responses, "RiskManager").join(flag_counts(flags, key), key, "left")
    return rows.withColumn("n_flags", F.expr("coalesce(n_flags, 0)")).withColumns({
        "direction": F.expr(OVERRIDDEN_DIRECTION.format(parsed="direction")),
        "strength": F.expr(OVERRIDDEN_STRENGTH.format(parsed="strength")),
        "asset": F.lit(DEFAULT_ASSET),
    })


def with_reasons(rows: DataFrame) -> DataFrame:
    """Adds reasons: what is wrong with a row; empty for a good one."""
    def one_of(column: str, values) -> str:
        return f"coalesce({column} IN ({quoted(values)}), false)"

    checks = {
        "agent_name missing": "agent_name IS NULL",
        "asset missing": "asset IS NULL",
        "direction invalid": f"NOT {one_of('direction', DIRECTIONS)}",
        "strength invalid": f"NOT {one_of('strength', STRENGTHS)}",
        "confidence outside 0..1": "NOT coalesce(confidence BETWEEN 0 AND 1, false)",
    }
    if "position_size_pct" in rows.columns:
        checks["position size outside 0..100"] = "NOT coalesce(position_size_pct BETWEEN 0 AND 100, false)"
    found = ", ".join(f"CASE WHEN {bad} THEN '{reason}' END" for reason, bad in checks.items())
    return rows.selectExpr("*", f"array_compact(array({found})) AS reasons")


def validated(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good rows, rejected rows with reasons)."""
    checked = with_reasons(rows)
    return checked.filter("size(reasons) = 0").drop("reasons"), checked.filter("size(reasons) > 0")


AgentFunction = Callable[..., DataFrame]
_registry: dict[str, AgentFunction] = {}


def register_agent(name: str, function: AgentFunction) -> None:
    """An agent turns the responses of its runs, and what evidence it is given by name, into signal rows."""
    _registry[name] = function


def agent_registry() -> dict[str, AgentFunction]:
    return dict(_registry)


def run_agent(name: str, context: DataFrame, **evidence) -> DataFrame:
    """The named agent over ``context``; evidence (such as ``best_asset``) goes to the agent as it is."""
    if name not in _registry:
        raise ValueError(f"Unknown agent: {name}. Valid: {sorted(_registry)}")
    return context.transform(_registry[name], **evidence)


def _with_evidence(agent: str, full: AgentFunction) -> AgentFunction:
    """The full agent when it is given its evidence, else what its text says."""
    return lambda responses, *given, **named: full(responses, *given, **named) if given or named else agent_rows(responses, agent)


register_agent("market_data", _with_evidence("MarketDataAgent", market_signal))
register_agent("technical", _with_evidence("TechnicalAnalyst", technical_signal))
register_agent("sentiment", _with_evidence("SentimentAgent", sentiment_signal))
register_agent("risk", _with_evidence("RiskManager", risk_signal))
register_agent("portfolio", lambda responses: agent_rows(responses, "PortfolioManager"))
