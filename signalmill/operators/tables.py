"""Keyed tables: upsert, look-ups, retention, and the SQL reports over them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.times import AsOf, days_before


def last_write(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key, the last written replacing the whole earlier row.

    A partial aggregate: a key written a billion times still sends one row per task. Keys are the grouping columns, so a
    filter on a key passes below the aggregate to folders and scan.

    An aggregate of whole rows sorts what its task reads, and a task may read many stored files. So rows are first dealt into
    pieces of the advisory partition size, by key and order: a key with many writes is split, too.
    """
    rest = [c for c in rows.columns if c not in keys]
    if not rest:
        return rows.select(*keys).distinct()
    newest = F.max_by(F.struct(*rest), F.struct(*order)).alias("_row")
    return rows.hint("rebalance", *keys, *order).groupBy(*keys).agg(newest).select(*[F.col(c) if c in keys else F.col(f"_row.{c}").alias(c) for c in rows.columns])


def upserted(existing: DataFrame, new: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Existing rows with new ones written over them; a new row beats an existing one."""
    stacked = existing.withColumn("_batch", F.lit(0)).unionByName(new.withColumn("_batch", F.lit(1)))
    return last_write(stacked, keys, ["_batch", *order]).drop("_batch")


def lookup(table: DataFrame, key: Mapping[str, object]) -> DataFrame:
    """Rows of a full key; an absent key gives none. Equality reaches partitions and scan."""
    for name, value in key.items():
        table = table.filter(F.col(name) == F.lit(value))
    return table


def newest_of_key(table: DataFrame, key: Mapping[str, object], order: str = "timestamp", limit: int = 100) -> DataFrame:
    """The newest rows of a key, ties by all other columns."""
    others = [c for c, kind in table.dtypes if c != order and c not in key and not kind.startswith("map")]
    return lookup(table, key).orderBy(F.col(order).desc(), *others).limit(limit)


def first_rows(table: DataFrame, limit: int = 100, order: str = "timestamp", key: Sequence[str] = ()) -> DataFrame:
    """The newest rows, ties by key."""
    return table.orderBy(F.col(order).desc(), *key).limit(limit)


def by_agent(signals: DataFrame, agent: str) -> DataFrame:
    """All signals of one agent by time."""
    return signals.filter(F.col("agent_name") == agent).orderBy("timestamp")


def existing_columns(table: DataFrame, wanted: Sequence[str]) -> DataFrame:
    return table.select(*[c for c in wanted if c in table.columns])


def agent_names(signals: DataFrame) -> DataFrame:
    return signals.select(F.coalesce("agent_name", F.lit("")).alias("agent_name")).distinct().orderBy("agent_name")


def agent_log(signals: DataFrame, agent: str = "All", limit: int = 10) -> DataFrame:
    """Newest log lines of an agent, or of all, with the time cut to minutes."""
    rows = signals if agent == "All" else signals.filter(F.col("agent_name") == agent)
    newest = rows.orderBy(F.col("timestamp").desc(), "run_id", "agent_name").limit(limit)
    return newest.select("agent_name", "direction", "asset", F.substring("timestamp", 1, 16).alias("minute"), "reasoning")


def retention(table: DataFrame, as_of: AsOf, date: str, archive_after: int | None, expire_after: int | None) -> DataFrame:
    """Adds tier: keep, archive or expire by age in days."""
    age = F.datediff(days_before(as_of, 0), F.col(date))
    tier = F.lit("keep")
    if archive_after is not None:
        tier = F.when(age > archive_after, "archive").otherwise(tier)
    if expire_after is not None:
        tier = F.when(age > expire_after, "expire").otherwise(tier)
    return table.withColumn("tier", tier)


def position_view(positions: DataFrame, limit: int = 50) -> DataFrame:
    """Display columns that exist, first rows by key."""
    wanted = ["portfolio_id", "symbol", "direction", "entry_price", "current_price", "size_pct", "pnl_pct", "opened_at"]
    order = [c for c in ("portfolio_id", "symbol", "date") if c in positions.columns]
    return existing_columns(positions.orderBy(*order).limit(limit), wanted)


def latest_signals_sql(signals: DataFrame, limit: int = 20) -> DataFrame:
    return signals.sparkSession.sql(
        """SELECT date, agent_name, direction, strength, confidence
           FROM {signals} ORDER BY date DESC, agent_name LIMIT :limit""",
        args={"limit": limit}, signals=signals,
    )


def price_trend_sql(snapshots: DataFrame, symbol: str = "WTI", source: str = "yfinance", limit: int = 30) -> DataFrame:
    return snapshots.sparkSession.sql(
        """SELECT date, prices[:symbol] AS price FROM {snapshots}
           WHERE source = :source ORDER BY date DESC LIMIT :limit""",
        args={"symbol": symbol, "source": source, "limit": limit}, snapshots=snapshots,
    )


def model_latency_cost_sql(calls: DataFrame) -> DataFrame:
    return calls.sparkSession.sql(
        """SELECT model_name, ROUND(AVG(total_ms), 0) AS avg_latency_ms, ROUND(AVG(cost_usd), 6) AS avg_cost_usd
           FROM {calls} GROUP BY model_name ORDER BY avg_latency_ms""",
        calls=calls,
    )


def direction_distribution_sql(signals: DataFrame) -> DataFrame:
    return signals.sparkSession.sql(
        """SELECT date,
                  SUM(CASE WHEN direction = 'BULLISH' THEN 1 ELSE 0 END) AS bullish,
                  SUM(CASE WHEN direction = 'BEARISH' THEN 1 ELSE 0 END) AS bearish
           FROM {signals} GROUP BY date ORDER BY date DESC""",
        signals=signals,
    )
