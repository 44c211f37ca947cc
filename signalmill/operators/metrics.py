"""Metric rows, tumbling windows and alarms.

Metric rows (name, value, unit, timestamp, dims) are counted once per distinct value, window and dimension set
(``value_counts``). Every statistic over any dimensions, and over any coarser window, follows from that one table: counts add
up, so sums, means and exact percentiles of a roll-up are those of the rows.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..constants import ALARM_PERIOD_SECONDS, ALARM_RULES, WIDGET_PERIOD_SECONDS
from ..functions.lookup import lookup_table
from .order_stats import quantiles


def _metric(rows: DataFrame, name: str, value: Column, unit: str, environment: str, dims: dict[str, Column]) -> DataFrame:
    pairs = [F.lit("Environment"), F.lit(environment)]
    for key, column in dims.items():
        pairs += [F.lit(key), column.cast("string")]
    return rows.select(
        F.lit(name).alias("name"), value.cast("double").alias("value"), F.lit(unit).alias("unit"),
        F.col("ts").alias("timestamp"), F.create_map(*pairs).alias("dims"),
    )


def signals_emitted(signals: DataFrame, environment: str = "dev") -> DataFrame:
    return _metric(signals, "SignalsEmitted", F.lit(1), "Count", environment,
                   {"Agent": F.col("agent_name"), "Direction": F.col("direction")})


def agent_latency(latencies: DataFrame, environment: str = "dev") -> DataFrame:
    return _metric(latencies, "AgentLatencyMs", F.col("latency_ms"), "Milliseconds", environment,
                   {"Agent": F.col("agent_name")})


def call_latency(calls: DataFrame, environment: str = "dev") -> DataFrame:
    return _metric(calls, "LLMCallLatencyMs", F.col("total_ms"), "Milliseconds", environment, {"Model": F.col("model")})


def key_throttles(throttles: DataFrame, environment: str = "dev") -> DataFrame:
    return _metric(throttles, "GroqKeyThrottles", F.lit(1), "Count", environment, {"KeyIndex": F.col("key_index")})


def ingestion_failures(failures: DataFrame, environment: str = "dev") -> DataFrame:
    return _metric(failures, "IngestionFailures", F.lit(1), "Count", environment, {"Source": F.col("source")})


def dims_text(dims: Column) -> Column:
    """Dimensions as ``Key=value`` text in key order."""
    entries = F.sort_array(F.map_entries(dims))
    return F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")


def value_counts(metrics: DataFrame, seconds: int = ALARM_PERIOD_SECONDS) -> DataFrame:
    """name, dims (sorted entries), start, value, n: how often each value occurs per window and dimension set.

    ``metrics`` are rows as the emitters make them. NULL and NaN are no values; a missing dims map has no entries.
    """
    entries = F.sort_array(F.coalesce(F.map_entries("dims"), F.expr("CAST(array() AS array<struct<key:string,value:string>>)")))
    if dict(metrics.dtypes)["timestamp"] != "timestamp":  # a cast would hide a stream's watermark
        metrics = metrics.withColumn("timestamp", F.col("timestamp").cast("timestamp"))
    window = F.window("timestamp", f"{seconds} seconds").alias("window")
    rows = metrics.filter("value IS NOT NULL AND NOT isnan(value) AND timestamp IS NOT NULL").withColumn("dims", entries)
    return rows.groupBy("name", "dims", window, "value").agg(F.count("*").alias("n")).select("name", "dims", F.col("window.start").alias("start"), "value", "n")


def rolled_up(counts: DataFrame, by: Sequence[str] = (), where: Mapping[str, str] | None = None, seconds: int | None = None) -> DataFrame:
    """Counts over all dimensions but those in ``by`` (which become columns), of the rows that have all entries of ``where``.

    ``seconds`` widens the windows; it must be a multiple of theirs. A row without a dimension has NULL for it.
    """
    def of(key: str):
        return lambda entry: entry["key"] == key

    for key, value in (where or {}).items():
        counts = counts.filter(F.array_contains("dims", F.struct(F.lit(key).alias("key"), F.lit(value).alias("value"))))
    start = F.col("start") if seconds is None else F.timestamp_seconds(F.floor(F.unix_seconds("start") / seconds) * seconds)
    named = [F.get(F.filter("dims", of(key)), F.lit(0))["value"].alias(key) for key in by]
    rows = counts.select("name", start.alias("start"), *named, "value", "n")
    return rows.groupBy("name", "start", *by, "value").agg(F.sum("n").alias("n"))


def statistics(
    counts: DataFrame, wanted: Sequence[str], by: Sequence[str] = (), where: Mapping[str, str] | None = None, seconds: int | None = None,
) -> DataFrame:
    """name, ``by``, start, SampleCount and one column per wanted statistic of each window: Sum, Average, Minimum, Maximum,
    SampleCount or an exact interpolated percentile such as p95. Names in ``by`` are words."""
    sums = {
        "SampleCount": "sum(n)", "Sum": "sum(value * n)", "Average": "sum(value * n) / sum(n)", "Minimum": "min(value)", "Maximum": "max(value)",
    }
    points = {s: float(s[1:]) / 100 for s in wanted if re.fullmatch(r"p\d+(\.\d+)?", s)}
    unknown = [s for s in wanted if s not in sums and s not in points]
    if unknown:
        raise ValueError(f"Unknown statistic: {unknown}. Valid: {sorted(sums)} or a percentile such as p95")
    odd = [k for k in by if not re.fullmatch(r"[A-Za-z]\w*", k)]
    if odd:
        raise ValueError(f"not a word: {odd}")
    rows = rolled_up(counts, by, where, seconds)
    keys = ["name", *by, "start"]
    plain = {"SampleCount": sums["SampleCount"], **{s: sums[s] for s in wanted if s in sums}}
    out = rows.groupBy(*keys).agg(*[F.expr(f"{text} AS {name}") for name, text in plain.items()])
    if not points:
        return out
    columns = {s: f"_{s.replace('.', '_')}" for s in points}
    cut = quantiles(rows, keys, "value", {columns[s]: p for s, p in points.items()}, count="n").drop("n")
    cut = cut.select(*[F.col(k).alias(f"_of_{k}") for k in keys], *columns.values())
    out = out.join(cut, F.expr(" AND ".join(f"{k} <=> _of_{k}" for k in keys)))
    return out.select(*keys, *plain, *[F.col(column).alias(s) for s, column in columns.items()])


class Alarm(NamedTuple):
    """A limit on a statistic of a metric: reached (or, if strict, exceeded) in two periods running."""

    metric: str
    threshold: float
    strict: bool = False
    statistic: str = "Sum"
    dims: tuple[tuple[str, str], ...] = ()


def alarm_periods(counts: DataFrame, rules: Sequence[Alarm], seconds: int | None = None) -> DataFrame:
    """metric, start, total: the statistic that each rule watches, per period; the metrics of ``rules`` differ."""
    out = None
    for kind in sorted({(r.statistic, r.dims) for r in rules}):
        names = [r.metric for r in rules if (r.statistic, r.dims) == kind]
        rows = statistics(counts.filter(F.col("name").isin(names)), [kind[0]], where=dict(kind[1]), seconds=seconds)
        part = rows.select(F.col("name").alias("metric"), "start", F.col(f"`{kind[0]}`").cast("double").alias("total"))
        out = part if out is None else out.unionByName(part)
    return out


def row_alarms(metrics: DataFrame, rules: Sequence[Alarm], seconds: int = ALARM_PERIOD_SECONDS) -> DataFrame:
    """Alarm state per period with data, over metric rows as the emitters make them."""
    periods = alarm_periods(value_counts(metrics, seconds), rules)
    return evaluated(periods, [(r.metric, r.threshold, r.strict) for r in rules], seconds)


def period_start(seconds: int) -> Column:
    """Start of the tumbling window a timestamp falls into."""
    return F.window("ts", f"{seconds} seconds")["start"]


def windowed_sums(metrics: DataFrame, by: list[str], seconds: int = WIDGET_PERIOD_SECONDS) -> DataFrame:
    """Sum and count per window; a window without data is absent."""
    window = F.window("ts", f"{seconds} seconds").alias("window")
    sums = metrics.groupBy(*by, window).agg(F.sum("value").alias("total"), F.count("*").alias("n"))
    return sums.select(*by, F.col("window.start").alias("start"), "total", "n")


def windowed_percentiles(metrics: DataFrame, by: list[str], seconds: int = WIDGET_PERIOD_SECONDS) -> DataFrame:
    """Exact p50 and p95 per window."""
    rows = metrics.withColumn("start", period_start(seconds))
    return quantiles(rows, [*by, "start"], "value", {"p50": 0.5, "p95": 0.95})


def alarms(metrics: DataFrame, rules=ALARM_RULES, seconds: int = ALARM_PERIOD_SECONDS) -> DataFrame:
    """Alarm state per period with data."""
    return evaluated(windowed_sums(metrics, ["metric"], seconds), rules, seconds)


def evaluated(periods: DataFrame, rules=ALARM_RULES, seconds: int = ALARM_PERIOD_SECONDS) -> DataFrame:
    """State of every closed period (metric, start, total): ALARM when it and the one before both breach.

    A missing period does not breach. What is ordered per metric is one row per period of the calendar.
    """
    table = lookup_table(
        periods.sparkSession, [(m, float(t), bool(s)) for m, t, s in rules],
        ["metric", "threshold", "strict"],
    )
    total = F.col("total")
    breach = F.when(F.col("strict"), total > F.col("threshold")).otherwise(total >= F.col("threshold"))
    spec = W.partitionBy("metric").orderBy("start")
    adjacent = F.lag("start").over(spec) == F.col("start") - F.expr(f"interval {seconds} seconds")
    rows = periods.join(table, "metric").withColumn("breaching", breach).withColumn(
        "_adjacent", F.coalesce(adjacent, F.lit(False))
    )
    rows = rows.withColumn(
        "_alarm", F.col("breaching") & F.col("_adjacent") & F.coalesce(F.lag("breaching").over(spec), F.lit(False))
    )
    before = F.col("_adjacent") & F.coalesce(F.lag("_alarm").over(spec), F.lit(False))
    return rows.withColumn("changed", F.col("_alarm") != before).select(
        "metric", "start", "total", "threshold", "breaching",
        F.when(F.col("_alarm"), "ALARM").otherwise("OK").alias("state"), "changed",
    )


def evaluated_after(state: DataFrame, periods: DataFrame, rules=ALARM_RULES, seconds: int = ALARM_PERIOD_SECONDS) -> DataFrame:
    """``evaluated`` rows of new ``periods`` only, given the last evaluated rows (``last_periods``) of each metric.

    Two periods back is all that a state and its change can depend on, so nothing older is read.
    """
    known = state.select("metric", "start", "total", F.lit(False).alias("_new"))
    rows = known.unionByName(periods.select("metric", "start", "total", F.lit(True).alias("_new")))
    fresh = rows.groupBy("metric", "start").agg(F.max_by("total", "_new").alias("total"), F.max("_new").alias("_new"))
    judged = evaluated(fresh.select("metric", "start", "total"), rules, seconds)
    return judged.join(fresh.filter("_new").select("metric", "start"), ["metric", "start"], "left_semi")


def last_periods(rows: DataFrame, keep: int = 2) -> DataFrame:
    """metric, start, total: the last ``keep`` periods of each metric."""
    newest = F.row_number().over(W.partitionBy("metric").orderBy(F.desc("start")))
    return rows.select("metric", "start", "total").withColumn("_rank", newest).filter(F.col("_rank") <= keep).drop("_rank")


def closings(rows: DataFrame, until: Column, seconds: int = ALARM_PERIOD_SECONDS) -> DataFrame:
    """metric, start: the first period without data after each row in state ALARM, if that period has ended by ``until``.

    A missing period does not breach, so the alarm ends there.
    """
    spec = W.partitionBy("metric").orderBy("start")
    step = F.expr(f"interval {seconds} seconds")
    gap = F.coalesce(F.lead("start").over(spec) != F.col("start") + step, F.lit(True))
    ended = rows.withColumn("_gap", gap).filter("state = 'ALARM' AND _gap").select("metric", (F.col("start") + step).alias("start"))
    return ended.filter(F.col("start") + step <= until)
