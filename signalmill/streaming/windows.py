"""Metric windows over a stream; the batch functions of operators.metrics give the same rows."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..constants import ALARM_PERIOD_SECONDS, ALARM_RULES, WIDGET_PERIOD_SECONDS
from ..operators.metrics import Alarm, alarm_periods, evaluated, evaluated_after, last_periods, value_counts, windowed_sums
from ..operators.order_stats import quantiles
from ..sources.landed import read_keyed, write_batch

WATERMARK = "10 minutes"
WINDOW_ROWS = "metric string, start timestamp, total double, n bigint"


def event_time(stream: DataFrame, ts: str = "ts") -> DataFrame:
    """A watermark needs a zoned timestamp; stored local ones are UTC."""
    return stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, WATERMARK)


def stream_sums(metrics: DataFrame, by: list[str], seconds: int = WIDGET_PERIOD_SECONDS) -> DataFrame:
    return windowed_sums(event_time(metrics), by, seconds)


def stream_value_counts(metrics: DataFrame, by: list[str], seconds: int = WIDGET_PERIOD_SECONDS) -> DataFrame:
    """How often each value occurs in a window: mergeable state from which exact percentiles follow.

    In append mode a window leaves the state when the watermark passes it, so only open windows are held.
    """
    window = F.window("ts", f"{seconds} seconds").alias("window")
    rows = event_time(metrics).groupBy(*by, window, "value").agg(F.count("*").alias("n"))
    return rows.select(*by, F.col("window.start").alias("start"), "value", "n")


def stored_percentiles(counts: DataFrame, by: list[str]) -> DataFrame:
    """Exact p50 and p95 of stored value counts, as the batch form gives them."""
    return quantiles(counts, [*by, "start"], "value", {"p50": 0.5, "p95": 0.95}, count="n")


def drain(
    result: DataFrame, checkpoint: str, write: Callable[[DataFrame, int], None], mode: str = "append",
) -> StreamingQuery:
    """Process what has landed, handing each micro-batch to ``write``, then stop."""
    query = (
        result.writeStream.outputMode(mode).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).foreachBatch(write).start()
    )
    query.awaitTermination()
    return query


def store_windows(result: DataFrame, checkpoint: str, path: str, by: str = "metric", mode: str = "append") -> StreamingQuery:
    """Closed windows into a keyed table; a replayed micro-batch replaces itself."""
    return drain(result, checkpoint, lambda rows, batch: write_batch(rows, path, batch, [by]), mode)


def alarm_states(
    spark: SparkSession, path: str, rules=ALARM_RULES, seconds: int = ALARM_PERIOD_SECONDS,
) -> DataFrame:
    """Alarm states over the windows a stream has stored so far."""
    return evaluated(read_keyed(spark, path, WINDOW_ROWS, ["metric", "start"]), rules, seconds)


def stream_metric_counts(rows: DataFrame, seconds: int = ALARM_PERIOD_SECONDS) -> DataFrame:
    """``value_counts`` of a stream of metric rows; in append mode only open windows are held."""
    return value_counts(rows.withColumn("timestamp", F.col("timestamp").cast("timestamp")).withWatermark("timestamp", WATERMARK), seconds)


JUDGED = "metric string, start timestamp, total double, threshold double, breaching boolean, state string, changed boolean"


def watch_alarms(
    counts: DataFrame, checkpoint: str, path: str, rules: Sequence[Alarm], seconds: int = ALARM_PERIOD_SECONDS,
) -> StreamingQuery:
    """Evaluate the closed windows of each micro-batch once, with the last two periods of each metric carried over.

    ``counts`` is ``stream_metric_counts`` over windows of ``seconds``. Judged rows and the carried periods go to numbered
    batches below ``path``; a replayed micro-batch starts from the state before it and replaces its own rows.
    """
    limits = [(r.metric, r.threshold, r.strict) for r in rules]

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch.write.mode("overwrite").parquet(f"{path}/counts/batch={number}")  # computed once, whatever reads it
        periods = alarm_periods(spark.read.schema(batch.schema).parquet(f"{path}/counts/batch={number}"), rules)
        state = _state_before(spark, f"{path}/state", number)
        write_batch(evaluated_after(state, periods, limits, seconds), f"{path}/judged", number, ["metric"])
        judged = spark.read.schema(JUDGED).parquet(f"{path}/judged/batch={number}")
        last_periods(state.unionByName(judged.select("metric", "start", "total"))).coalesce(1).write.mode("overwrite").parquet(f"{path}/state/batch={number}")

    return drain(counts, checkpoint, write)


def _state_before(spark: SparkSession, path: str, number: int) -> DataFrame:
    """What the micro-batch before carried over; nothing before the first."""
    kind = "metric string, start timestamp, total double"
    if number == 0:
        return spark.createDataFrame([], kind)
    return spark.read.schema(kind).parquet(f"{path}/batch={number - 1}")


def judged_alarms(spark: SparkSession, path: str) -> DataFrame:
    """All rows judged so far."""
    return spark.read.schema(f"{JUDGED}, batch bigint").option("basePath", f"{path}/judged").parquet(f"{path}/judged").drop("batch")
