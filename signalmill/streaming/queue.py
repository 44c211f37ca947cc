"""JSON messages landing as files: parse, redeliver, dead-letter."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..constants import MAX_RECEIVES
from ..sources.landed import read_keyed, write_batch
from .windows import drain

MESSAGE = "message_id string, attempt int, body string"
OUTCOME = "message_id string, attempt int, body string, status string"
EVENT_BODY = "event_type string, date string, s3_key string"


def split_messages(messages: DataFrame, body_schema: str, max_receives: int = MAX_RECEIVES["ingestion"]) -> DataFrame:
    """Adds the parsed body and status: ok, retry, or dead once a bad message was received often enough.

    A body is good when it is a JSON object; one bad message does not stop the others. Every message has an attempt.
    """
    schema = f"{body_schema}, _corrupt string"
    parsed = F.from_json("body", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    rows = messages.withColumn("_parsed", parsed)
    good = F.col("_parsed").isNotNull() & F.col("_parsed._corrupt").isNull() & F.col("body").rlike(r"^\s*\{")
    status = F.when(F.coalesce(good, F.lit(False)), "ok").when(F.col("attempt") >= max_receives, "dead").otherwise("retry")
    return rows.withColumn("status", status).withColumn("message", F.col("_parsed").dropFields("_corrupt")).drop("_parsed")


def parse_lines(lines: DataFrame) -> DataFrame:
    """Landed lines (``value``) as messages. A line that is no message becomes one, so that it ends as a dead letter:
    its id is the digest of its text, its body the line. A message without attempt is a first delivery.
    """
    rows = lines.filter(F.trim("value") != "").withColumn("_m", F.from_json("value", MESSAGE))
    named = F.col("_m.message_id").isNotNull()
    return rows.select(
        F.coalesce("_m.message_id", F.concat(F.lit("line:"), F.sha2("value", 256))).alias("message_id"),
        F.coalesce("_m.attempt", F.lit(1)).alias("attempt"),
        F.when(named, F.col("_m.body")).otherwise(F.coalesce("_m.body", "value")).alias("body"),
    )


def consume(
    spark: SparkSession, landing: str, out: str, checkpoint: str, body_schema: str = EVENT_BODY,
    max_receives: int = MAX_RECEIVES["ingestion"],
) -> StreamingQuery:
    """Drain a folder of message files: good rows, dead letters and retries each to their own table.

    A retry is landed again with its attempt raised, which is what makes the limit count deliveries.
    """
    lines = spark.readStream.text(landing)

    def write(batch: DataFrame, number: int) -> None:
        rows = split_messages(parse_lines(batch), body_schema, max_receives)
        write_batch(rows.select("message_id", "attempt", "body", "status"), out, number, ["status"])

    return drain(lines, checkpoint, write)


def reland(spark: SparkSession, out: str, landing: str) -> int:
    """Land the messages that are due for redelivery; returns how many, counted while they are written."""
    rows = read_keyed(spark, out, OUTCOME, ["message_id"], ["attempt"]).filter(F.col("status") == "retry")
    counted = Observation()
    due = rows.select("message_id", (F.col("attempt") + 1).alias("attempt"), "body").observe(counted, F.count("*").alias("n"))
    due.write.mode("append").json(landing)
    return counted.get["n"]


def outcome(spark: SparkSession, out: str) -> DataFrame:
    """Latest state of every message."""
    return read_keyed(spark, out, OUTCOME, ["message_id"], ["attempt"])
