"""New folders and new snapshots start work, each exactly once."""

from __future__ import annotations

import logging
from collections.abc import Callable, Sequence

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..operators.snapshots import snapshot_events
from ..sources.landed import KeyedTable, write_batch
from .windows import drain

logger = logging.getLogger(__name__)


def schema_changes(
    spark: SparkSession, files: Sequence[str], schema: str | StructType, fmt: str = "parquet", folders: tuple[str, ...] = (),
) -> list[str]:
    """Differences between the declared columns and those that the given self-describing files have, as text.

    Only the footers of these files are read, in tasks. Folder columns are not in the files, so they are not looked for.
    """
    declared = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
    kinds = {f.name: f.dataType for f in declared if f.name not in folders}
    try:
        found = spark.read.format(fmt).option("mergeSchema", "true").load(list(files)).schema
    except (PySparkException, Py4JJavaError) as error:  # columns of different types do not merge
        return [f"files disagree: {str(error).strip().splitlines()[-1]}"]
    stored = {f.name: f.dataType for f in found if f.name not in folders}
    return (
        [f"new column {c}" for c in stored if c not in kinds]
        + [f"missing column {c}" for c in kinds if c not in stored]
        + [f"column {c} is {stored[c].simpleString()}" for c in kinds if c in stored and stored[c] != kinds[c]]
    )


def catalog_new(
    spark: SparkSession, source: str, target: str, checkpoint: str, schema: str | StructType, fmt: str = "parquet",
    by: tuple[str, ...] = ("date",), files_at_once: int = 10_000,
) -> StreamingQuery:
    """Add files not seen before to the catalogued table; a changed schema of new files is logged, not applied.

    A micro-batch has at most ``files_at_once`` files; the names of its files are all that the driver sees of them.
    """
    rows = spark.readStream.schema(schema).format(fmt).option("maxFilesPerTrigger", files_at_once).load(source)

    def write(batch: DataFrame, number: int) -> None:
        if fmt in ("parquet", "orc"):
            files = [r[0] for r in batch.select("_file").distinct().collect()]
            for change in schema_changes(spark, files, schema, fmt, by) if files else ():
                logger.warning("%s: %s", source, change)
        write_batch(batch.drop("_file"), target, number, by)

    return drain(rows.select("*", F.col("_metadata.file_path").alias("_file")), checkpoint, write)


def on_new_snapshot(
    spark: SparkSession, source: str, checkpoint: str, schema: str | StructType,
    run: Callable[[DataFrame, int], None], fmt: str = "json",
) -> StreamingQuery:
    """Hand the events of new snapshots to ``run``; a retried micro-batch carries the same number."""
    events = snapshot_events(spark.readStream.schema(schema).format(fmt).load(source))
    return drain(events, checkpoint, run)


def decide_on_snapshots(
    spark: SparkSession, source: str, checkpoint: str, schema: str | StructType,
    decide: Callable[[DataFrame], DataFrame], recommendations: KeyedTable, fmt: str = "json",
) -> StreamingQuery:
    """Run the whole chain for the dates of new snapshots and store its recommendations.

    ``decide`` turns the affected dates (``date``, each once) into recommendation rows of those dates; nothing else is computed
    again. Rows replace those of equal key, so a snapshot that is delivered twice, or a micro-batch that is retried, stores
    one recommendation.
    """
    def run(events: DataFrame, number: int) -> None:
        recommendations.merge(decide(events.select("date").distinct()), number)

    return on_new_snapshot(spark, source, checkpoint, schema, run, fmt)


def notify(decisions: DataFrame, path: str, batch: int) -> None:
    """Store the messages of STRONG recommendations; a failing sink does not fail the run."""
    from ..operators.decisions import notifications

    try:
        notifications(decisions).withColumn("sent_for", F.lit(batch)).write.mode("overwrite").json(f"{path}/batch={batch}")
    except Exception as error:  # best effort by contract
        logger.warning("notification skipped: %s", error)
