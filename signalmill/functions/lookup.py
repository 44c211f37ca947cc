"""Small fixed look-up tables joined by broadcast, with the size bound checked."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BROADCAST_ROWS = 10_000


def quoted(values) -> str:
    """Values as a list of SQL string literals."""
    escaped = (str(v).replace("\\", "\\\\").replace("'", "\\'") for v in values)
    return ", ".join(f"'{v}'" for v in escaped)


def _literal(value) -> str:
    if isinstance(value, bool):
        return str(value).lower()
    return f"{value!r}D" if isinstance(value, float) else quoted([value])


def lookup_table(spark: SparkSession, rows: Sequence[tuple], columns: Sequence[str]) -> DataFrame:
    """Parameter rows of text, doubles and booleans as a local relation.

    Hinted for broadcast only while the rows stay few; a longer table is left to the optimizer.
    """
    values = ", ".join(f"({', '.join(_literal(v) for v in row)})" for row in rows)
    table = spark.sql(f"SELECT * FROM VALUES {values} AS t({', '.join(columns)})")
    return F.broadcast(table) if len(rows) <= BROADCAST_ROWS else table
