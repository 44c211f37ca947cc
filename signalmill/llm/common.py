"""What the training-data operators share: word patterns, tables that cut lineage, small lookups."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path

#: Words are runs of anything but these six ASCII white-space characters.
SPACES = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` written below the shared folder and read again: lost executors do not lose it, lineage ends here."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def words(text: str | Column) -> Column:
    """The words of a text as an array; empty for a text without words or null."""
    bare = F.btrim(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), F.lit(SPACES))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, GAP))


def same(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    """Equality of all keys where null equals null."""
    condition = F.lit(True)
    for key in keys:
        condition = condition & left[key].eqNullSafe(right[key])
    return condition


_shipped: set[str] = set()


def ship_code(spark: SparkSession) -> None:
    """Sends this package to the executors, once per application, for operators whose tasks run Python functions."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    folder = tempfile.mkdtemp(prefix="signalmill-code-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    target = os.path.join(folder, "signalmill-code.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as packed:
        for at, _, names in os.walk(top):
            for name in names:
                if name.endswith(".py"):
                    file = os.path.join(at, name)
                    packed.write(file, os.path.relpath(file, os.path.dirname(top)))
    context.addPyFile(target)
    _shipped.add(context.applicationId)
