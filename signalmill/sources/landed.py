"""Dated folders of JSON and Parquet, keyed tables kept as written batches, and folders that age."""

from __future__ import annotations

import datetime
import re
from collections.abc import Mapping, Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.tables import last_write


def write_dated(df: DataFrame, path: str, by: Sequence[str] = ("date",), fmt: str = "json") -> None:
    """Write rows below ``by=value`` folders, replacing only the folders that get rows.

    Rows are brought together by folder to avoid small files; a folder too large for one task is split.
    """
    (
        df.hint("rebalance", *by).write.mode("overwrite").format(fmt).partitionBy(*by)
        .option("partitionOverwriteMode", "dynamic").option("ignoreNullFields", "false").save(path)
    )


def read_dated(spark: SparkSession, path: str, schema: str | StructType, fmt: str = "json") -> DataFrame:
    """Rows with a declared schema; a filter on the folder columns prunes folders."""
    return spark.read.schema(schema).format(fmt).load(path)


def listed_keys(spark: SparkSession, path: str, schema: str | StructType, fmt: str = "parquet") -> DataFrame:
    """Every stored file below a prefix with its row count."""
    rows = read_dated(spark, path, schema, fmt)
    return rows.groupBy(F.col("_metadata.file_path").alias("key")).agg(F.count("*").alias("rows"))


def write_batch(df: DataFrame, path: str, batch: int, by: Sequence[str] = ("date",)) -> None:
    """Store the rows of one write; writing a batch number again replaces that batch, so a retry is safe."""
    df.hint("rebalance", *by).write.mode("overwrite").partitionBy(*by).parquet(f"{path}/batch={batch}")


def read_keyed(
    spark: SparkSession, path: str, schema: str, keys: Sequence[str], order: Sequence[str] = (),
) -> DataFrame:
    """The table as of its last batch: one row per key, later batches replacing whole rows."""
    rows = spark.read.schema(f"{schema}, batch bigint").option("basePath", path).parquet(path)
    return last_write(rows, keys, ["batch", *order]).drop("batch")


class KeyedTable:
    """A keyed table below ``path`` whose manifest names the live batches of every folder.

    Each merge writes its rows as one batch, and a new manifest version makes them live at once. A folder with more than
    ``most`` live batches is folded: its current rows become one batch of their own. So reading a folder costs at most
    ``most`` + 1 batches however many there have been, a merge rewrites only folders it has rows for, and readers see either
    the manifest before or the one after. Batch numbers grow; writing a number again replaces that merge, so a retry is safe.
    """

    MANIFEST = "folder string, batch bigint, folded boolean"

    def __init__(self, spark: SparkSession, path: str, schema: str, keys: Sequence[str], order: Sequence[str] = (), by: str = "date", most: int = 8):
        self.spark, self.path, self.schema, self.keys, self.order, self.by, self.most = spark, path.rstrip("/"), schema, keys, order, by, most

    def _versions(self) -> list[int]:
        return sorted(int(m[1]) for name in listed_folders(self.spark, f"{self.path}/manifest") if (m := re.fullmatch(r"version=(\d+)", name)))

    def live(self, before: int | None = None) -> list[tuple[str, int, bool]]:
        """(folder, batch, folded) of what is read, as of the newest version or the newest one before ``before``."""
        versions = [v for v in self._versions() if before is None or v < before]
        if not versions:
            return []
        rows = self.spark.read.schema(self.MANIFEST).json(f"{self.path}/manifest/version={versions[-1]}")
        return [tuple(r) for r in rows.collect()]  # a few rows per folder

    def _rows(self, parts: Sequence[tuple[str, int, bool]]) -> DataFrame:
        kind = f"{self.schema}, batch bigint, folded boolean"
        if not parts:
            return self.spark.createDataFrame([], kind)
        paths = [f"{self.path}/data/folded={str(folded).lower()}/batch={batch}/{self.by}={folder}" for folder, batch, folded in parts]
        return self.spark.read.schema(kind).option("basePath", f"{self.path}/data").parquet(*paths)

    def _folded(self, parts: Sequence[tuple[str, int, bool]]) -> DataFrame:
        """One row per key. A folded batch is older than the rows of any later batch and holds all rows up to its own number."""
        return last_write(self._rows(parts), self.keys, ["batch", *self.order]).drop("batch", "folded")

    def read(self, folders: Sequence[str] | None = None) -> DataFrame:
        """The current rows, one per key; of the given folders only, if they are named."""
        return self._folded([p for p in self.live() if folders is None or p[0] in set(folders)])

    def merge(self, rows: DataFrame, batch: int) -> None:
        """Write ``rows`` over the table: whole rows replace those of equal key."""
        target = f"{self.path}/data/folded=false/batch={batch}"
        rows.hint("rebalance", self.by).write.mode("overwrite").partitionBy(self.by).parquet(target)
        touched = {m[1] for name in listed_folders(self.spark, target) if (m := re.fullmatch(rf"{self.by}=(.+)", name))}
        parts = [p for p in self.live(before=batch) if p[1] != batch] + [(folder, batch, False) for folder in sorted(touched)]
        full = {f for f in touched if sum(p[0] == f for p in parts) > self.most}
        if full:
            self._folded([p for p in parts if p[0] in full]).hint("rebalance", self.by).write.mode("overwrite").partitionBy(self.by).parquet(
                f"{self.path}/data/folded=true/batch={batch}"
            )
            parts = [p for p in parts if p[0] not in full] + [(folder, batch, True) for folder in sorted(full)]
        manifest = self.spark.createDataFrame(parts, self.MANIFEST)
        manifest.coalesce(1).write.mode("overwrite").json(f"{self.path}/manifest/version={batch}")


def _file_system(spark: SparkSession, path: str):
    """Spark's own view of a path: the file system that its readers and writers use for it."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop


def listed_folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders directly below a path; none if it is not there."""
    system, hadoop = _file_system(spark, path)
    if not system.exists(hadoop):
        return []
    return sorted(s.getPath().getName() for s in system.listStatus(hadoop) if s.isDirectory())


class Retention(NamedTuple):
    """What happens to the dated folders below a prefix that are more than ``days`` old: ``archive`` or ``expire``."""

    prefix: str
    days: int
    action: str


def retain(spark: SparkSession, root: str, as_of: datetime.date, rules: Sequence[Retention], archive: str = "archive") -> Mapping[str, int]:
    """Apply the rules to the ``date=`` folders below ``root``/prefix; returns how many folders each action moved.

    Folders are moved or deleted as a whole, no row is read. A run that was cut short is simply repeated: what has been
    moved is not there any more, and a folder that already has a copy in the archive (a move that was not finished) replaces it.
    """
    done = {"archive": 0, "expire": 0}
    for rule in rules:
        if rule.action not in done:
            raise ValueError(f"Unknown action: {rule.action}. Valid: {sorted(done)}")
        for name in listed_folders(spark, f"{root}/{rule.prefix}"):
            found = re.fullmatch(r"date=(\d{4}-\d{2}-\d{2})", name)
            if not found or (as_of - datetime.date.fromisoformat(found[1])).days <= rule.days:
                continue
            system, folder = _file_system(spark, f"{root}/{rule.prefix}/{name}")
            if rule.action == "archive":
                _, parent = _file_system(spark, f"{root}/{archive}/{rule.prefix}")
                _, target = _file_system(spark, f"{root}/{archive}/{rule.prefix}/{name}")
                system.mkdirs(parent)
                system.delete(target, True)
                if not system.rename(folder, target):
                    raise OSError(f"cannot move {name} of {rule.prefix}")
            else:
                system.delete(folder, True)
            done[rule.action] += 1
    return done
