"""Named queries over the given tables, each with its comparison SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .bindings import Inputs

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a function of Inputs under ``name``."""

    def add(function: Callable[[Inputs], DataFrame]):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return function(Inputs(spark, folder))

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return function

    return add


def stamp(column: str | Column) -> Column:
    """A time as text to the second."""
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss")


def day(column: str | Column) -> Column:
    return F.date_format(column, "yyyy-MM-dd")


def sql_stamp(column: str) -> str:
    return f"strftime({column}, '%Y-%m-%d %H:%M:%S')"


def sql_day(column: str) -> str:
    return f"strftime({column}, '%Y-%m-%d')"
