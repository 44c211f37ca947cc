"""Timestamps as stored text."""

from __future__ import annotations

import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F


AsOf = Column | datetime.date | str


def days_before(as_of: AsOf, days: int) -> Column:
    """The date ``days`` before a date, an ISO text or a date column (such as a scalar subquery)."""
    return F.date_sub(as_of if isinstance(as_of, Column) else F.lit(as_of).cast("date"), days)


def iso_utc(ts: str) -> Column:
    """ISO-8601 text with offset; microseconds only when there are any."""
    return F.expr(
        f"concat(date_format({ts}, \"yyyy-MM-dd'T'HH:mm:ss\"),"
        f" CASE WHEN date_format({ts}, 'SSSSSS') = '000000' THEN '' ELSE date_format({ts}, '.SSSSSS') END, '+00:00')"
    )


def iso_date(ts: str) -> Column:
    return F.date_format(ts, "yyyy-MM-dd")
