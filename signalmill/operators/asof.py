"""As-of join: for each row the newest earlier row of another table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SLICE_SECONDS = 7 * 86_400


def as_of_join(
    left: DataFrame, right: DataFrame, at: str, since: str, by: Sequence[str] = (), within_days: int | None = None,
    slice_seconds: int = SLICE_SECONDS,
) -> DataFrame:
    """``left`` with the other columns of the newest ``right`` row whose ``since`` is not after ``at``, NULL where there is none.

    ``at`` and ``since`` are dates or timestamps, ``by`` columns of both tables that must be equal (NULL equals NULL). A row
    older than ``within_days`` counts as none. Of right rows of equal key and time the one of greatest values counts, so the
    result is the same on every run. Left rows stay as they are, those without a time included.

    Only distinct times are ordered, inside slices of ``slice_seconds``; what goes from slice to slice is the last row of
    each, one per slice of the calendar. So a time or key that holds any share of the rows is one row here, and rows meet
    their time again by equality, which skew handling can split.
    """
    rest = [c for c in right.columns if c != since and c not in by]
    ordered = [c for c, kind in right.dtypes if c in rest and "map<" not in kind]  # maps have no order
    timed = right.filter(F.col(since).isNotNull()).select(
        *by, F.col(since).cast("timestamp").alias("_t"), F.struct(since, *rest).alias("_row"), F.struct(since, *ordered).alias("_order")
    )
    known = timed.groupBy(*by, "_t").agg(F.max_by("_row", "_order").alias("_row"))
    times = left.filter(F.col(at).isNotNull()).select(*by, F.col(at).cast("timestamp").alias("_t")).distinct()
    sliced = f"coalesce(unix_seconds(_t) div {slice_seconds}, 0L) AS _slice"
    asked = times.selectExpr("*", "1 AS _asks", sliced)
    stacked = known.selectExpr("*", "0 AS _asks", sliced).unionByName(asked, allowMissingColumns=True)
    key = "".join(f"{c}, " for c in by)
    earlier = f"(PARTITION BY {key}1 ORDER BY _slice ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    ends = stacked.groupBy(*by, "_slice").agg(F.expr("max_by(_row, _t) FILTER (WHERE _asks = 0) AS _end"))
    before = ends.selectExpr(*[f"{c} AS _by_{c}" for c in by], "_slice AS _of", f"last(_end, true) OVER {earlier} AS _carried")
    so_far = f"(PARTITION BY {key}_slice ORDER BY _t, _asks ROWS UNBOUNDED PRECEDING)"
    inside = stacked.selectExpr(*by, "_t", "_slice", "_asks", f"last(_row, true) OVER {so_far} AS _seen").filter("_asks = 1")
    same = " AND ".join(["_slice = _of", *[f"{c} <=> _by_{c}" for c in by]])
    found = inside.join(before, F.expr(same)).selectExpr(*[f"_by_{c}" for c in by], "_t AS _at", "coalesce(_seen, _carried) AS _found")
    if within_days is not None:
        found = found.filter(f"CAST(_found.{since} AS timestamp) >= _at - INTERVAL '{within_days}' DAY")
    meets = " AND ".join([f"CAST({at} AS timestamp) = _at", *[f"{c} <=> _by_{c}" for c in by]])
    joined = left.join(found, F.expr(meets), "left")
    shown = [since, *rest] if since != at else rest
    return joined.select(*[F.col(c) for c in left.columns], *[F.col(f"_found.{c}").alias(c) for c in shown])
