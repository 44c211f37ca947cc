"""Bars per symbol, and ways to order a long history without one task per symbol."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A history is cut into time slices for numbering and into row blocks for windows.
SLICE_SECONDS = 7 * 86_400
BLOCK_ROWS = 1024


def resample(ticks: DataFrame, unit: str = "hour", tie: str | None = "id") -> DataFrame:
    """Ticks (symbol, ts, value) to open/high/low/close/volume bars; equal times go by the ``tie`` column.

    Only partial aggregates of bounded size cross the shuffle, so a hot symbol costs no more than a cold one. Time and a
    whole-number tie are one fixed-width number, so the aggregates hash and nothing is sorted; another kind of tie sorts.
    """
    if tie and dict(ticks.dtypes)[tie] in ("tinyint", "smallint", "int", "bigint"):
        micros = "CAST(unix_micros(CAST(ts AS timestamp)) AS decimal(18,0)) * CAST(100000000000000000000 AS decimal(21,0))"
        # a missing tie sorts first, as NULL does
        order = F.expr(f"CAST({micros} + coalesce(CAST({tie} AS decimal(20,0)) + 9223372036854775809, 0) AS decimal(38,0))")
    else:
        order = F.struct("ts", tie) if tie else F.col("ts")
    bucket = F.date_trunc(unit, "ts").cast("timestamp_ntz")
    return ticks.groupBy("symbol", bucket.alias("ts")).agg(
        F.min_by("value", order).alias("open"),
        F.max("value").alias("high"),
        F.min("value").alias("low"),
        F.max_by("value", order).alias("close"),
        F.count("*").alias("volume"),
    )


def numbered(bars: DataFrame, slice_seconds: int = SLICE_SECONDS) -> DataFrame:
    """Adds rn (1-based row number within the symbol), n (rows of the symbol) and prev_close.

    Rows are sorted inside (symbol, time slice) only. What runs per symbol is one summary row per
    slice, a count bounded by the length of the calendar.
    """
    # a slice that cannot be NULL leaves both uses of the bars with the same plan, so their shuffle is shared
    timed = bars.filter("symbol IS NOT NULL AND ts IS NOT NULL")
    sliced = timed.selectExpr("*", f"coalesce(unix_seconds(CAST(ts AS timestamp)) div {slice_seconds}, 0L) AS _slice")
    per_slice = sliced.groupBy("symbol", "_slice").agg(
        F.count("*").alias("_rows"), F.max_by("close", "ts").alias("_last")
    )
    offsets = per_slice.selectExpr(
        "symbol", "_slice",
        "sum(_rows) OVER (PARTITION BY symbol ORDER BY _slice ROWS UNBOUNDED PRECEDING) - _rows AS _before",
        "sum(_rows) OVER (PARTITION BY symbol) AS n",
        "lag(_last) OVER (PARTITION BY symbol ORDER BY _slice) AS _carried",
    )
    local = "(PARTITION BY symbol, _slice ORDER BY ts)"
    placed = sliced.selectExpr("*", f"row_number() OVER {local} AS _i", f"lag(close) OVER {local} AS _prev")
    return placed.join(offsets, ["symbol", "_slice"]).selectExpr(
        *[f"`{c}`" for c in bars.columns],
        "_before + _i AS rn", "n", "CASE WHEN _i = 1 THEN _carried ELSE _prev END AS prev_close",
    )


def blocked(rows: DataFrame, block_rows: int, halo_rows: int) -> DataFrame:
    """Adds _block and repeats the ``halo_rows`` rows that a later block looks back on; _own marks the original copies."""
    in_tail = f"(rn - 1) % {block_rows} >= {block_rows - halo_rows} AND rn <= n - 1 - (n - 1) % {block_rows}"
    return (
        rows.selectExpr("*", f"(rn - 1) div {block_rows} AS _home")
        .selectExpr("*", f"explode(CASE WHEN {in_tail} THEN array(_home, _home + 1) ELSE array(_home) END) AS _block")
        .selectExpr("*", "_block = _home AS _own")
        .drop("_home")
    )
