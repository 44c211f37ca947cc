"""Exact order statistics per group that never hold a group in one task.

Rows are first counted per distinct (group, value): a partial aggregate, so a hot group is spread over its
values and a hot value is one row. Values fall into buckets of about 0.1 % relative width, and each bucket into
2^20 cuts, both by a monotone expression. Bucket totals (bounded per group) tell which buckets hold the wanted ranks,
cut totals (bounded per bucket) which cuts do, and only the values of those cuts, 1e-9 of their size apart, are put
in order.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BUCKETS_PER_E_FOLD = 1000
CUTS = 1 << 20


def value_counts(df: DataFrame, keys: list[str], value: str, count: str = "1") -> DataFrame:
    """keys, bucket _b, its cut _b1, distinct value _v and its count _c; NULL and NaN are left out.

    ``count`` is SQL text: how many values a row stands for.
    """
    rows = df.selectExpr(*keys, f"CAST({value} AS double) AS _v", f"CAST({count} AS bigint) AS _c")
    counts = rows.filter("_v IS NOT NULL AND NOT isnan(_v)").groupBy(*keys, "_v").agg(F.sum("_c").alias("_c"))
    # monotone in the value, at most about 3 million distinct buckets over all doubles; ln of a double is above -800
    place = f"(ln(abs(_v)) + 800) * {BUCKETS_PER_E_FOLD}"
    counts = counts.selectExpr("*", f"CASE WHEN _v = 0 THEN 0d ELSE {place} END AS _x", "CAST(signum(_v) AS bigint) AS _s")
    return counts.selectExpr(
        *keys, "_s * CAST(floor(_x) AS bigint) AS _b", f"_s * CAST(floor((_x - floor(_x)) * {CUTS}) AS bigint) AS _b1", "_v", "_c"
    )


def ranked_values(df: DataFrame, keys: list[str], value: str, ranks: Mapping[str, str], count: str = "1") -> DataFrame:
    """keys, n and one column per entry of ``ranks``: the value at that 0-based place in sorted order.

    A rank is SQL text over ``n``, the number of values of the group.
    """
    by = ", ".join(keys)
    values = value_counts(df, keys, value, count)
    cuts = values.groupBy(*keys, "_b", "_b1").agg(F.sum("_c").alias("_c"))
    buckets = cuts.groupBy(*keys, "_b").agg(F.sum("_c").alias("_c")).selectExpr("*", f"sum(_c) OVER (PARTITION BY {by}) AS n")
    wanted = ", ".join(f"named_struct('_name', '{name}', '_rank', CAST({rank} AS bigint))" for name, rank in ranks.items())
    in_bucket = _holding(buckets.selectExpr("*", f"array({wanted}) AS _want"), by, "_b", [*keys, "_b"])
    cuts = cuts.join(in_bucket, _same([*keys, "_b"], "_t_")).drop(*[f"_t_{c}" for c in [*keys, "_b"]])
    in_cut = _holding(cuts, f"{by}, _b", "_b1", [*keys, "_b", "_b1"])
    hits = values.join(in_cut, _same([*keys, "_b", "_b1"], "_t_"))
    hits = hits.selectExpr(
        "*", f"sum(_c) OVER (PARTITION BY {by}, _b, _b1 ORDER BY _v ROWS UNBOUNDED PRECEDING) AS _upto"
    ).selectExpr(*keys, "_v", "_c", "_upto", "n", "inline(_want)").filter("_rank >= _upto - _c AND _rank < _upto")
    return hits.groupBy(*keys).agg(*_aggregates({
        "n": "max(n)", **{name: f"max(CASE WHEN _name = '{name}' THEN _v END)" for name in ranks},
    }))


def _holding(totals: DataFrame, by: str, part: str, names: list[str]) -> DataFrame:
    """The parts that hold wanted ranks, with those ranks counted from the part's start; names prefixed with _t_."""
    placed = totals.selectExpr("*", f"sum(_c) OVER (PARTITION BY {by} ORDER BY {part} ROWS UNBOUNDED PRECEDING) - _c AS _before")
    inside = placed.selectExpr(
        "*", "filter(transform(_want, w -> named_struct('_name', w._name, '_rank', w._rank - _before)), w -> w._rank >= 0 AND w._rank < _c) AS _inside"
    ).filter("size(_inside) > 0")
    return inside.selectExpr(*[f"{c} AS _t_{c}" for c in names], "n", "_inside AS _want")


def quantiles(df: DataFrame, keys: list[str], value: str, points: Mapping[str, float], count: str = "1") -> DataFrame:
    """Linearly interpolated quantiles, exact: keys, n and one column per entry of ``points``.

    ``count`` is SQL text: how many values a row stands for.
    """
    ranks = {}
    for name, p in points.items():
        ranks[f"{name}__lo"] = f"floor((n - 1) * {p}d)"
        ranks[f"{name}__hi"] = f"ceil((n - 1) * {p}d)"
    between = [_between(f"{name}__lo", f"{name}__hi", f"((n - 1) * {p}d - floor((n - 1) * {p}d))") + f" AS {name}"
               for name, p in points.items()]
    return ranked_values(df, keys, value, ranks, count).selectExpr(*keys, "n", *between)


def _between(low: str, high: str, part: str) -> str:
    """Linear interpolation taken from the nearer end, which is what fixes its last digit."""
    return (
        f"CASE WHEN {part} >= 0.5 THEN {high} - ({high} - {low}) * (1 - {part})"
        f" ELSE {low} + ({high} - {low}) * {part} END"
    )


def box_bounds(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Exact quartiles, the outermost values within 1.5 IQR of them (a whisker never ends inside the box),
    and the number of values beyond.

    Works on the value counts, whose shuffle the quartiles already pay for.
    """
    fences = quantiles(df, keys, value, {"q1": 0.25, "median": 0.5, "q3": 0.75}).selectExpr(
        *[f"{k} AS _q_{k}" for k in keys], "n", "q1", "median", "q3",
        "q1 - 1.5d * (q3 - q1) AS _low", "q3 + 1.5d * (q3 - q1) AS _high",
    )
    inside = "_v BETWEEN _low AND _high"
    return value_counts(df, keys, value).join(fences, _same(keys, "_q_")).groupBy(*keys).agg(*_aggregates({
        "n": "max(n)", "q1": "max(q1)", "median": "max(median)", "q3": "max(q3)",
        "whisker_low": f"least(max(q1), min(CASE WHEN {inside} THEN _v END))",
        "whisker_high": f"greatest(max(q3), max(CASE WHEN {inside} THEN _v END))",
        "outliers": f"coalesce(sum(CASE WHEN NOT ({inside}) THEN _c END), 0)",
    }))


def _same(keys: list[str], prefix: str):
    """Join condition on equal keys where NULL equals NULL."""
    return F.expr(" AND ".join(f"{k} <=> {prefix}{k}" for k in keys))


def _aggregates(named: Mapping[str, str]):
    return [F.expr(f"{text} AS {name}") for name, text in named.items()]
