"""Number helpers as SQL expression text, for ``selectExpr`` and ``expr``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# 2**27 + 1 cuts a double into two halves that multiply without error; from 2**52 on every double is whole
_SPLIT, _WHOLE = "134217729d", "4503599627370496d"


def half_even_sql(value: str, digits: int) -> str:
    """Decimal rounding of the binary value, ties to even.

    ``round`` and ``bround`` work on the printed digits, so 1278.55 (stored slightly below) goes up there;
    here the error of ``value * 10**digits`` is recovered exactly and decides such cases. Huge values and
    NaN pass through. ``value`` is repeated, so name a column rather than a long expression.
    """
    scale = f"{10**digits}d"
    product = f"({value} * {scale})"
    high = f"({value} * {_SPLIT} - ({value} * {_SPLIT} - {value}))"
    error = f"(({high} * {scale} - {product}) + ({value} - {high}) * {scale})"
    above = f"(({product} - floor({product})) - 0.5d + {error})"
    odd = f"(floor({product}) % 2 <> 0)"
    step = f"CASE WHEN {above} > 0 OR ({above} = 0 AND {odd}) THEN 1d ELSE 0d END"
    return f"CASE WHEN abs({value}) * {scale} < {_WHOLE} THEN (floor({product}) + {step}) / {scale} ELSE {value} END"


def half_even(value: str, digits: int) -> Column:
    return F.expr(half_even_sql(value, digits))


def scaled_round_sql(value: str, digits: int) -> str:
    """Column-wise rounding: the scaled product to the nearest whole number, ties to even."""
    return f"rint({value} * {10**digits}d) / {10**digits}d"


def rounded(digits: dict[str, int]) -> list[Column]:
    """Each named column rounded to its digits, under its own name."""
    return [half_even(name, d).alias(name) for name, d in digits.items()]


def fixed_sql(value: str, digits: int) -> str:
    """Fixed-point text of the rounded value, as in ``12.3``."""
    return f"format_string('%.{digits}f', {half_even_sql(value, digits)})"


def to_float_sql(text: str) -> str:
    """Text to double, NULL when it is not a number (Java's ``1d``/``1f`` suffixes are not numbers)."""
    return rf"CASE WHEN NOT rlike({text}, r'(?i)[0-9.][df]\s*$') THEN try_cast({text} AS double) END"


def ratio_sql(top: str, bottom: str) -> str:
    """top / bottom, 0 unless bottom is positive."""
    return f"CASE WHEN {bottom} > 0 THEN {top} / ({bottom}) ELSE 0d END"
