"""Signal extraction from response texts: SQL expressions over a text column, no Python per row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import DEFAULT_ASSET, PARSED_ASSETS
from .numeric import half_even_sql

# --- fixed values: patterns over upper-case text ------------------------------------
CONFIDENCE_PATTERN = r"(?U)CONFIDENCE[:\s]+(\d+(?:\.\d+)?)\s*%?"
PERCENT_PATTERN = r"(?U)(\d+(?:\.\d+)?)\s*%"
POSITION_SIZE_PATTERN = r"(?U)POSITION_SIZE[:\s]+(\d+(?:\.\d+)?)\s*%?"
WHITESPACE = r"[\s\x1c-\x1f]"  # needs (?U), with which \s covers Unicode
DIRECTION_WORDS = {"BULLISH": ("BULLISH", "BUY", "LONG"), "BEARISH": ("BEARISH", "SELL", "SHORT")}
STRENGTH_WORDS = {"STRONG": ("STRONG", "HIGH"), "MODERATE": ("MODERATE", "MEDIUM")}


def _first_number(upper: str, pattern: str) -> str:
    return f"try_cast(nullif(regexp_extract({upper}, r'{pattern}', 1), '') AS double)"


def _contains(text: str, word: str) -> str:
    return f"contains({text}, '{word}')"


def _first_class(upper: str, words: dict[str, tuple[str, ...]], default: str) -> Column:
    """The first class one of whose words is a substring; byte search, so cheaper than a pattern."""
    cases = " ".join(
        f"WHEN {' OR '.join(_contains(upper, w) for w in listed)} THEN '{name}'"
        for name, listed in words.items()
    )
    return F.expr(f"CASE {cases} ELSE '{default}' END")


def direction_of(upper: str) -> Column:
    """BULLISH words win over BEARISH words; substrings of upper-case text, as in BELONG."""
    return _first_class(upper, DIRECTION_WORDS, "NEUTRAL")


def strength_of(upper: str) -> Column:
    return _first_class(upper, STRENGTH_WORDS, "WEAK")


def confidence_of(upper: str) -> Column:
    """First stated confidence, else first percentage, else 0.5; never above 1."""
    stated, percent = _first_number(upper, CONFIDENCE_PATTERN), _first_number(upper, PERCENT_PATTERN)
    return F.expr(
        f"coalesce(CASE WHEN {stated} > 1 THEN least({stated} / 100, 1d) ELSE {stated} END,"
        f" CASE WHEN {percent} > 100 THEN 1d ELSE {percent} / 100 END, 0.5d)"
    )


def stated_asset_sql(upper: str) -> str:
    """First listed asset on the first ``ASSET:`` line of upper-case text that names one, else NULL."""
    names = ", ".join(f"'{a}'" for a in PARSED_ASSETS)
    lines = f"filter(split({upper}, '\\n'), line -> contains(line, 'ASSET:'))"
    hits = f"transform({lines}, line -> get(filter(array({names}), a -> contains(line, a)), 0))"
    return f"get(array_compact({hits}), 0)"


def asset_of(upper: str, default: str = DEFAULT_ASSET) -> Column:
    return F.expr(f"coalesce({stated_asset_sql(upper)}, '{default}')")


def position_size_of(upper: str, default: str) -> Column:
    """Stated size capped at 20, else the default (SQL text) rounded to one digit."""
    stated = _first_number(upper, POSITION_SIZE_PATTERN)
    return F.expr(
        f"CASE WHEN {stated} IS NOT NULL THEN least({stated}, 20d) ELSE {half_even_sql(default, 1)} END"
    )


def response_text(model: str, body: str) -> Column:
    """Answer text inside a raw response document, by model family."""

    def part(path: str) -> str:
        strip = rf"r'(?U)\A{WHITESPACE}+|{WHITESPACE}+\z'"
        return f"regexp_replace(coalesce(get_json_object({body}, '{path}'), ''), {strip}, '')"

    return F.expr(
        f"CASE WHEN startswith({model}, 'anthropic.claude') THEN {part('$.completion')}"
        f" WHEN startswith({model}, 'amazon.titan') THEN {part('$.results[0].outputText')}"
        f" WHEN startswith({model}, 'meta.llama') THEN {part('$.generation')}"
        f" WHEN startswith({model}, 'mistral') THEN {part('$.outputs[0].text')} ELSE {body} END"
    )


def estimated_tokens_sql(text: str) -> str:
    """Four tokens for three whitespace-separated words; words are counted without building an array."""
    return rf"(regexp_count({text}, r'(?U)[^\s\x1c-\x1f]+') * 4L) div 3"


def has_any_word(text: str, words) -> Column:
    """Does a whitespace-separated word of the text (SQL) equal one of ``words``, case ignored?"""
    listed = "|".join(rf"\Q{w}\E" for w in words)
    return F.expr(f"concat(' ', lower({text}), ' ')").rlike(f"(?U){WHITESPACE}(?:{listed}){WHITESPACE}")
