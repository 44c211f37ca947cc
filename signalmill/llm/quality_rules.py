"""Quality rules: per-document counts, and lines that too many documents of one host share.

A line is normalised (A-Z lower-cased, white-space runs as one blank, trimmed) and hashed. Its frequency on a host
is the number of distinct documents (by content, so exact copies count once) that hold it. A line over the limit is
boiler-plate and is removed; a document that loses more than half of its words is depleted and rejected.

One scan writes a narrow table: counts, and (hash, words) of each line. Frequencies and verdicts come from that table,
so no text is shuffled; ``apply_quality`` alone shuffles it, once, to take the lines out.

Defined results: null and empty texts have no words and fail the base rule; a null host is a host of its own; repeated
rows are judged alike; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import GAP, LOWER, SPACES, UPPER, same, table, words, written

SYMBOLS = "[#*$%&|<>]"


def normal_line(line: Column) -> Column:
    return F.translate(F.btrim(F.regexp_replace(line, GAP, " "), F.lit(" ")), UPPER, LOWER)


def text_lines(text: Column) -> Column:
    r"""The ``\n``-split lines that hold a word."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda line: F.btrim(line, F.lit(SPACES)) != "")


def repeated_windows(found: DataFrame, list_column: str, out: str, size: int = 3) -> DataFrame:
    """Adds how many words lie in a window of ``size`` words that occurs twice or more in the same list.

    Windows are hashed, sorted with their positions, and kept if a neighbour has the same hash; the words that the
    kept windows cover are counted once each. Lists without an equal pair skip the sort.
    """
    items = F.col(list_column)
    starts = F.sequence(F.lit(0), F.size(items) - size)
    hashed = F.transform(starts, lambda i: F.xxhash64(*[F.get(items, i + k) for k in range(size)]))
    hashed = F.when(F.size(items) >= size, hashed).otherwise(F.array().cast("array<bigint>"))
    step = found.withColumn("__hashed", hashed)
    paired = F.transform("__hashed", lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    differ = F.size(F.array_distinct("__hashed")) == F.size("__hashed")
    step = step.withColumn("__pairs", F.when(~differ, F.sort_array(paired)))
    pairs = F.col("__pairs")
    twice = F.filter(pairs, lambda p, j: (p.h == F.get(pairs, j - 1).h) | (p.h == F.get(pairs, j + 1).h))
    step = step.withColumn("__places", F.sort_array(F.transform(twice, lambda p: p.i)))
    places = F.col("__places")
    reach = F.transform(places, lambda p, j: F.least(F.lit(size), F.coalesce(F.get(places, j + 1) - p, F.lit(size))))
    covered = F.aggregate(reach, F.lit(0).cast("long"), lambda a, x: a + x)
    return step.withColumn(out, F.coalesce(covered, F.lit(0).cast("long"))).drop("__hashed", "__pairs", "__places")


def quality_features(docs: DataFrame, text: str, host: str, carry: list[str]) -> DataFrame:
    """Per row: ``carry`` columns, host, content digest, the counts, and (hash, words) of each line. No text."""
    kept = [F.col(f"`{c}`") for c in carry]
    found = docs.select(*kept, F.col(f"`{host}`").alias("__host"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("__text"))
    found = found.withColumn("__words", words("__text")).withColumn("__lines", text_lines(F.col("__text")))
    found = repeated_windows(found, "__words", "n_repeat_words")
    lines = F.transform("__lines", lambda x: F.struct(F.xxhash64(normal_line(x)).alias("hash"), F.size(words(x)).alias("words")))
    long = lambda column: column.cast("long")
    return found.select(
        *kept, "__host", F.xxhash64("__text").alias("__content"), F.monotonically_increasing_id().alias("__row"),
        long(F.size("__words")).alias("n_words"),
        long(F.length(F.array_join("__words", ""))).alias("word_chars"),
        long(F.length("__text") - F.length(F.regexp_replace("__text", SYMBOLS, ""))).alias("n_symbols"),
        long(F.size("__lines") - F.size(F.array_distinct("__lines"))).alias("n_dup_lines"),
        "n_repeat_words", lines.alias("__hashes"),
    )


def frequent_lines(features: DataFrame, least: int, share: float) -> DataFrame:
    """(__host, hash) of lines in more distinct documents of the host than ``least`` and ``share`` of its documents."""
    contents = features.select("__host", "__content").distinct().groupBy("__host").agg(F.count("*").alias("__documents"))
    lines = features.select("__host", "__content", F.explode(F.array_distinct("__hashes.hash")).alias("hash"))
    shared = lines.distinct().groupBy("__host", "hash").agg(F.count("*").alias("__in")).where(F.col("__in") > least)
    joined = shared.join(contents, same(shared, contents, ["__host"]))
    return joined.where(F.col("__in") > share * F.col("__documents")).select(shared["__host"], "hash")


def judged(
    features: DataFrame, least: int = 20, share: float = 0.05, fewest_words: int = 50, repeat_percent: int = 50,
    depleted: float = 0.5,
) -> DataFrame:
    """``features`` with ``base_failed``, ``removed`` (hashes of the lines to remove), ``n_removed_words``, ``kept``."""
    frequent = frequent_lines(features, least, share)
    lines = features.select("__row", "__host", F.explode("__hashes").alias("line"))
    lines = lines.select("__row", "__host", F.col("line.hash").alias("hash"), F.col("line.words").alias("words"))
    hit = lines.join(frequent, same(lines, frequent, ["__host", "hash"]), "left_semi")
    removed = hit.groupBy("__row").agg(
        F.sum("words").cast("long").alias("__lost"), F.collect_set("hash").alias("__removed")
    )
    lost = F.coalesce(F.col("__lost"), F.lit(0).cast("long"))
    failed = (F.col("n_words") < fewest_words) | (100 * F.col("n_repeat_words") > repeat_percent * F.col("n_words"))
    return features.join(removed, "__row", "left").select(
        *[features[f"`{c}`"] for c in features.columns], failed.alias("base_failed"), lost.alias("n_removed_words"),
        F.coalesce("__removed", F.array().cast("array<bigint>")).alias("removed"),
        (~failed & (lost <= depleted * F.col("n_words"))).alias("kept"),
    )


def quality_rules(docs: DataFrame, text: str = "text", host: str = "source", carry: tuple[str, ...] = ("doc_id",), **limits) -> DataFrame:
    """One row per document: ``carry``, the counts, ``base_failed``, ``n_removed_words`` and ``kept``."""
    features = written(quality_features(docs, text, host, list(carry)), "quality")
    return judged(features, **limits).drop("__host", "__content", "__row", "__hashes", "removed")


def apply_quality(docs: DataFrame, text: str = "text", host: str = "source", **limits) -> DataFrame:
    """The kept documents, all their columns, without their boiler-plate lines; ``n_chars`` follows if there is one."""
    features = written(quality_features(docs, text, host, []), "quality")
    rows = judged(features, **limits).where("kept").select("__host", "__content", "removed").distinct()
    keyed = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__doc"), F.col(f"`{host}`").alias("__host"),
        F.xxhash64(F.coalesce(F.col(f"`{text}`"), F.lit(""))).alias("__content"),
    )
    joined = keyed.join(rows.hint("shuffle_hash"), same(keyed, rows, ["__host", "__content"]))
    whole = F.col("__doc").getField(text)
    rest = F.filter(F.split(whole, "\n"), lambda x: ~F.array_contains(F.col("removed"), F.xxhash64(normal_line(x))))
    clean = F.when(F.size("removed") > 0, F.array_join(rest, "\n")).otherwise(whole)
    out = joined.select(*[(clean if c == text else F.col("__doc").getField(c)).alias(c) for c in docs.columns])
    return out.withColumn("n_chars", F.length(F.col(f"`{text}`")).cast("long")) if "n_chars" in docs.columns and text != "n_chars" else out


def op7_quality_rules(spark, folder: str) -> DataFrame:
    return quality_rules(table(spark, folder, "documents").select("doc_id", "source", "text"))
