"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

A document is cut into blocks of at most ``block_words`` words. A source whose target is q times its size and R words
more gives all its blocks q times, and once more the first blocks of a random permutation until R words are reached (the
last of them in part), so that the words taken are the target, rounded. These exact block quotas, one number per
source, are split among the output shards: the tree halves the shards again and again, and a multivariate
hypergeometric draw says how many blocks of each source go left. Each shard so owns an interval of each source's
permutation: its blocks are disjoint from all others', and it shuffles them by hash.

The permutation is a hash order. Ranks and running words come from narrow block rows: bins of about ``BIN`` blocks,
dealt by hash, are ordered each on its own, and bin totals are summed up over two levels, so no source meets in one task.

Only one row per source reaches the driver: its quota, whose number the weights fix.

Defined results: null or blank texts have no blocks and are not taken; a null source is the last source; repeated rows are
documents of their own in ``mix_documents`` and one document with all copies in ``mixed_texts``; empty in, empty out.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, same, ship_code, table, words, written

#: Weights of the sources in code point order, repeating, and the most copies.
WEIGHTS = (5, 2, 1)
MOST = 3
#: Blocks in a bin of the permutation.
BIN = 512
#: Up to so many source rows go to every task; more are joined.
SENT_SOURCES = 10_000


def source_targets(sized: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(__source, s, source_size, n_blocks, target) from rows (__source, size, blocks).

    Targets share all words by weight; one that exceeds ``most`` times its source stops there and its excess goes to the
    others: sources in order of the level at which they fill, the level of the rest being the same for all.
    """
    sums = sized.groupBy("__source").agg(F.sum("size").alias("source_size"), F.sum("blocks").alias("n_blocks"))
    by_name = Window.orderBy(F.col("__source").asc_nulls_last())
    number = F.row_number().over(by_name)
    weight = F.get(F.array(*[F.lit(float(w)) for w in weights]), (number - 1) % len(weights))
    rows = sums.select("*", number.alias("s"), weight.alias("w"), (F.lit(float(most)) * F.col("source_size")).alias("cap"))
    rows = rows.withColumn("fills", F.col("cap") / F.col("w"))
    filling = Window.orderBy("fills", "s")
    before = filling.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy("fills", "s").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    weights_left = F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0.0))
    rows = rows.withColumn("level", left / weights_left)
    level = F.min(F.when(F.col("level") <= F.col("fills"), F.struct("fills", "s", "level"))).over(every)["level"]
    rows = rows.withColumn("target", F.least(F.col("cap"), F.coalesce(level, F.col("fills")) * F.col("w")))
    return rows.select("__source", "s", "source_size", "n_blocks", "target")


def _hypergeometric(rng: np.random.Generator, good: int, bad: int, drawn: int) -> int:
    """A hypergeometric draw; above a billion blocks by its normal law, within the possible range."""
    total = good + bad
    if total < 1_000_000_000:
        return int(rng.hypergeometric(good, bad, drawn))
    share = good / total
    spread = (drawn * share * (1 - share) * (total - drawn) / (total - 1)) ** 0.5
    return int(min(max(round(drawn * share + spread * rng.standard_normal()), 0, drawn - bad), good, drawn))


def splitting_tree(quotas: Sequence[int], shards: int, seed: int) -> np.ndarray:
    """(shards, sources): how many blocks of each source each shard gets. Columns sum to ``quotas``; rows differ by one at most."""
    out = np.zeros((shards, len(quotas)), np.int64)

    def split(own: list[int], first: int, number: int) -> None:
        if number == 1:
            out[first] = own
            return
        half, total = number // 2, sum(own)
        ends = [(first + half) * sum(quotas) // shards - first * sum(quotas) // shards]
        rng = np.random.default_rng([seed, first, number])
        left, rest, need = [], total, ends[0]
        for n in own:
            rest -= n
            taken = _hypergeometric(rng, n, rest, need) if need and n else 0
            left.append(taken)
            need -= taken
        split(left, first, half)
        split([a - b for a, b in zip(own, left, strict=True)], first + half, number - half)

    split([int(q) for q in quotas], 0, shards)
    return out


def _sent(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= SENT_SOURCES else df


def _bin_offsets(blocks: DataFrame) -> DataFrame:
    """(s, bin, blocks_before, words_before): totals of all earlier bins of the source."""
    bins = blocks.groupBy("s", "bin").agg(F.count("*").alias("n"), F.sum("words").alias("w"))
    bins = bins.withColumn("top", F.shiftright("bin", 10))
    inside = Window.partitionBy("s", "top").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    above = Window.partitionBy("s").orderBy("top").rowsBetween(Window.unboundedPreceding, -1)
    zero = lambda c: F.coalesce(c, F.lit(0))
    tops = bins.groupBy("s", "top").agg(F.sum("n").alias("n"), F.sum("w").alias("w"))
    tops = tops.select("s", "top", zero(F.sum("n").over(above)).alias("tn"), zero(F.sum("w").over(above)).alias("tw"))
    bins = bins.select("s", "bin", "top", zero(F.sum("n").over(inside)).alias("bn"), zero(F.sum("w").over(inside)).alias("bw"))
    return bins.join(tops, ["s", "top"]).select(
        "s", "bin", (F.col("bn") + F.col("tn")).alias("blocks_before"), (F.col("bw") + F.col("tw")).alias("words_before")
    )


class Mix:
    """The plan of a mix: ``sized`` (one row per document), ``sources``, and ``draws`` (one row per block and copy)."""

    def __init__(
        self, docs: DataFrame, text: str = "text", source: str = "source", carry: Sequence[str] = ("doc_id",),
        weights: Sequence[int] = WEIGHTS, most: int = MOST, block_words: int = 1024, shards: int = 16, seed: int = 17,
    ):
        kept = [F.col(f"`{c}`").alias(f"__carry_{i}") for i, c in enumerate(carry)]
        self.carry, self.shards, self.seed = list(carry), shards, seed
        size = F.size(words(F.col(f"`{text}`"))).cast("long")
        sized = docs.select(
            *kept, F.col(f"`{source}`").alias("__source"), size.alias("size"), F.monotonically_increasing_id().alias("__row"),
            F.xxhash64(F.coalesce(F.col(f"`{text}`"), F.lit(""))).alias("__content"),
        )
        self.sized = written(sized.withColumn("blocks", F.ceil(F.col("size") / block_words).cast("long")), "mix-sizes")
        self.sources = written(source_targets(self.sized, weights, most), "mix-sources")
        number = self.sources.count()
        whole = F.round("target").cast("long")
        plan = self.sources.where("source_size > 0").select(
            "__source", "s", "n_blocks", F.floor(whole / F.col("source_size")).cast("long").alias("passes"),
            (whole % F.col("source_size")).alias("rest"),
        )
        rows = self.sized.where("size > 0")
        plan_rows = _sent(plan, number)
        rows = rows.join(plan_rows, rows["__source"].eqNullSafe(plan["__source"])).drop(plan["__source"])
        number_of = F.explode(F.sequence(F.lit(0), (F.col("blocks") - 1).cast("int")))
        ids = [f"__carry_{i}" for i in range(len(carry))]
        blocks = rows.select("__row", "__content", *ids, "s", "size", "n_blocks", "passes", "rest", number_of.alias("block"))
        place = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col("__content"), *[F.col(c) for c in ids], F.col("block")), 11)
        bins = F.ceil(F.col("n_blocks") / BIN)
        blocks = blocks.select(
            "__row", "__content", "s", "block", "passes", "rest", place.alias("place"),
            F.least(F.lit(block_words), F.col("size") - F.col("block") * block_words).cast("long").alias("words"),
            F.least(F.floor(place / F.lit(float(1 << 53)) * bins), bins - 1).cast("long").alias("bin"),
        )
        order = Window.partitionBy("s", "bin").orderBy("place", "__content", "block", "__row")
        ranked = blocks.withColumn("rank", F.row_number().over(order)).withColumn(
            "through", F.sum("words").over(order.rowsBetween(Window.unboundedPreceding, 0))
        )
        ranked = ranked.join(_bin_offsets(blocks), ["s", "bin"])
        before = F.col("words_before") + F.col("through") - F.col("words")
        self.ranked = written(ranked.select(
            "__row", "__content", "s", "block", "passes", "words", (F.col("blocks_before") + F.col("rank") - 1).alias("rank"),
            F.least(F.col("words"), F.greatest(F.col("rest") - before, F.lit(0))).alias("more"),
        ), "mix-ranks")
        self.draws = self._draws(number)

    def _draws(self, number: int) -> DataFrame:
        """(__row, s, block, copy, words, shard, order): every block that the mix takes, once per copy."""
        quotas = self.ranked.groupBy("s").agg(
            F.count("*").alias("n"), F.first("passes").alias("q"), F.sum((F.col("more") > 0).cast("long")).alias("m")
        ).orderBy("s").collect()
        tree = splitting_tree([r.q * r.n + r.m for r in quotas], self.shards, self.seed)
        ends = [(r.s, r.n, [int(x) for x in np.cumsum(tree[:, i])]) for i, r in enumerate(quotas)]
        bounds = self.ranked.sparkSession.createDataFrame(ends, "s int, n long, ends array<long>")
        copies = F.concat(
            F.transform(F.sequence(F.lit(1).cast("long"), F.greatest(F.col("passes"), F.lit(1))), lambda p: F.when(p <= F.col("passes"), F.struct((p - 1).cast("long").alias("copy"), F.col("words").alias("words")))),
            F.array(F.when(F.col("more") > 0, F.struct(F.col("passes").alias("copy"), F.col("more").alias("words")))),
        )
        taken = self.ranked.select("__row", "__content", "s", "block", "rank", F.explode(F.filter(copies, lambda c: c.isNotNull())).alias("c"))
        taken = taken.select("__row", "__content", "s", "block", "rank", "c.copy", "c.words")
        drawn = taken.join(_sent(bounds, number), "s")
        at = F.col("copy") * F.col("n") + F.col("rank")
        shard = F.size(F.filter("ends", lambda e: e <= at))
        return drawn.select(
            "__row", "s", "block", "copy", "words", shard.alias("shard"),
            F.xxhash64(F.lit(self.seed + 1), "__content", "block", "copy").alias("order"),
        )

    def carried(self) -> list[Column]:
        return [F.col(f"__carry_{i}").alias(c) for i, c in enumerate(self.carry)]


def mix_documents(docs: DataFrame, **how) -> DataFrame:
    """One row per document: ``carry``, size, source_size, target, taken, and into how many shards it goes."""
    mix = Mix(docs, **how)
    taken = mix.draws.groupBy("__row").agg(F.sum("words").alias("__taken"), F.size(F.collect_set("shard")).alias("__shards"))
    source = _sent(mix.sources.select("__source", "source_size", "target"), mix.sources.count())
    rows = mix.sized.join(source, mix.sized["__source"].eqNullSafe(source["__source"])).drop("__source").join(taken, "__row", "left")
    return rows.select(
        *mix.carried(), "size", "source_size", "target", F.coalesce("__taken", F.lit(0)).cast("long").alias("taken"),
        F.coalesce("__shards", F.lit(0)).alias("n_shards"),
    )


def cut(text: str, takes: list[tuple[int, int]], block_words: int) -> str:
    """The first ``words`` of each block (block, words) of a text, in order, with the white space that follows them."""
    starts = [m.start() for m in re.finditer(WORD, text)] + [len(text)]
    ends = [starts[min(b * block_words + n, len(starts) - 1)] for b, n in takes]
    return "".join(text[starts[b * block_words]:e] for (b, _), e in zip(takes, ends, strict=True))


def mixed_texts(docs: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id", block_words: int = 1024, **how) -> DataFrame:
    """The mix itself: a row for each document and copy with all columns of ``docs``; a copy that is taken in part holds
    the blocks drawn. ``__shard`` and ``__order`` (of its first block) say where it goes. ``n_chars`` follows the text."""
    ship_code(docs.sparkSession)
    mix = Mix(docs, text, source, (key,), block_words=block_words, **how)
    copies = mix.draws.groupBy("__row", "copy").agg(
        F.sum("words").alias("words"), F.sort_array(F.collect_list(F.struct("block", "words"))).alias("takes"),
        F.min(F.struct("block", "shard", "order")).alias("at"),
    )
    drawn = copies.join(mix.sized, "__row").select(
        F.col("__carry_0").alias("__key"), "__source", "__content", (copies["words"] < F.col("size")).alias("partial"), "takes", "at"
    )
    first = mix.sized.groupBy(F.col("__carry_0").alias("__key"), "__source", "__content").count()
    keys = ["__key", "__source", "__content"]
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__doc"), F.col(f"`{key}`").alias("__key"),
        F.col(f"`{source}`").alias("__source"), F.xxhash64(F.coalesce(F.col(f"`{text}`"), F.lit(""))).alias("__content"),
    )
    if not first.where("count > 1").isEmpty():
        turn = Window.partitionBy(*keys).orderBy(F.xxhash64("__doc"))
        rows = rows.withColumn("__turn", F.row_number().over(turn)).where("__turn = 1").drop("__turn")
    joined = rows.join(drawn.hint("shuffle_hash"), same(rows, drawn, keys))

    @F.pandas_udf("string")
    def part(texts: pd.Series, takes: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else cut(x, [(t["block"], t["words"]) for t in ts], block_words) for x, ts in zip(texts, takes, strict=True)])

    whole = F.col("__doc").getField(text)
    cuts = part(F.when(F.col("partial"), whole), F.when(F.col("partial"), F.col("takes")))
    picked = joined.withColumn("__text", F.coalesce(cuts, whole))
    out = [F.length("__text").cast("long").alias(c) if c == "n_chars" else F.col("__text").alias(c) if c == text else F.col("__doc").getField(c).alias(c) for c in docs.columns]
    return picked.select(*out, F.col("at.shard").alias("__shard"), F.col("at.order").alias("__order"))


def write_shards(mixed: DataFrame, path: str, shards: int = 16) -> None:
    """A folder per shard, each in its own random order."""
    mixed.repartition(shards, "__shard").sortWithinPartitions("__shard", "__order").write.partitionBy("__shard").parquet(path)


def op4_source_mix(spark, folder: str) -> DataFrame:
    return mix_documents(table(spark, folder, "documents").select("doc_id", "source", "text"))
