r"""Line dedup by content-defined chunks of lines: repeated multi-line chunks go, except the first.

The ``\n``-split lines of a text are hashed. Rolling hashes over the hashes of one or two lines with words choose boundaries,
in ``len(WINDOWS)`` seeded sets at once: in a set, the hash rolled ahead from a line decides whether a chunk opens before it,
the hash rolled up to a line whether a chunk closes after it. A chunk runs from an opening line to the closing line that
follows and depends on nothing outside it; it moves with its lines. Two lines with words are a chunk of one of the sets in all
but one of a hundred cases, so the union of the sets also covers passages of two lines. Blank lines belong to a chunk only
between its lines with words, of which it has at least two: a title that a blank line follows is no chunk.

Narrow rows (chunk hash, place) find the chunk hashes that occur more than once, and each chunk's first occurrence (least key,
then content, then place). Every later occurrence is extended over equal neighbouring lines, where the sets have left a gap,
by a join with the neighbours of both occurrences, until nothing grows. Then texts meet their chunks once, and the chunks of
equal hash are compared byte by byte (least and greatest text of a hash, pre-aggregated). Where one hash stands for several
texts, their chunks are matched by text instead.

Some occurrence of every line stays: a removed line equals an earlier one, and so on down to a first. Equal chunks meet by
partial aggregation and joins of written tables, which skew handling can split; no chunk is gathered as one group.

Defined results: null and empty texts stay as they are; rows equal in key and text count as one document, and each keeps its
row; equal texts of different keys lose all chunks but in the first; a document that loses all its lines keeps an empty text.
A single line that repeats stays, as does a passage of one line. Texts are taken whole, however long. An empty table gives an
empty result. Other columns pass through, whatever their names, but for those with two leading underscores, which are refused.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, same, table, written

#: Lines that the rolling hash of each boundary set covers.
WINDOWS = (1,) * 12 + (2,) * 4


def _hash(line: Column) -> Column:
    return F.xxhash64(line)


def _turned(h: Column, by: int) -> Column:
    return F.shiftleft(h, by).bitwiseOR(F.shiftrightunsigned(h, 64 - by)) if by else h


def _marks(hashes: Column, worded: Column) -> Column:
    """Two numbers per line with words: bit s is 1 if a chunk of set s opens before the line, or closes after it."""
    sets = {w: sum(1 << s for s, x in enumerate(WINDOWS) if x == w) for w in sorted(set(WINDOWS))}

    def mark(i: Column, opening: bool) -> Column:
        total = F.lit(0).cast("long")
        for window, bits in sets.items():
            rolled = F.lit(0).cast("long")
            for at in range(window):
                line = F.get(hashes, F.get(worded, i + (at if opening else at - window + 1)))
                rolled = rolled.bitwiseXOR(_turned(F.coalesce(line, F.lit(0).cast("long")), window - 1 - at))
            seed = F.lit(2 * window + opening).cast("long")
            total = total.bitwiseOR(F.xxhash64(rolled, seed).bitwiseAND(F.lit(bits).cast("long")))
        return total

    return F.transform(worded, lambda _, i: F.struct(mark(i, True).alias("opens"), mark(i, False).alias("closes")))


def chunked(docs: DataFrame, text: str, key: str) -> DataFrame:
    """One row per two neighbouring lines with words: __key, __content, first and last line, chunk hash, and whether it is a chunk
    of one of the sets (else it is a gap that extension may cross)."""
    rows = docs.select(F.col(f"`{key}`").alias("__key"), F.col(f"`{text}`").alias("__text")).where("__text IS NOT NULL")
    rows = rows.select("__key", F.xxhash64("__text").alias("__content"), F.split("__text", "\n").alias("__lines"))
    rows = rows.select(
        "__key", "__content", F.transform("__lines", _hash).alias("__h"),
        F.filter(F.transform("__lines", lambda x, i: F.when(F.btrim(x, F.lit(SPACES)) != "", i)), lambda i: i.isNotNull()).alias("__w"),
    ).where("size(__w) > 1")
    # one column that is used twice: a column used once would be computed anew for every line
    rows = rows.withColumn("__m", _marks(F.col("__h"), F.col("__w")))
    at, marks = F.col("__w"), F.col("__m")

    def chunk(first: Column, i: Column) -> Column:
        last = F.get(at, i + 1)
        return F.struct(
            first.alias("first"), last.alias("last"), F.xxhash64(F.slice("__h", first + 1, last - first + 1)).alias("hash"),
            (F.get(marks, i)["opens"].bitwiseAND(F.get(marks, i + 1)["closes"]) != 0).alias("caught"),
        )

    spans = F.transform(F.slice("__w", 1, F.size("__w") - 1), chunk)
    return rows.select("__key", "__content", F.inline(spans))


def _order(first: str = "first") -> Column:
    return F.struct(F.col("__key").isNull().alias("n"), F.col("__key").alias("k"), F.col("__content").alias("c"), F.col(first).alias("p"))


def _grown(frontier: DataFrame, gaps: DataFrame, edge: str, end: str) -> DataFrame:
    """Matches one gap further on the side of ``edge``, where both occurrences have equal neighbours."""
    side = gaps.select(
        F.col("__key").alias("__k"), F.col("__content").alias("__c"), F.col(end).alias("__at"), F.col("first").alias("__first"), F.col("last").alias("__last"),
        F.col("hash").alias("__hash"),
    )
    own = frontier.join(side, F.col("__key").eqNullSafe(F.col("__k")) & (F.col("__content") == F.col("__c")) & (F.col(edge) == F.col("__at")))
    own = own.select("__key", "__content", F.col("__first").alias("first"), F.col("__last").alias("last"), F.col("__hash").alias("hash"), "of", F.col(f"of.{edge}").alias("__edge"))
    met = own.join(
        side, F.col("of.key").eqNullSafe(F.col("__k")) & (F.col("of.content") == F.col("__c")) & (F.col("__edge") == F.col("__at")) & (F.col("hash") == F.col("__hash"))
    )
    of = F.struct(F.col("of.key"), F.col("of.content"), F.col("__first").alias("first"), F.col("__last").alias("last"))
    return met.select("__key", "__content", "first", "last", "hash", of.alias("of"))


def repeated_chunks(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Every later occurrence of a repeated chunk (__key, __content, first, last, hash) with the first one it is matched with, ``of``.

    Chunks match by hash; ``dedup_lines`` compares their bytes.
    """
    chunks = written(chunked(docs, text, key), "line-chunks")
    caught = chunks.where("caught").drop("caught")
    often = written(caught.groupBy("hash").agg(F.count("*").alias("n")).where("n > 1").drop("n"), "chunk-hashes")
    found = written(caught.join(often, "hash", "left_semi").withColumn("__order", _order()), "chunks")
    # written, so that the join shuffles both sides anew and a chunk that is everywhere can be split
    firsts = written(found.groupBy("hash").agg(F.min("__order").alias("__least")), "first-chunks")
    met = found.join(firsts, "hash").where(~F.col("__order").eqNullSafe(F.col("__least")))
    of = F.struct(
        F.col("__least.k").alias("key"), F.col("__least.c").alias("content"), F.col("__least.p").alias("first"),
        (F.col("__least.p") + F.col("last") - F.col("first")).alias("last"),
    )
    columns = ["__key", "__content", "first", "last", "hash", "of"]
    matches = written(met.withColumn("of", of).select(*columns).distinct(), "matches")
    every, gaps = matches, chunks.where("NOT caught").distinct()
    for edge, end in (("first", "last"), ("last", "first")):  # each side moves one way only, so it ends
        frontier = matches
        while not (frontier := written(_grown(frontier, gaps, edge, end).distinct(), "grown-matches")).isEmpty():
            every = every.unionByName(frontier)
    return every


def _spans(matches: DataFrame) -> DataFrame:
    """The chunks of each document: __key, __content, and an array of (first, last, hash, whether it goes)."""
    gone = matches.select("__key", "__content", F.struct("first", "last", "hash", F.lit(True).alias("gone")).alias("s"))
    kept = matches.select(
        F.col("of.key").alias("__key"), F.col("of.content").alias("__content"),
        F.struct(F.col("of.first"), F.col("of.last"), F.col("hash"), F.lit(False).alias("gone")).alias("s"),
    )
    return gone.unionByName(kept).groupBy("__key", "__content").agg(F.collect_set("s").alias("__spans"))


def _with_text(span: Column) -> Column:
    """A span and its text: its first line and those that follow."""
    after = F.array_join(F.slice("__lines", span["first"] + 2, span["last"] - span["first"]), "\n")
    text = F.concat(F.get(F.col("__lines"), span["first"]), F.lit("\n"), after)
    return F.struct(*[span[c].alias(c) for c in ("first", "last", "hash", "gone")], text.alias("chunk"))


def _marked(rows: DataFrame, spans: DataFrame, label: str) -> DataFrame:
    spans = written(spans, f"{label}-spans")
    joined = rows.join(spans.hint("shuffle_hash"), same(rows, spans, ["__key", "__content"]), "left")
    return written(joined.select("__doc", rows["__key"], rows["__content"], "__spans"), label)


def _matched_by_text(texts: DataFrame, odd: DataFrame) -> DataFrame:
    """The spans of documents after chunks under ``odd`` hashes have been matched by their text."""
    mixed = written(texts.join(odd, "hash", "left_semi").drop("gone").distinct().withColumn("__order", _order()), "odd-chunks")
    least = written(mixed.groupBy("hash", "chunk").agg(F.min("__order").alias("__least")), "odd-first")
    again = mixed.join(least, ["hash", "chunk"]).select("__key", "__content", "first", "last", "hash", (~F.col("__order").eqNullSafe(F.col("__least"))).alias("gone"))
    clear = texts.join(odd, "hash", "left_anti").select("__key", "__content", "first", "last", "hash", "gone")
    return clear.unionByName(again).groupBy("__key", "__content").agg(F.collect_set(F.struct("first", "last", "hash", "gone")).alias("__spans"))


def dedup_lines(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """All rows and columns, texts without their repeated chunks (``n_chars`` follows), and ``__removed_chunks``."""
    clash = [c for c in docs.columns if c.startswith("__")]
    if clash:
        raise ValueError(f"columns with two leading underscores are the operator's own: {clash}")
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__doc"), F.col(f"`{key}`").alias("__key"),
        F.xxhash64(F.col(f"`{text}`")).alias("__content"),
    )
    marked = _marked(rows, _spans(repeated_chunks(docs, text, key)), "marked-documents")
    texts = marked.where("__spans IS NOT NULL").select("__key", "__content", "__spans", F.split(F.col("__doc").getField(text), "\n").alias("__lines"))
    texts = texts.select("__key", "__content", F.inline(F.transform("__spans", _with_text)))
    odd = written(texts.groupBy("hash").agg(F.min("chunk").alias("a"), F.max("chunk").alias("b")).where("a <> b").select("hash"), "odd-hashes")
    if not odd.isEmpty():
        marked = _marked(rows, _matched_by_text(texts, odd), "marked-again")
    gone = F.filter("__spans", lambda s: s["gone"])
    cut = marked.select("__doc", F.col("__doc").getField(text).alias("__text"), F.when(F.size(gone) > 0, gone).alias("__gone"))
    cut = cut.withColumn("__lines", F.split(F.when(F.col("__gone").isNotNull(), F.col("__text")), "\n"))
    places = F.array_distinct(F.flatten(F.transform("__gone", lambda s: F.sequence(s["first"], s["last"]))))
    stay = F.array_except(F.sequence(F.lit(0), F.size("__lines") - 1), places)
    rest = F.array_join(F.transform(stay, lambda i: F.get(F.col("__lines"), i)), "\n")
    cut = cut.withColumn("__clean", F.when(F.col("__gone").isNull(), F.col("__text")).otherwise(rest))
    out = [
        F.col("__clean").alias(c) if c == text else F.length("__clean").cast("long").alias(c) if c == "n_chars" else F.col("__doc").getField(c).alias(c)
        for c in docs.columns
    ]
    return cut.select(*out, F.coalesce(F.size("__gone"), F.lit(0)).alias("__removed_chunks"))


def op5_line_dedup(spark, folder: str) -> DataFrame:
    """Every document with its remaining text."""
    clean = dedup_lines(table(spark, folder, "documents").select("doc_id", "text"))
    return clean.select("doc_id", F.col("__removed_chunks").alias("n_removed_chunks"), "text")
