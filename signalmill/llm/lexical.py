r"""Ranked lexical search over posting lists that are cut into geometric blocks.

Documents are read once and packed into shards (at most ``SHARD_DOCS`` documents or ``SHARD_POSTINGS`` postings that hold a
term of the queries), one row each, written. Corpus counts come from the shards: documents, terms, documents per term. Every
posting list of a shard is then clustered by document similarity: documents are projected to ``SKETCH`` random signs of their
weighted impacts, lists take the nearest of evenly spaced centres, centres move to the mean once, and a cluster becomes blocks
of at most ``BLOCK`` documents, nearest first. Each block stores the coordinatewise maximum of its documents' impacts over the
terms of the queries that can come to its list. That index is written, too.

A query visits its lists by falling greatest contribution. A block is skipped only when the query's score of the block's maxima,
an exact upper bound, is below the query's limit; the documents of all other blocks are scored exactly, from their own rows.
The limit is the k-th best score known: found in the shard so far, or in the first ``LIMIT_SHARDS`` shards, which are searched
before (any part of the corpus gives a valid lower limit). Lists are left out, and the rest of them is not visited, when all
their terms together cannot reach the limit. So results are exact, and a shard returns only rows that reach the limit.

Impacts and scores are 64-bit integers as the contract of ``op12`` defines them; sums of bounds stay below 2^53 and are exact
in doubles. The queries are the stated set: they are taken in blocks of at most ``ITEMS`` items or ``TERMS`` distinct terms
(an item is never cut), one pass over the documents each; only such a block is ever on the driver or sent to tasks.

Defined results: null and empty texts have no terms; a document without terms counts nowhere. Texts are read whole, however
long. Every row of the documents is a document: repeated rows are ranked one by one; a null id comes last among equal scores.
Items without terms, or whose terms weigh nothing, give no rows; the texts of a repeated item id count as one item, and a null
id is an item. Empty tables give an empty result. Other columns of either table are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ship_code, table, written

SHARD_DOCS, SHARD_POSTINGS = 8192, 1 << 20
BLOCK, SKETCH = 32, 32
LIMIT_SHARDS = 4
ITEMS, TERMS = 4096, 1 << 18

#: Bytes of terms: digits, letters (A-Z lowered) and all bytes of characters beyond ASCII; the rest separates.
_TERM_BYTES = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256)
)


def terms_of(text: bytes | None) -> list[bytes]:
    return text.translate(_TERM_BYTES).split() if text else []


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(item, text) to (item, term), each once a batch."""
    for batch in batches:
        ids, texts = batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()
        found = sorted({(i is not None, i or 0, term) for i, text in zip(ids, texts, strict=True) for term in terms_of(text)})
        yield pa.RecordBatch.from_arrays(
            [pa.array([i if there else None for there, i, _ in found], pa.int64()), pa.array([t for *_, t in found], pa.binary())], ["item", "term"]
        )


def _blocks_of_items(rows: DataFrame) -> Iterator[list[tuple[int | None, list[bytes]]]]:
    """Blocks of (item, its terms) from distinct (item, term) rows."""
    block, seen = [], set()
    for row in rows.orderBy("item", "term").toLocalIterator(prefetchPartitions=True):
        term = bytes(row["term"])
        if not block or block[-1][0] != row["item"]:
            if len(block) >= ITEMS or len(seen) >= TERMS:
                yield block
                block, seen = [], set()
            block.append((row["item"], []))
        block[-1][1].append(term)
        seen.add(term)
    if block:
        yield block


def _pack(vocabulary: dict[bytes, int]):
    """(id, text) to shards: ids, lengths and the term counts of documents that hold a term of the vocabulary."""

    def shard(number: int, ids: list, lengths: list, rows: list[dict[int, int]], n_docs: int, n_terms: int) -> pa.RecordBatch:
        starts = np.concatenate(([0], np.cumsum([len(r) for r in rows]))).astype(np.int32)
        terms = np.fromiter((t for r in rows for t in r), np.int32, starts[-1])
        counts = np.fromiter((c for r in rows for c in r.values()), np.int64, starts[-1])
        held, dfs = np.unique(terms, return_counts=True)
        one = lambda values, kind: pa.array([values], pa.list_(kind))
        return pa.RecordBatch.from_pydict({
            "shard": pa.array([number], pa.int64()), "n_docs": pa.array([n_docs], pa.int64()), "n_terms": pa.array([n_terms], pa.int64()),
            "ids": one(ids, pa.int64()), "lengths": one(lengths, pa.int64()), "starts": one(starts, pa.int32()),
            "terms": one(terms, pa.int32()), "counts": one(counts, pa.int64()), "held": one(held, pa.int32()), "dfs": one(dfs, pa.int64()),
        })

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        ids, lengths, rows, n_docs, n_terms, postings = [], [], [], 0, 0, 0
        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), batch.column(1).cast(pa.large_binary())
            for i, key in enumerate(keys):
                found = terms_of(texts[i].as_py())
                if not found:
                    continue
                n_docs, n_terms = n_docs + 1, n_terms + len(found)
                counts = Counter(found)
                row = {vocabulary[t]: counts[t] for t in counts.keys() & vocabulary.keys()}
                if row:
                    ids.append(key)
                    lengths.append(len(found))
                    rows.append(row)
                    postings += len(row)
                if len(ids) >= SHARD_DOCS or postings >= SHARD_POSTINGS:
                    yield shard(number, ids, lengths, rows, n_docs, n_terms)
                    number += 1
                    ids, lengths, rows, n_docs, n_terms, postings = [], [], [], 0, 0, 0
        if n_docs:
            yield shard(number, ids, lengths, rows, n_docs, n_terms)

    return run


PACKED = (
    "shard long, n_docs long, n_terms long, ids array<long>, lengths array<long>, starts array<int>, terms array<int>, counts array<long>, "
    "held array<int>, dfs array<long>"
)
LIST = "struct<term int, coordinates array<int>, sizes array<int>, docs array<int>, maxima binary>"
INDEX = f"shard long, ids array<long>, starts array<int>, terms array<int>, impacts array<long>, lists array<{LIST}>"


class Queries:
    """The terms of a block of items, the weights of terms, and the least score that can matter to each item."""

    def __init__(self, terms: list[np.ndarray], weights: np.ndarray, limits: np.ndarray, k: int):
        self.terms, self.weights, self.limits, self.k = terms, weights, limits, k

    def lists(self, greatest: np.ndarray, item: int) -> tuple[np.ndarray, np.ndarray]:
        """The terms whose lists an item visits, by falling contribution, and what each and all after them can give together."""
        terms = self.terms[item]
        most = self.weights[terms] * greatest[terms]
        order = np.argsort(-most, kind="stable")
        rest = np.cumsum(most[order][::-1])[::-1]
        visits = rest >= max(1, self.limits[item])
        return terms[order][visits], rest[visits]


def _ranges(starts: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of all postings of some documents, and how many each has."""
    sizes = starts[docs + 1] - starts[docs]
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts[docs] - ends + sizes, sizes), sizes


def _greatest(terms: np.ndarray, impacts: np.ndarray, width: int) -> np.ndarray:
    out = np.zeros(width, np.int64)
    np.maximum.at(out, terms, impacts)
    return out


def sketches(starts: np.ndarray, terms: np.ndarray, values: np.ndarray, width: int) -> np.ndarray:
    """Unit projections of documents on random signs per term."""
    signs = np.random.default_rng(11).choice(np.array([-1, 1], np.float32), (width, SKETCH))
    out = np.zeros((len(starts) - 1, SKETCH), np.float32)
    for at in range(0, len(out), 512):
        docs = np.arange(at, min(at + 512, len(out)))
        where, sizes = _ranges(starts, docs)
        np.add.at(out, np.repeat(docs, sizes), signs[terms[where]] * values[where, None].astype(np.float32))
    return out / (np.sqrt((out * out).sum(1, keepdims=True)) + 1e-20)


def cluster(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order of the points in which similar ones stand together, and the sizes of blocks of at most BLOCK along it."""
    n = len(points)
    number = -(-n // BLOCK)
    if number == 1:
        return np.arange(n), np.array([n])
    centres = points[np.arange(number) * n // number]
    nearest = (points @ centres.T).argmax(1)
    moved = np.zeros_like(centres)
    np.add.at(moved, nearest, points)
    likeness = points @ (moved / (np.sqrt((moved * moved).sum(1, keepdims=True)) + 1e-20)).T
    nearest = likeness.argmax(1)
    order = np.lexsort((-likeness[np.arange(n), nearest], nearest))
    sizes = np.bincount(nearest, minlength=number)
    sizes = np.concatenate([[BLOCK] * (s // BLOCK) + ([s % BLOCK] if s % BLOCK else []) for s in sizes.tolist()]).astype(np.int64)
    return order, sizes


def _arrays(values: list[np.ndarray]) -> pa.ListArray:
    """Integer arrays as one column of lists."""
    offsets = np.concatenate(([0], np.cumsum([len(v) for v in values]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*values, np.zeros(0)]).astype(np.int32)))


def _lists_of(column: pa.ListScalar) -> list[dict]:
    """The stored lists of a shard, as numpy arrays."""
    parts = column.values
    fields = {name: parts.field(name) for name in ("term", "coordinates", "sizes", "docs", "maxima")}
    whole = {name: (fields[name].offsets.to_numpy(), fields[name].values.to_numpy()) for name in ("coordinates", "sizes", "docs")}
    return [
        {"term": fields["term"][i].as_py(), "maxima": fields["maxima"][i].as_py(), **{name: values[at[i]:at[i + 1]] for name, (at, values) in whole.items()}}
        for i in range(len(parts))
    ]


def _index(queries: Queries, n: int, total: int):
    """A packed shard to its index: impacts, and blocks with maxima for every list that a query visits."""
    width = len(queries.weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                lengths, starts, terms, counts = (batch.column(c)[i].values.to_numpy() for c in ("lengths", "starts", "terms", "counts"))
                m = 50 + (50 * lengths * n) // total
                impacts = (1_000_000_000 * counts) // (1000 * counts + 20 * np.repeat(m, np.diff(starts)))
                greatest = _greatest(terms, impacts, width)
                needed: dict[int, set[int]] = {}
                for item, own in enumerate(queries.terms):
                    for term in queries.lists(greatest, item)[0].tolist():
                        needed.setdefault(term, set()).update(own.tolist())
                points = sketches(starts, terms, impacts * queries.weights[terms], width)
                docs = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
                by_term = np.argsort(terms, kind="stable")
                first = np.searchsorted(terms[by_term], np.arange(width + 1))
                place = np.full(width, -1, np.int32)
                lists: dict[str, list] = {"term": [], "coordinates": [], "sizes": [], "docs": [], "maxima": []}
                for term, own in sorted(needed.items()):
                    held = docs[by_term[first[term]:first[term + 1]]]
                    order, sizes = cluster(points[held])
                    held = held[order]
                    coordinates = np.array(sorted(own), np.int32)
                    place[coordinates] = np.arange(len(coordinates))
                    where, each = _ranges(starts, held)
                    block = np.repeat(np.repeat(np.arange(len(sizes)), sizes), each)
                    column = place[terms[where]]
                    kept = column >= 0
                    maxima = np.zeros((len(sizes), len(coordinates)), np.int32)
                    np.maximum.at(maxima, (block[kept], column[kept]), impacts[where][kept].astype(np.int32))
                    place[coordinates] = -1
                    for name, value in (("term", term), ("coordinates", coordinates), ("sizes", sizes), ("docs", held), ("maxima", maxima.tobytes())):
                        lists[name].append(value)
                packed = pa.StructArray.from_arrays(
                    [pa.array(lists["term"], pa.int32()), *[_arrays(lists[c]) for c in ("coordinates", "sizes", "docs")], pa.array(lists["maxima"], pa.binary())], list(lists)
                )
                yield pa.RecordBatch.from_pydict({
                    **{c: batch.column(c).slice(i, 1) for c in ("shard", "ids", "starts", "terms")},
                    "impacts": pa.array([impacts], pa.list_(pa.int64())), "lists": pa.ListArray.from_arrays(pa.array([0, len(packed)], pa.int32()), packed),
                })

    return run


class Shard:
    """An indexed shard that answers queries; counts the blocks it has scored and skipped."""

    def __init__(self, starts: np.ndarray, terms: np.ndarray, impacts: np.ndarray, lists: list[dict], width: int):
        self.starts, self.terms, self.impacts = starts, terms, impacts
        self.greatest = _greatest(terms, impacts, width)
        self.lists = {}
        for part in lists:
            sizes, coordinates = np.asarray(part["sizes"]), np.asarray(part["coordinates"])
            maxima = np.frombuffer(part["maxima"], np.int32).reshape(len(sizes), len(coordinates)).astype(np.float64)
            self.lists[part["term"]] = (coordinates, np.concatenate(([0], np.cumsum(sizes))), np.asarray(part["docs"]), maxima)
        self.scored = self.skipped = 0

    def search(self, queries: Queries, item: int) -> tuple[np.ndarray, np.ndarray]:
        """(documents, scores) that can be among the k best of an item, its limit included."""
        weight = np.zeros(len(queries.weights), np.int64)
        weight[queries.terms[item]] = queries.weights[queries.terms[item]]
        limit = max(1, int(queries.limits[item]))
        seen = np.zeros(len(self.starts) - 1, bool)
        found, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for term, rest in zip(*(v.tolist() for v in queries.lists(self.greatest, item)), strict=True):
            if rest < limit:
                break
            coordinates, starts, docs, maxima = self.lists[term]
            open_ = np.flatnonzero(maxima @ weight[coordinates].astype(np.float64) >= limit)
            self.scored += len(open_)
            self.skipped += len(starts) - 1 - len(open_)
            if not len(open_):
                continue
            own = docs[_ranges(starts, open_)[0]]
            own = own[~seen[own]]
            seen[own] = True
            if not len(own):
                continue
            where, sizes = _ranges(self.starts, own)
            value = np.add.reduceat(weight[self.terms[where]] * self.impacts[where], np.cumsum(sizes) - sizes)
            found, scores = np.concatenate((found, own)), np.concatenate((scores, value))
            if len(scores) >= queries.k:
                limit = max(limit, int(np.partition(scores, -queries.k)[-queries.k]))
                kept = scores >= limit
                found, scores = found[kept], scores[kept]
        kept = scores >= limit
        return found[kept], scores[kept]


def _answer(queries: Queries):
    """Index rows to (item, doc_id, score): at most k rows an item, ties to smaller ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                shard = Shard(*(batch.column(c)[i].values.to_numpy() for c in ("starts", "terms", "impacts")), _lists_of(batch.column("lists")[i]), len(queries.weights))
                ids = batch.column("ids")[i].values
                missing, numbers = ids.is_null().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy()
                items, docs, scores = [], [], []
                for item in range(len(queries.terms)):
                    found, score = shard.search(queries, item)
                    best = np.lexsort((numbers[found], missing[found], -score))[: queries.k]
                    items.append(np.full(len(best), item))
                    docs.append(found[best])
                    scores.append(score[best])
                docs = np.concatenate(docs)
                yield pa.RecordBatch.from_pydict({
                    "item": pa.array(np.concatenate(items), pa.int32()), "doc_id": ids.take(pa.array(docs)), "score": pa.array(np.concatenate(scores), pa.int64()),
                })

    return run


def _best(rows: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _search_block(docs: DataFrame, block: list[tuple[int | None, list[bytes]]], k: int) -> DataFrame:
    spark = docs.sparkSession
    vocabulary = {t: i for i, t in enumerate(sorted({t for _, terms in block for t in terms}))}
    terms = [np.array(sorted(vocabulary[t] for t in own), np.int32) for _, own in block]
    shards = written(docs.mapInArrow(_pack(vocabulary), PACKED), "lexical-shards")
    n, total, number = shards.agg(F.sum("n_docs"), F.sum("n_terms"), F.count("*")).first()
    held = shards.select(F.explode(F.arrays_zip("held", "dfs")).alias("h")).groupBy("h.held").agg(F.sum("h.dfs").alias("df"))
    weights = np.zeros(len(vocabulary), np.int64)
    for term, df in held.collect():  # at most one row a term of the block
        weights[term] = math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))
    queries = Queries(terms, weights, np.zeros(len(terms), np.int64), k)
    if not number:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")

    def answers(of: DataFrame, label: str) -> DataFrame:
        tasks = max(1, min(of.count(), 10_000))
        index = written(of.repartition(tasks, "shard").mapInArrow(_index(queries, n, total), INDEX), f"lexical-index{label}")
        return index.mapInArrow(_answer(queries), "item int, doc_id long, score long")

    first = _best(answers(shards.join(F.broadcast(shards.select("shard").orderBy(F.xxhash64("shard"), "shard").limit(LIMIT_SHARDS)), "shard", "left_semi"), "-first"), k)
    for row in first.where(F.col("rank") == k).collect():  # at most one row an item of the block
        queries.limits[row["item"]] = row["score"]
    found = _best(written(answers(shards, ""), "lexical-found"), k)
    names = spark.createDataFrame([(i, own) for i, (own, _) in enumerate(block)], "item int, item_id long")
    return found.join(F.broadcast(names), "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def lexical_search(
    docs: DataFrame, items: DataFrame, text: str = "text", key: str = "doc_id", item_text: str = "text", item_key: str = "item_id", k: int = 50
) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` best documents of every item, exactly."""
    spark = docs.sparkSession
    ship_code(spark)
    pairs = items.select(F.col(f"`{item_key}`").cast("long").alias("item"), F.col(f"`{item_text}`").alias("text"))
    pairs = written(pairs.mapInArrow(_item_terms, "item long, term binary").distinct(), "lexical-items")
    rows = docs.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{text}`").alias("text"))
    out = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    for block in _blocks_of_items(pairs):
        out = out.unionByName(written(_search_block(rows, block, k), "lexical-ranks"))
    return out


def op12_lexical_search(spark, folder: str) -> DataFrame:
    return lexical_search(table(spark, folder, "documents").select("doc_id", "text"), table(spark, folder, "benchmark").select("item_id", "text"))


_SEPARATORS = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

OP12_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id,
                  regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_SEPARATORS}') AS ts FROM documents),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_SEPARATORS}')) AS term
      FROM benchmark),
sizes AS (SELECT count(*) AS n, sum(len(ts)) AS total FROM d WHERE len(ts) > 0),
postings AS (SELECT r, doc_id, term, count(*) AS tf, any_value(n) AS n FROM (SELECT r, doc_id, len(ts) AS n, unnest(ts) AS term FROM d) GROUP BY r, doc_id, term),
weights AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * any_value(s.n) + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w
            FROM postings, sizes s GROUP BY term),
scores AS (SELECT item_id, r, doc_id,
                  CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (CAST(50 * p.n * s.n AS BIGINT) // CAST(s.total AS BIGINT)))))) AS BIGINT) AS score
           FROM q JOIN postings p USING (term) JOIN weights USING (term), sizes s GROUP BY item_id, r, doc_id)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM scores WHERE score > 0 QUALIFY rank <= 50
"""
