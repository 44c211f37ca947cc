"""Approximate nearest neighbours with learned partitions.

On a bounded sample (``SAMPLE`` distinct vectors in hash order) a graph of nearest neighbours is built and cut into
balanced parts: halving by the graph's slowest mode, then moves of single nodes to the part that holds most of their
neighbours as long as sizes stay within a tenth. A small network learns, for a vector, the parts of its neighbours. It puts
every row of the table into its most probable part and sends every query to as many most probable parts as held-out
sample points need to find ``aim`` of their neighbouring ids. Candidates are ranked by exact double-precision distance.

Parts are cut into blocks of at most ``BLOCK`` candidates by hash, and their queries likewise, so a part that holds a third
of all rows is spread over tasks; each block pair gives at most ``k`` ids a query. Queries that found fewer than
exist are searched in all parts.

Defined results: vectors that are null, empty, zero or hold null or non-finite components take no part, nor do rows without
an id or vectors of another than the most common length; a repeated id counts once, with its nearest vector, however
often it occurs (equal rows are dropped before the table is placed); an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ship_code, table, written

SAMPLE, NEIGHBOURS, HIDDEN = 4096, 10, 96
#: Rows for one part to aim at, and the most parts: a sample of this size describes no more.
PART_ROWS, MOST_PARTS = 256, 128
BLOCK, QUERY_BLOCK = 4096, 1024


def neighbour_graph(x: np.ndarray, k: int) -> np.ndarray:
    """Indices of the k nearest other rows, (n, k)."""
    norms = (x * x).sum(1)
    out = np.empty((len(x), k), np.int64)
    for at in range(0, len(x), 512):
        d = norms[None, :] - 2 * x[at:at + 512] @ x.T
        d[np.arange(len(d)), np.arange(at, at + len(d))] = np.inf
        out[at:at + 512] = np.argpartition(d, k - 1, axis=1)[:, :k] if k < len(x) - 1 else np.argsort(d, axis=1)[:, :k]
    return out


def balanced_parts(graph: np.ndarray, parts: int, rng: np.random.Generator, rounds: int = 6) -> np.ndarray:
    """The part of each node: equal halvings by the second mode of the walk on the graph, then balanced moves."""
    n, k = graph.shape
    source, target = np.repeat(np.arange(n), k), graph.ravel()
    source, target = np.concatenate((source, target)), np.concatenate((target, source))
    part = np.zeros(n, np.int64)
    count = 1
    while count < parts:
        inside = part[source] == part[target]
        s, t = source[inside], target[inside]
        degree = np.bincount(s, minlength=n) + 1.0
        v = rng.standard_normal((n, 1))
        size = np.bincount(part, minlength=count)
        for _ in range(60):  # power iteration of the lazy walk, apart from the constant mode of each part
            v = v - (np.bincount(part, weights=(v[:, 0] * degree), minlength=count) / np.bincount(part, weights=degree, minlength=count))[part][:, None]
            spread = np.bincount(s, weights=v[t, 0], minlength=n) + v[:, 0]
            v = (0.5 * v[:, 0] + 0.5 * spread / degree)[:, None]
            v /= (np.sqrt(np.bincount(part, weights=v[:, 0] ** 2, minlength=count) / np.maximum(size, 1)) + 1e-300)[part][:, None]
        order = np.lexsort((v[:, 0], part))
        place = np.empty(n, np.int64)
        place[order] = np.arange(n)
        start = np.cumsum(size) - size
        part = 2 * part + ((place - start[part]) * 2 >= size[part])
        count *= 2
    most = int(np.ceil(1.1 * n / parts))
    for _ in range(rounds):
        votes = np.zeros((n, parts), np.int32)
        np.add.at(votes, (source, part[target]), 1)
        best = votes.argmax(1)
        gain = votes[np.arange(n), best] - votes[np.arange(n), part]
        sizes = np.bincount(part, minlength=parts)
        for i in np.argsort(-gain, kind="stable"):
            if gain[i] <= 0:
                break
            if sizes[best[i]] < most:
                sizes[part[i]] -= 1
                part[i] = best[i]
                sizes[best[i]] += 1
    return part


class Router:
    """A network with one hidden layer from a vector to the probabilities of parts."""

    def __init__(self, x: np.ndarray, targets: np.ndarray, rng: np.random.Generator, epochs: int = 40):
        self.mean, self.scale = x.mean(0), x.std() + 1e-12
        d, parts = x.shape[1], targets.shape[1]
        self.w = [rng.standard_normal((d, HIDDEN)) * (2 / d) ** 0.5, np.zeros(HIDDEN), rng.standard_normal((HIDDEN, parts)) * (1 / HIDDEN) ** 0.5, np.zeros(parts)]
        x = (x - self.mean) / self.scale
        first, second = [np.zeros_like(w) for w in self.w], [np.zeros_like(w) for w in self.w]
        step = 0
        for epoch in range(epochs):
            rate = 0.004 * (1 - epoch / epochs) + 1e-4
            order = rng.permutation(len(x))
            for at in range(0, len(x), 128):
                own = order[at:at + 128]
                h = np.maximum(x[own] @ self.w[0] + self.w[1], 0)
                slope = (self._softmax(h @ self.w[2] + self.w[3]) - targets[own]) / len(own)
                back = (slope @ self.w[2].T) * (h > 0)
                step += 1
                for i, g in enumerate((x[own].T @ back, back.sum(0), h.T @ slope, slope.sum(0))):
                    g = g + 1e-5 * self.w[i]
                    first[i] = 0.9 * first[i] + 0.1 * g
                    second[i] = 0.999 * second[i] + 0.001 * g * g
                    self.w[i] = self.w[i] - rate * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)

    @staticmethod
    def _softmax(z: np.ndarray) -> np.ndarray:
        e = np.exp(z - z.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.maximum((x - self.mean) / self.scale @ self.w[0] + self.w[1], 0) @ self.w[2] + self.w[3]


def _first_of_ids(near: np.ndarray, ids: np.ndarray, own: int) -> np.ndarray:
    """The nearest row of each of the first NEIGHBOURS other ids, of rows in order of distance."""
    near = near[ids[near] != own]
    _, first = np.unique(ids[near], return_index=True)
    return near[np.sort(first)[:NEIGHBOURS]]


class Partitioner:
    """The learned parts of a sample, and how many of them a query needs."""

    def __init__(self, sample: np.ndarray, parts: int, aim: float = 0.97, seed: int = 5, ids: np.ndarray | None = None):
        ids = np.arange(len(sample)) if ids is None else ids
        self.parts = parts if len(sample) >= 4 * parts else 1
        self.router, self.probes = None, 1
        if self.parts == 1:
            return
        rng = np.random.default_rng(seed)
        held = rng.permutation(len(sample))[: len(sample) // 8]
        kept = np.setdiff1d(np.arange(len(sample)), held)
        router, part = self._learn(sample[kept], rng)
        placed = router.logits(sample[kept]).argmax(1)
        x, y = sample[held], sample[kept]
        near = np.argsort((y * y).sum(1)[None, :] - 2 * x @ y.T, axis=1)
        rank = np.empty((len(x), self.parts), np.int64)
        np.put_along_axis(rank, np.argsort(-router.logits(x), axis=1, kind="stable"), np.arange(self.parts)[None, :], axis=1)
        needed = np.concatenate([rank[i, placed[_first_of_ids(near[i], ids[kept], ids[held[i]])]] for i in range(len(x))])
        self.probes = min(self.parts, int(np.quantile(needed, aim, method="higher")) + 1) if len(needed) else self.parts
        self.router, _ = self._learn(sample, np.random.default_rng(seed))

    def _learn(self, x: np.ndarray, rng: np.random.Generator) -> tuple[Router, np.ndarray]:
        graph = neighbour_graph(x, min(NEIGHBOURS, len(x) - 1))
        part = balanced_parts(graph, self.parts, rng)
        targets = np.zeros((len(x), self.parts))
        np.add.at(targets, (np.repeat(np.arange(len(x)), graph.shape[1]), part[graph].ravel()), 1.0 / (graph.shape[1] + 2))
        targets[np.arange(len(x)), part] += 2.0 / (graph.shape[1] + 2)
        return Router(x, targets, rng), part

    def best(self, x: np.ndarray, number: int) -> np.ndarray:
        """The most probable parts of each row, (n, number)."""
        if self.router is None:
            return np.zeros((len(x), 1), np.int64)
        return np.argsort(-self.router.logits(x), axis=1, kind="stable")[:, :number]


def usable(vector: Column) -> Column:
    """Not null or empty, only finite components, not all zero."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce((F.size(vector) > 0) & ~bad & F.exists(vector, lambda x: x != 0), F.lit(False))


def _matrix(column: pa.Array) -> np.ndarray:
    width = len(column[0]) if len(column) else 0
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), width)


def _place(model: Partitioner):
    """(id, vector) to (id, vector, part)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                part = model.best(_matrix(batch.column(1)), 1)[:, 0]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(part.astype(np.int32))], ["id", "vector", "part"])

    return run


def _route(model: Partitioner, number: int):
    """(id, vector) to a row for each part to search."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                parts = model.best(_matrix(batch.column(1)), number)
                rows = pa.array(np.repeat(np.arange(batch.num_rows), parts.shape[1]))
                yield pa.RecordBatch.from_arrays([*[c.take(rows) for c in batch.columns], pa.array(parts.ravel().astype(np.int32))], ["id", "vector", "part"])

    return run


def nearest(queries: np.ndarray, query_ids: np.ndarray, rows: np.ndarray, ids: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(query ids, ids, distances) of the k nearest other ids, ties to smaller ids.

    A matrix product finds who can be among them, within its rounding error; distances are then taken from differences.
    A repeated id counts once, with its nearest row, so the cut is at the k-th smallest of the ids' least upper bounds.
    """
    by_id = np.argsort(ids, kind="stable")
    rows, ids = rows[by_id], ids[by_id]
    names, starts = np.unique(ids, return_index=True)
    norms = (rows * rows).sum(1)
    for at in range(0, len(queries), 64):
        q = queries[at:at + 64]
        own = (q * q).sum(1)
        rough = own[:, None] + norms[None, :] - 2 * q @ rows.T
        slack = 1e-9 * (own[:, None] + norms[None, :]) + 1e-300
        high = rough + slack
        if len(names) < len(ids):
            high = np.minimum.reduceat(high, starts, axis=1)
        for i in range(len(q)):
            near = np.flatnonzero(ids != query_ids[at + i])
            others = high[i][names != query_ids[at + i]]
            if len(others) > k:
                limit = np.partition(others, k - 1)[k - 1]
                near = near[(rough[i] - slack[i])[near] <= limit]
            distance = np.sqrt(((rows[near] - q[i]) ** 2).sum(1))
            order = np.lexsort((ids[near], distance))
            _, first = np.unique(ids[near][order], return_index=True)
            chosen = order[np.sort(first)[:k]]
            yield np.full(len(chosen), query_ids[at + i]), ids[near][chosen], distance[chosen]


def _search(k: int):
    def run(queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(queries) and len(rows):
            q, r = (np.stack(x["vector"].to_numpy()).astype(np.float64) for x in (queries, rows))
            found = list(nearest(q, queries["id"].to_numpy(), r, rows["id"].to_numpy(), k))
        columns = [np.concatenate([f[i] for f in found]) if found else np.zeros(0) for i in range(3)]
        return pd.DataFrame({"query_id": columns[0].astype(np.int64), "vec_id": columns[1].astype(np.int64), "score": columns[2].astype(np.float64)})

    return run


def _blocks(rows: DataFrame, sizes: dict[int, int], block: int, name: str) -> Column:
    """The block of a row within its part, by hash of id and vector, so that an id with many rows is spread."""
    number = F.create_map(*[F.lit(x) for p, n in sorted(sizes.items()) for x in (int(p), -(-n // block))])
    return F.pmod(F.xxhash64("id", "vector", F.lit(name)), F.coalesce(number[F.col("part")], F.lit(1))).cast("int")


def _pairs(queries: DataFrame, index: DataFrame, k: int) -> DataFrame:
    """(query_id, vec_id, score): the k nearest of each query in each block of its parts."""
    n_index, n_queries = (dict(map(tuple, x.groupBy("part").count().collect())) for x in (index, queries))
    sent = queries.withColumn("query_block", _blocks(queries, n_queries, QUERY_BLOCK, "q"))
    number = lambda sizes, block: F.create_map(*[F.lit(x) for p, n in sorted(sizes.items()) for x in (int(p), -(-n // block))])
    if not n_index or not n_queries:
        return queries.sparkSession.createDataFrame([], "query_id long, vec_id long, score double")
    sent = sent.withColumn("block", F.explode(F.sequence(F.lit(0), F.coalesce(number(n_index, BLOCK)[F.col("part")], F.lit(1)) - 1)))
    held = index.withColumn("block", _blocks(index, n_index, BLOCK, "r")).withColumn(
        "query_blocks", number(n_queries, QUERY_BLOCK)[F.col("part")]
    ).where("query_blocks IS NOT NULL")
    held = held.withColumn("query_block", F.explode(F.sequence(F.lit(0), F.col("query_blocks") - 1))).drop("query_blocks")
    keys = ["part", "block", "query_block"]
    met = sent.groupBy(*keys).cogroup(held.groupBy(*keys))
    return met.applyInPandas(_search(k), "query_id long, vec_id long, score double")


def search(vectors: DataFrame, is_query: Column, vec_id: str = "vec_id", vector: str = "embedding", k: int = 10, seed: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score): the nearest found of every row that ``is_query`` (over ``id``) holds for."""
    spark = vectors.sparkSession
    ship_code(spark)
    rows = vectors.select(F.col(f"`{vec_id}`").cast("long").alias("id"), F.col(f"`{vector}`").alias("vector"))
    rows = rows.where(F.col("id").isNotNull() & usable(F.col("vector")))
    sizes = rows.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).limit(1).collect()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if not sizes:
        return empty
    rows = rows.where(F.size("vector") == sizes[0]["n"]).dropDuplicates(["id", "vector"])
    wanted = sizes[0]["count"] / PART_ROWS
    parts = 1 << max(0, min(int(np.log2(MOST_PARTS)), int(np.floor(np.log2(max(wanted, 1))))))
    mark = F.xxhash64("vector", F.lit(seed))
    sample = rows.groupBy("vector").agg(F.min("id").alias("id")).orderBy(mark, "vector").limit(SAMPLE).collect()
    model = Partitioner(np.array([r["vector"] for r in sample], np.float64), parts, seed=seed, ids=np.array([r["id"] for r in sample]))
    kind = rows.schema["vector"].dataType.simpleString()
    index = written(rows.mapInArrow(_place(model), f"id long, vector {kind}, part int"), "ann-index")
    queries = index.where(is_query).select("id", "vector")
    routed = written(queries.mapInArrow(_route(model, model.probes), f"id long, vector {kind}, part int"), "ann-queries")
    found = _top(_pairs(routed, index, k), k)
    if model.probes >= model.parts:
        return found
    found = written(found, "ann-found")
    others = index.select("id").distinct().count() - 1
    done = found.groupBy(F.col("query_id").alias("id")).count().where(F.col("count") >= min(k, others))
    short = queries.join(done, "id", "left_anti")
    if short.isEmpty():
        return found
    again = written(short.mapInArrow(_route(model, model.parts), f"id long, vector {kind}, part int"), "ann-short")
    rest = _top(_pairs(again, index, k), k)
    return found.join(short.select(F.col("id").alias("query_id")).distinct(), "query_id", "left_anti").unionByName(rest)


def _top(pairs: DataFrame, k: int) -> DataFrame:
    best = pairs.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op6_ann(spark, folder: str) -> DataFrame:
    return search(table(spark, folder, "embeddings").select("vec_id", "embedding"), F.col("id") % 100 == 0)
