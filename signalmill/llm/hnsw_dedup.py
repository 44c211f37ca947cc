"""Embedding near-dedup with hierarchical navigable small-world graphs, one per shard.

Equal vectors of a label become one node with a weight. The nodes of a label are dealt by hash into shards of about
``shard_rows``; each shard gets its own graph: every node has a random top layer, is linked in each of its layers to diverse
near nodes found by a beam search, and a search falls from the sparse top layers to the full one. Graphs are written, one row
a shard. Then the nodes of every shard query every shard of their label, their own included. Shards meet in a round robin,
each two once, and are searched in both directions, so that a node that cannot be reached still finds its partners.

Beams widen twice over: a query whose beam holds nothing but links is searched again with twice the beam, and a whole meeting
is repeated with twice the beam until an audit passes: ``AUDITED`` of its queries are compared with all rows of the shard, and
at least ``aim`` of their links and ``AIM_ROWS`` of their ``NEAREST`` nearest rows must have been found. A beam as wide as the
shard is an exact search, so no link is out of reach. Graphs are walked in single precision with some slack; pairs found are
checked by the double-precision cosine of the original vectors. A task returns weighted link counts and the edges of a
spanning forest, never its pairs, so large groups of near copies cost rows, not pairs; components come from alternating
large and small stars.

Memory is bounded by two shards and a byte per pair of their rows (twice 64 MB). The work of ``query every shard`` is nodes x
shards of a label, so larger tables want larger ``shard_rows`` as far as tasks have memory.

Defined results: one row per distinct (id, label, vector). Vectors that are null, empty, zero or hold null or non-finite
components, and rows without a label, link with nothing; neither do vectors of different lengths. Rows without an id link with
nothing and have no component. Equal vectors of a label link (cosine 1), whatever their ids. Ties do not arise. The length
of a vector is not limited. An empty table gives an empty result; other columns of the table are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ann import usable
from .common import same, ship_code, table, written
from .simhash_dedup import components

SHARD_ROWS, LINKS, BUILD_BEAM, BEAM = 8192, 12, 48, 32
AUDITED, NEAREST, AIM_ROWS = 48, 4, 0.9
#: Rows of one batched insertion or search.
BATCH = 128
#: Searches keep what is this little below the limit; the cosine of the original vectors decides.
SLACK = 1e-5


class SmallWorld:
    """A layered graph over unit rows, which are ordered so that each layer holds the first rows of the one below."""

    def __init__(self, x: np.ndarray, layers: list[np.ndarray]):
        self.x, self.layers = x, layers

    @staticmethod
    def order(n: int, rng: np.random.Generator) -> tuple[np.ndarray, list[int]]:
        """An order of the rows by falling top layer, and the size of each layer from the lowest to the top."""
        top = np.floor(-np.log(1 - rng.random(n)) / np.log(LINKS)).astype(int)
        order = np.argsort(-top, kind="stable")
        sizes = [n]
        while (size := int((top >= len(sizes)).sum())) > 0:
            sizes.append(size)
        return order, sizes

    @classmethod
    def build(cls, x: np.ndarray, sizes: list[int]) -> SmallWorld:
        graph = cls(x, [np.full((size, LINKS * 2 if layer == 0 else LINKS), -1, np.int32) for layer, size in enumerate(sizes)])
        for layer in range(len(sizes) - 1, -1, -1):
            above = sizes[layer + 1] if layer + 1 < len(sizes) else 0
            at = 1
            while at < sizes[layer]:
                end = min(2 * at, at + BATCH, sizes[layer], above if at < above else sizes[layer])
                graph._insert(layer, at, end, at >= above)
                at = end
        return graph

    def _insert(self, layer: int, at: int, end: int, enter_above: bool) -> None:
        new = np.arange(at, end)
        entries = self._fall(self.x[new], layer) if enter_above else np.zeros(len(new), np.int64)
        ids, sims = self._beam(layer, self.x[new], entries, BUILD_BEAM)
        beside = self.x[new] @ self.x[new].T
        beside[np.triu_indices(len(new))] = -np.inf  # the rows of a batch meet each other once
        ids = np.concatenate((ids, np.where(beside > -np.inf, new[None, :], -1)), axis=1)
        sims = np.concatenate((sims, beside), axis=1)
        width = self.layers[layer].shape[1]
        chosen = self._diverse(new, ids, sims, min(LINKS, width))
        self.layers[layer][new, : chosen.shape[1]] = chosen
        source, target = np.repeat(new, chosen.shape[1]), chosen.ravel()
        source, target = source[target >= 0], target[target >= 0]
        order = np.argsort(target, kind="stable")
        source, target = source[order], target[order]
        names, starts, counts = np.unique(target, return_index=True, return_counts=True)
        place = np.arange(len(target)) - np.repeat(starts, counts)
        for a in range(0, len(names), 4 * BATCH):  # links back
            own = slice(a, a + 4 * BATCH)
            lo, hi = starts[own][0], starts[own][-1] + counts[own][-1]
            added = np.full((len(names[own]), counts[own].max()), -1, np.int64)
            added[np.repeat(np.arange(len(names[own])), counts[own]), place[lo:hi]] = source[lo:hi]
            every = np.concatenate((self.layers[layer][names[own]], added), axis=1)
            near = np.einsum("bd,bcd->bc", self.x[names[own]], self.x[np.maximum(every, 0)])
            self.layers[layer][names[own]] = self._diverse(names[own], every, np.where(every >= 0, near, -np.inf), width)

    def _diverse(self, own: np.ndarray, ids: np.ndarray, sims: np.ndarray, number: int) -> np.ndarray:
        """Up to ``number`` neighbours a row: near ones that are nearer to it than to one chosen before, then the nearest rest."""
        most = min(ids.shape[1], max(2 * number, BUILD_BEAM))
        order = np.argsort(-sims, axis=1, kind="stable")[:, :most]
        ids, sims = np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)
        among = self.x[np.maximum(ids, 0)]
        among = among @ among.transpose(0, 2, 1)
        kept, count = np.zeros(ids.shape, bool), np.zeros(len(ids), int)
        for j in range(ids.shape[1]):
            blocked = (kept & (among[:, j, :] > sims[:, j, None])).any(1)
            kept[:, j] = (ids[:, j] >= 0) & ~blocked & (count < number)
            count += kept[:, j]
        rank = np.argsort(np.where(kept, 0, np.where(ids >= 0, 1, 2)), axis=1, kind="stable")[:, :number]
        chosen = np.take_along_axis(ids, rank, 1)
        return np.pad(chosen, ((0, 0), (0, number - chosen.shape[1])), constant_values=-1)

    def _fall(self, queries: np.ndarray, layer: int) -> np.ndarray:
        """The nearest row that a narrow beam finds on the way down to ``layer``."""
        at = np.zeros(len(queries), np.int64)
        for upper in range(len(self.layers) - 1, layer, -1):
            ids, _ = self._beam(upper, queries, at, 4)
            at = ids[:, 0]
        return at

    def _beam(self, layer: int, queries: np.ndarray, entries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, similarities) of the nearest rows found, best first, -1 where there are fewer than ``beam``."""
        links, b = self.layers[layer], len(queries)
        seen = np.zeros((b, len(links)), bool)
        rows = np.arange(b)
        seen[rows, entries] = True
        ids, sims = entries[:, None].astype(np.int64), np.einsum("bd,bd->b", queries, self.x[entries])[:, None]
        done = np.zeros((b, 1), bool)
        step = max(1, min(8, beam // 8))
        live = rows
        while len(live):
            open_ = np.where(done[live] | (ids[live] < 0), -np.inf, sims[live])
            number = min(step, open_.shape[1])
            best = np.argpartition(-open_, number - 1, axis=1)[:, :number] if number < open_.shape[1] else np.tile(np.arange(number), (len(live), 1))
            worth = np.take_along_axis(open_, best, 1) > -np.inf
            go = worth.any(1)
            live, best, worth = live[go], best[go], worth[go]
            if not len(live):
                break
            done[live[:, None], best] |= worth
            picked = np.where(worth, ids[live[:, None], best], -1)
            found = np.where(picked[:, :, None] >= 0, links[np.maximum(picked, 0)], -1).reshape(len(live), -1)
            found = np.sort(found, axis=1)  # a row reached twice in one step counts once
            found[:, 1:][found[:, 1:] == found[:, :-1]] = -1
            fresh = (found >= 0) & ~seen[live[:, None], np.maximum(found, 0)]
            where = np.nonzero(fresh)
            seen[live[where[0]], found[where]] = True
            value = np.full(found.shape, -np.inf, np.float32)
            value[where] = np.einsum("nd,nd->n", queries[live[where[0]]], self.x[found[where]])
            keep = fresh.sum(1).max()
            if not keep:
                continue
            front = np.argpartition(-value, keep - 1, axis=1)[:, :keep]
            found, value = np.take_along_axis(np.where(fresh, found, -1), front, 1), np.take_along_axis(value, front, 1)
            all_ids = np.full((b, ids.shape[1] + keep), -1, np.int64)
            all_sims = np.full(all_ids.shape, -np.inf, np.float32)
            all_done = np.zeros(all_ids.shape, bool)
            all_ids[:, : ids.shape[1]], all_sims[:, : ids.shape[1]], all_done[:, : ids.shape[1]] = ids, sims, done
            all_ids[live, ids.shape[1]:], all_sims[live, ids.shape[1]:] = found, value
            if all_ids.shape[1] > beam:
                cut = np.argpartition(-all_sims, beam - 1, axis=1)[:, :beam]
                all_ids, all_sims, all_done = (np.take_along_axis(v, cut, 1) for v in (all_ids, all_sims, all_done))
            ids, sims, done = all_ids, all_sims, all_done
        order = np.argsort(-sims, axis=1, kind="stable")
        return np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)

    def search(self, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        if beam >= len(self.x):
            sims = queries @ self.x.T
            order = np.argsort(-sims, axis=1, kind="stable")
            return order, np.take_along_axis(sims, order, 1)
        return self._beam(0, queries, self._fall(queries, 0), beam)


def _hits(graph: SmallWorld, queries: np.ndarray, least: float, beam: int, hits: np.ndarray, near: np.ndarray) -> None:
    """Marks what a beam finds at ``least`` or above; beams that hold nothing else are widened."""
    for at in range(0, len(queries), BATCH):
        left, wide = np.arange(at, min(at + BATCH, len(queries))), beam
        while len(left):
            ids, sims = graph.search(queries[left], wide)
            first = min(NEAREST + 1, ids.shape[1])
            near[left, :first] = ids[:, :first]
            at_least = (ids >= 0) & (sims >= least - SLACK)
            row, column = np.nonzero(at_least)
            hits[left[row], ids[row, column]] = True
            left = left[at_least.all(1)] if wide < len(graph.x) else left[:0]
            wide *= 2


def searched(graph: SmallWorld, queries: np.ndarray, least: float, aim: float, itself: bool, beam: int = BEAM) -> tuple[np.ndarray, int, float]:
    """(hit per query and row, beam that passed the audit, the lesser share of the audited links and nearest rows found)."""
    audited = np.unique(np.linspace(0, len(queries) - 1, min(AUDITED, len(queries))).astype(int))
    exact = queries[audited] @ graph.x.T
    if itself:
        exact[np.arange(len(audited)), audited] = -np.inf
    wanted = exact >= least
    number = min(NEAREST, len(graph.x) - itself)
    nearest = np.argsort(-exact, axis=1, kind="stable")[:, :number]
    while True:
        hits, near = np.zeros((len(queries), len(graph.x)), bool), np.full((len(queries), NEAREST + 1), -1)
        _hits(graph, queries, least, beam, hits, near)
        links = (hits[audited] & wanted).sum() / wanted.sum() if wanted.any() else 1.0
        rows = np.mean([len(np.intersect1d(near[q], nearest[i])) / number for i, q in enumerate(audited)]) if number else 1.0
        if (links >= aim and rows >= AIM_ROWS) or beam >= len(graph.x):
            return hits, beam, float(min(links, rows))
        beam *= 2


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)
    return (x / np.sqrt((x * x).sum(1, keepdims=True))).astype(np.float32)


def _verified(hits: np.ndarray, left: np.ndarray, right: np.ndarray, least: float) -> None:
    """Takes back hits whose cosine in double precision is below the limit."""
    row, column = np.nonzero(hits)
    long_left, long_right = np.sqrt((left * left).sum(1)), np.sqrt((right * right).sum(1))
    for at in range(0, len(row), 1 << 15):
        r, c = row[at:at + (1 << 15)], column[at:at + (1 << 15)]
        bad = np.einsum("nd,nd->n", left[r], right[c]) / (long_left[r] * long_right[c]) < least
        hits[r[bad], c[bad]] = False


def _forest(hits: np.ndarray, left: np.ndarray, right: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Edges that connect all hits, at most one a row of either side."""
    turned = np.ascontiguousarray(hits.T)
    rows_seen, columns_seen = np.zeros(len(left), bool), np.zeros(len(right), bool)
    edges = []
    for row in np.flatnonzero(hits.any(1)):
        if rows_seen[row]:
            continue
        rows_seen[row], front = True, np.array([row])
        while len(front):
            columns = np.flatnonzero(hits[front].any(0) & ~columns_seen)
            columns_seen[columns] = True
            front = np.flatnonzero(turned[columns].any(0) & ~rows_seen)
            rows_seen[front] = True
            for ends in (right[columns], left[front]):
                edges.append((np.full(len(ends), left[row]), ends))
    return edges


def _build(seed: int):
    """The rows of a shard to one row: its nodes, weights, vectors and the layers of its graph, as bytes."""

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks().sort_by("node")
        size = rows.column("size")[0].as_py()
        x = rows.column("vector").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)
        order, sizes = SmallWorld.order(len(x), np.random.default_rng([seed, rows.column("shard")[0].as_py()]))
        x = x[order]
        graph = SmallWorld.build(_unit(x), sizes)
        node, weight = (rows.column(c).to_numpy()[order].astype(np.int64) for c in ("node", "weight"))
        return pa.table({
            "label": rows.column("label").slice(0, 1), "size": pa.array([size], pa.int32()), "shard": rows.column("shard").slice(0, 1),
            "nodes": pa.array([node.tobytes()], pa.binary()), "weights": pa.array([weight.tobytes()], pa.binary()),
            "vectors": pa.array([x.tobytes()], pa.binary()),
            "layers": pa.array([[layer.tobytes() for layer in graph.layers]], pa.list_(pa.binary())),
        })

    return run


def _shard(size: int, nodes: bytes, weights: bytes, vectors: bytes, layers: list[bytes]):
    x = np.frombuffer(vectors, np.float64).reshape(-1, size)
    kept = [np.frombuffer(v, np.int32).reshape(-1, LINKS * 2 if i == 0 else LINKS) for i, v in enumerate(layers)]
    return np.frombuffer(nodes, np.int64), np.frombuffer(weights, np.int64), x, SmallWorld(_unit(x), kept)


def _meet(least: float, aim: float):
    """Two shards to (node, other, links): link counts of nodes, with ``other`` null, and forest edges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: batch.column(name)[i].as_py() for name in batch.schema.names}
                nodes, weights, x, graph = _shard(row["size"], *(row[f"left_{c}"] for c in ("nodes", "weights", "vectors", "layers")))
                if row["shard"] == row["other"]:
                    hits = searched(graph, graph.x, least, aim, True)[0]
                    hits |= hits.T
                    np.fill_diagonal(hits, False)
                    _verified(hits, x, x, least)
                    counts, right = [(nodes, hits @ weights)], nodes
                else:
                    right, right_weights, y, other = _shard(row["size"], *(row[f"right_{c}"] for c in ("nodes", "weights", "vectors", "layers")))
                    hits = searched(other, graph.x, least, aim, False)[0]
                    hits |= searched(graph, other.x, least, aim, False)[0].T
                    _verified(hits, x, y, least)
                    counts = [(nodes, hits @ right_weights), (right, hits.T @ weights)]
                edges = _forest(hits, nodes, right)
                a = np.concatenate([c[0] for c in counts] + [e[0] for e in edges])
                n = np.concatenate([c[1] for c in counts])
                linked = [e[1] for e in edges]
                yield pa.RecordBatch.from_pydict({
                    "node": pa.array(a, pa.int64()),
                    "other": pa.concat_arrays([pa.nulls(len(n), pa.int64()), *[pa.array(v, pa.int64()) for v in linked]]),
                    "links": pa.concat_arrays([pa.array(n, pa.int64()), pa.nulls(len(a) - len(n), pa.int64())]),
                })

    return run


def near_vectors(
    vectors: DataFrame, vec_id: str = "vec_id", label: str = "label", vector: str = "embedding",
    least: float = 0.93, shard_rows: int = SHARD_ROWS, aim: float = 0.98, seed: int = 13,
) -> DataFrame:
    """One row per distinct (``vec_id``, ``label``, vector): ``vec_id``, ``n_links``, ``component_id``, ``kept``."""
    spark = vectors.sparkSession
    ship_code(spark)
    rows = vectors.select(F.col(f"`{vec_id}`").cast("long").alias("id"), F.col(f"`{label}`").alias("label"), F.col(f"`{vector}`").alias("vector"))
    rows = rows.distinct()
    able = F.col("id").isNotNull() & F.col("label").isNotNull() & usable(F.col("vector"))
    nodes = rows.where(able).groupBy("label", "vector").agg(F.min("id").alias("least"), F.count("*").alias("weight"))
    nodes = written(nodes.withColumn("size", F.size("vector")).withColumn("node", F.monotonically_increasing_id()), "vector-nodes")
    sizes = nodes.groupBy("label", "size").agg(F.ceil(F.count("*") / shard_rows).cast("int").alias("shards"))
    sizes = written(sizes, "vector-labels")
    dealt = nodes.join(sizes, ["label", "size"]).withColumn("shard", F.pmod(F.xxhash64("node", F.lit(seed)), F.col("shards")).cast("int"))
    kind = nodes.schema["label"].dataType.simpleString()
    graphs = dealt.select("label", "size", "shard", "node", "weight", "vector").groupBy("label", "size", "shard").applyInArrow(
        _build(seed), f"label {kind}, size int, shard int, nodes binary, weights binary, vectors binary, layers array<binary>"
    )
    graphs = written(graphs, "vector-graphs")
    # a round robin: shard s meets s, s + 1, ... s + half; with an even number the last distance counts for the first half only
    half = F.floor(F.col("shards") / 2).cast("int")
    rounds = sizes.select("label", "size", "shards", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard"))
    far = F.when((F.col("shards") % 2 == 0) & (F.col("shard") >= half), half - 1).otherwise(half)
    rounds = rounds.withColumn("by", F.explode(F.sequence(F.lit(0), far)))
    pairs = rounds.select("label", "size", "shard", F.pmod(F.col("shard") + F.col("by"), F.col("shards")).cast("int").alias("other"))
    meetings = written(pairs, "vector-meetings")
    parts = ("nodes", "weights", "vectors", "layers")
    left = graphs.select("label", "size", "shard", *[F.col(c).alias(f"left_{c}") for c in parts])
    right = graphs.select("label", "size", F.col("shard").alias("other"), *[F.col(c).alias(f"right_{c}") for c in parts])
    tasks = max(1, min(meetings.count(), 10_000))
    met = meetings.join(left, ["label", "size", "shard"]).join(right, ["label", "size", "other"]).repartition(tasks, "label", "size", "shard", "other")
    found = written(met.mapInArrow(_meet(least, aim), "node long, other long, links long"), "vector-links")
    links = found.where("other IS NULL").groupBy("node").agg(F.sum("links").alias("links"))
    roots = components(found.where("other IS NOT NULL AND node != other").select(F.col("node").alias("a"), F.col("other").alias("b")))
    own = nodes.join(links, "node", "left").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    own = written(own.select("label", "vector", "least", "weight", F.coalesce("links", F.lit(0)).alias("links"), "root"), "vector-roots")
    whole = written(own.groupBy("root").agg(F.min("least").alias("component_id")), "vector-components")
    known = written(own.join(whole, "root").select("label", "vector", (F.col("links") + F.col("weight") - 1).alias("n_links"), "component_id"), "vector-known")
    linked = rows.where(able)
    linked = linked.join(known, same(linked, known, ["label", "vector"])).select("id", known["n_links"], known["component_id"])
    alone = rows.where(~able).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    every = linked.unionByName(alone)
    kept = F.coalesce(F.col("id") == F.col("component_id"), F.lit(False))
    return every.select(F.col("id").alias("vec_id"), "n_links", "component_id", kept.alias("kept"))


def op13_hnsw_dedup(spark, folder: str) -> DataFrame:
    return near_vectors(table(spark, folder, "embeddings").select("vec_id", "label", "embedding"))
