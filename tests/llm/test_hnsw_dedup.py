"""Embedding near-dedup against all pairs, on the given vectors and on planted groups."""

import numpy as np
import pytest
from pyspark.sql import types as T

from signalmill.llm import hnsw_dedup
from signalmill.llm.hnsw_dedup import SmallWorld, _unit, near_vectors, op13_hnsw_dedup, searched

SCHEMA = T.StructType([
    T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("label", T.IntegerType()),
])


def plain(rows, least=0.93):
    """{(id, label, vector): (links, component, kept)} by all pairs of a label."""
    rows = sorted({(i, None if v is None else tuple(v), label) for i, v, label in rows}, key=repr)
    able = lambda r: r[0] is not None and r[2] is not None and r[1] and all(x is not None and np.isfinite(x) for x in r[1]) and any(r[1])
    root, links = list(range(len(rows))), [0] * len(rows)

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for label in {r[2] for r in rows if able(r)}:
        own = [i for i, r in enumerate(rows) if able(r) and r[2] == label]
        for length in {len(rows[i][1]) for i in own}:
            same = [i for i in own if len(rows[i][1]) == length]
            x = np.array([rows[i][1] for i in same], np.float64)
            long = np.sqrt((x * x).sum(1))
            near = (x @ x.T) / np.outer(long, long) >= least
            for a, b in zip(*np.nonzero(near)):
                if a < b:
                    links[same[a]] += 1
                    links[same[b]] += 1
                    root[find(same[a])] = find(same[b])
    least_id = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least_id[find(i)] = min(r[0], least_id.get(find(i), r[0]))
    return sorted(((r[0], links[i], least_id.get(find(i)), r[0] is not None and r[0] == least_id.get(find(i))) for i, r in enumerate(rows)), key=repr)


def result(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_the_query(spark, folder):
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    assert result(op13_hnsw_dedup(spark, folder)) == plain([(i, list(v), label) for i, v, label in rows])


@pytest.fixture(scope="module")
def planted():
    """Tight groups of 2 to 300 near copies, exact and scaled copies, and strangers, in two labels."""
    rng = np.random.default_rng(3)
    rows, n = [], 0
    for size, label in ((2, 1), (5, 1), (40, 1), (300, 1), (300, 2), (7, 2)):
        centre = rng.standard_normal(16)
        for _ in range(size):
            rows.append((n, [float(np.float32(v)) for v in centre + 0.1 * rng.standard_normal(16)], label))
            n += 1
    for label in (1, 2):
        for _ in range(150):
            rows.append((n, [float(np.float32(v)) for v in rng.standard_normal(16)], label))
            n += 1
    rows += [(n, rows[0][1], 1), (n + 1, rows[0][1], 1), (n + 2, [2 * v for v in rows[1][1]], 1), (n + 3, rows[0][1], 2)]
    return rows


@pytest.mark.parametrize("shard_rows", [4096, 64])
def test_planted_groups_over_one_and_many_shards(spark, planted, shard_rows):
    got, wanted = result(near_vectors(spark.createDataFrame(planted, SCHEMA), shard_rows=shard_rows)), plain(planted)
    found, there = sum(r[1] for r in got), sum(r[1] for r in wanted)
    assert all(g[1] <= w[1] for g, w in zip(got, wanted, strict=True))
    assert found >= 0.99 * there
    assert [g[2:] for g in got] == [w[2:] for w in wanted]


def test_shards_are_smaller_than_labels_and_every_pair_of_them_meets_once(spark, planted, monkeypatch):
    kept = {}
    real = hnsw_dedup.written

    def keep(df, label):
        kept[label] = real(df, label)
        return kept[label]

    monkeypatch.setattr(hnsw_dedup, "written", keep)
    near_vectors(spark.createDataFrame(planted, SCHEMA), shard_rows=64).count()
    shards = {(r.label, r.shards) for r in kept["vector-labels"].collect()}
    assert all(n > 4 for _, n in shards)
    met = [(r.label, min(r.shard, r.other), max(r.shard, r.other)) for r in kept["vector-meetings"].collect()]
    assert sorted(met) == sorted((label, a, b) for label, n in shards for a in range(n) for b in range(a, n))
    # a large group costs edges of a forest, not its pairs
    edges = kept["vector-links"].where("other IS NOT NULL").count()
    assert edges <= sum(2 * 64 * n * n for _, n in shards) and edges < 300 * 300


def test_a_search_walks_the_graph_and_the_audit_widens_it():
    x = np.random.default_rng(1).standard_normal((1500, 24))
    order, sizes = SmallWorld.order(len(x), np.random.default_rng(2))
    graph = SmallWorld.build(_unit(x[order]), sizes)
    assert len(sizes) >= 3 and all((layer[:, 0] >= 0).sum() >= len(layer) - 1 for layer in graph.layers)
    exact = graph.x @ graph.x.T
    recall = {}
    for beam in (8, 128):
        ids, _ = graph.search(graph.x, beam)
        best = np.argsort(-exact, axis=1)[:, :8]
        recall[beam] = np.mean([len(np.intersect1d(a[:8], b)) / 8 for a, b in zip(ids, best)])
    assert recall[128] > 0.95 and recall[128] > recall[8]
    hits, beam, share = searched(graph, graph.x, 0.7, 0.98, True, beam=2)
    assert 2 < beam < len(x) and share >= 0.9
    np.fill_diagonal(hits, False), np.fill_diagonal(exact, 0)
    assert (hits & (exact >= 0.7)).sum() >= 0.95 * (exact >= 0.7).sum()


def test_edges(spark):
    rows = [
        (1, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [1.0, 0.0], 1), (3, [1.0, 0.1], 1), (3, [0.0, 1.0], 1), (4, None, 1), (5, [], 1),
        (6, [0.0, 0.0], 1), (7, [1.0, None], 1), (8, [float("nan"), 1.0], 1), (9, [float("inf"), 1.0], 1), (10, [1.0, 0.0], None),
        (None, [1.0, 0.0], 1), (11, [1.0, 0.0, 0.0], 1), (None, None, None), (12, [1.0, 0.0], 2),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {}
    for r in near_vectors(df.withColumn("node", df["vec_id"]).withColumn("n_links", df["vec_id"])).collect():
        got.setdefault(r.vec_id, []).append((r.n_links, r.component_id, r.kept))
    assert got[1] == [(2, 1, True)] and got[2] == [(2, 1, False)]
    assert sorted(got[3]) == [(0, 3, True), (2, 1, False)]
    for alone in (4, 5, 6, 7, 8, 9, 10, 11, 12):
        assert got[alone] == [(0, alone, True)]
    assert got[None] == [(0, None, False)] * 2
    assert near_vectors(df.limit(0)).collect() == []
