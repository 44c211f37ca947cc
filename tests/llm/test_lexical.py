"""Ranked lexical search against plain scoring of all documents."""

import math
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F
from pyspark.sql import types as T

from signalmill.llm import lexical
from signalmill.llm.lexical import BLOCK, Queries, Shard, cluster, lexical_search, op12_lexical_search, terms_of

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(docs, items, k=50):
    """[(item_id, rank, doc_id, score)] by scoring every document for every item."""
    counted = [(i, Counter(TERM.findall((t or "").translate(LOWER)))) for i, t in docs]
    counted = [(i, c, sum(c.values())) for i, c in counted if c]
    n, total, df = len(counted), sum(x for *_, x in counted), Counter(t for _, c, _ in counted for t in c)
    wanted = {}
    for i, t in items:
        wanted.setdefault(i, set()).update(TERM.findall((t or "").translate(LOWER)))
    out = []
    for item, terms in wanted.items():
        weight = {t: math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) for t in terms if df[t]}
        scores = []
        for doc, c, size in counted:
            m = 100 - 50 + (50 * size * n) // total
            score = sum(w * ((1_000_000_000 * c[t]) // (1000 * c[t] + 20 * m)) for t, w in weight.items() if c[t])
            if score > 0:
                scores.append((-score, doc is None, doc or 0, doc))
        out += [(item, rank, s[3], -s[0]) for rank, s in enumerate(sorted(scores, key=lambda s: s[:3])[:k], 1)]
    return sorted(out, key=repr)


def result(df):
    return sorted((tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect()), key=repr)


def tables(spark, folder):
    docs = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    return docs, [tuple(r) for r in spark.read.parquet(f"{folder}/benchmark.parquet").select("item_id", "text").collect()]


def test_terms():
    text = "A-Z é_Ünï 日本 x9\x7f\x80y   z"
    assert [t.decode() for t in terms_of(text.encode())] == TERM.findall(text.translate(LOWER))
    assert terms_of(None) == terms_of(b"") == []


def test_the_query(spark, folder):
    docs, items = tables(spark, folder)
    assert result(op12_lexical_search(spark, folder)) == plain(docs, items)


def test_small_shards_and_blocks_of_items_give_the_same(spark, folder, monkeypatch):
    docs, items = tables(spark, folder)
    frames = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/benchmark.parquet")
    wanted = plain(docs, items, 7)
    monkeypatch.setattr(lexical, "ITEMS", 11)
    assert result(lexical_search(*frames, k=7)) == wanted
    monkeypatch.setattr(lexical, "TERMS", 100)
    assert result(lexical_search(frames[0].repartition(13), frames[1].where("item_id % 9 = 0"), k=7)) == plain(docs, [x for x in items if x[0] % 9 == 0], 7)


def test_summaries_bound_their_blocks_and_blocks_are_skipped():
    rng = np.random.default_rng(5)
    topics = rng.integers(0, 300, (12, 25))
    rows = [{int(t): int(c) for t, c in zip(rng.choice(topics[d % 12], 12, replace=False), rng.integers(1, 6, 12))} for d in range(1500)]
    lengths = np.array([sum(r.values()) for r in rows])
    starts = np.concatenate(([0], np.cumsum([len(r) for r in rows]))).astype(np.int32)
    terms, counts = np.array([t for r in rows for t in r], np.int32), np.array([c for r in rows for c in r.values()])
    df = np.bincount(terms, minlength=300)
    weights = np.array([math.floor(1000 * math.log((2 * 1500 + 2) / (2 * x + 1))) if x else 0 for x in df.tolist()])
    queries = Queries([np.unique(rng.choice(topics[i % 12], 8)).astype(np.int32) for i in range(24)], weights, np.zeros(24, np.int64), 10)
    import pyarrow as pa
    one = lambda v, kind: pa.array([v], pa.list_(kind))
    packed = pa.RecordBatch.from_pydict({
        "shard": pa.array([0], pa.int64()), "ids": one(np.arange(1500), pa.int64()), "lengths": one(lengths, pa.int64()),
        "starts": one(starts, pa.int32()), "terms": one(terms, pa.int32()), "counts": one(counts, pa.int64()),
    })
    (index,) = list(lexical._index(queries, 1500, int(lengths.sum()))(iter([packed])))
    impacts, lists = index.column("impacts")[0].values.to_numpy(), lexical._lists_of(index.column("lists")[0])
    dense = np.zeros((1500, 300), np.int64)
    dense[np.repeat(np.arange(1500), np.diff(starts)), terms] = impacts
    shard, known = Shard(starts, terms, impacts, lists, 300), [0, 0]
    for term, (coordinates, ends, docs, maxima) in shard.lists.items():
        assert sorted(docs) == np.flatnonzero(dense[:, term]).tolist() and np.diff(ends).max() <= BLOCK
        for b in range(len(ends) - 1):
            assert (maxima[b] == dense[np.ix_(docs[ends[b]:ends[b + 1]], coordinates)].max(0)).all()
    for item in range(24):
        found, scores = shard.search(queries, item)
        every = dense[:, queries.terms[item]] @ weights[queries.terms[item]]
        limit = np.sort(every)[-10]
        assert dict(zip(found.tolist(), scores.tolist())) == {int(d): int(every[d]) for d in np.flatnonzero(every >= limit)}
        queries.limits[item], before = limit, (shard.scored, shard.skipped)
        again = shard.search(queries, item)  # with the limit known from elsewhere
        assert dict(zip(*(v.tolist() for v in again))) == dict(zip(found.tolist(), scores.tolist()))
        known[0] += shard.scored - before[0]
        known[1] += shard.skipped - before[1]
    assert known[0] > 0 and 5 * known[1] > known[0], known


def test_clusters_hold_all_points_once():
    points = np.random.default_rng(2).standard_normal((777, lexical.SKETCH)).astype(np.float32)
    order, sizes = cluster(points)
    assert sorted(order) == list(range(777)) and sizes.sum() == 777 and 0 < sizes.min() and sizes.max() <= BLOCK


def test_edges(spark, edges):
    rows, docs = edges
    items = [(1, "One TWO three"), (1, "ten"), (2, None), (3, ""), (None, "word"), (4, "é 日本"), (5, "w5x5 W9x9 nothing"), (6, "--- !"), (1, "One TWO three")]
    kinds = T.StructType([T.StructField("item_id", T.LongType()), T.StructField("text", T.StringType())])
    asked = spark.createDataFrame(items, kinds)
    wanted = plain([(d, t) for d, _, t in rows], items)
    got = result(lexical_search(docs.withColumn("score", F.lit(1)).withColumn("shard", F.lit("x")), asked.withColumn("rank", F.lit(0))))
    assert got == wanted and any(r[0] is None for r in got)
    assert result(lexical_search(docs.limit(0), asked)) == result(lexical_search(docs, asked.limit(0))) == []
