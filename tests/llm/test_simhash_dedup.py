import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from signalmill.llm import simhash_dedup as S

from . import brute


def test_keys_of_words_two_bits_apart_meet():
    """All cosets against all errors of one and two bits: linear code, so this covers every pair of words."""
    golay = S.Golay.get()
    leaders = np.array([w for n in range(4) for w in S._words_of_weight(n)])
    assert len(leaders) == 2048
    keys, there = golay.keys(leaders)
    assert set(there.sum(1)) == {1, 6}
    own = [set(k[t].tolist()) for k, t in zip(keys, there, strict=True)]
    for places in itertools.chain(itertools.combinations(range(23), 1), itertools.combinations(range(23), 2)):
        other, ok = golay.keys(leaders ^ sum(1 << p for p in places))
        met = [bool(s & set(o[t].tolist())) for s, o, t in zip(own, other, ok, strict=True)]
        assert all(met), places


def test_fuzzy_keys_of_linked_prints_meet():
    rng = random.Random(3)
    for _ in range(300):
        a = rng.getrandbits(64)
        b = a
        for bit in rng.sample(range(64), rng.randint(0, 4)):
            b ^= 1 << bit
        keys, owner = S.fuzzy_keys(np.array([a, b], np.uint64))
        assert set(keys[owner == 0]) & set(keys[owner == 1])


def links(spark, values):
    df = spark.createDataFrame([(int(np.uint64(v).astype(np.int64)),) for v in values], "fingerprint long")
    roots = {r.node % 2**64: r.root for r in S.components(S.fuzzy_links(df)).collect()}
    groups = {}
    for v in values:
        groups.setdefault(roots.get(v, ("alone", v)), set()).add(v)
    return sorted(map(sorted, groups.values()))


def plain(values):
    groups = {}
    for v, root in brute.components(values).items():
        groups.setdefault(root, set()).add(v)
    return sorted(map(sorted, groups.values()))


@pytest.mark.parametrize("block", [1 << 16, 40])
def test_components_of_chains_and_crowds(spark, monkeypatch, block):
    monkeypatch.setattr(S, "BLOCK", block)
    rng = random.Random(7)
    values = set()
    for _ in range(20):
        v = rng.getrandbits(64)
        for _ in range(30):  # a chain, each link four bits from the last
            values.add(v)
            for bit in rng.sample(range(64), 4):
                v ^= 1 << bit
    centre = rng.getrandbits(64)
    values |= {centre ^ (1 << a) ^ (1 << b) for a in range(20) for b in range(a + 1, 20)}  # a crowd
    values |= {rng.getrandbits(64) for _ in range(500)}
    # the workers read BLOCK from their own module, so the split is exercised here directly
    keys, owners = S.fuzzy_keys(np.array(sorted(values), np.uint64))
    edges, large = S._linked(keys, np.array(sorted(values), np.uint64)[owners], 4)
    assert bool(large) == (block == 40)
    if block > 40:
        assert links(spark, sorted(values)) == plain(values)


def test_links_between_blocks():
    rng = random.Random(9)
    base = rng.getrandbits(64)
    values = [base ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(60)] + [rng.getrandbits(64) for _ in range(60)]
    left, right = np.array(sorted(set(values[::2])), np.uint64), np.array(sorted(set(values[1::2])), np.uint64)
    parent = {int(v): int(v) for v in [*left, *right]}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    parts = [S.spanning_links(left, 4), S.spanning_links(right, 4), S.spanning_links(left, 4, right)]
    for a, b in itertools.chain(*parts):
        for x, y in zip(a.tolist(), b.tolist(), strict=True):
            assert (x ^ y).bit_count() <= 4
            parent[root(x)] = root(y)
    groups = {}
    for v in parent:
        groups.setdefault(root(v), set()).add(v)
    assert sorted(map(sorted, groups.values())) == plain(list(parent))


def test_edges(edges):
    rows, df = edges
    noisy = df.withColumn("fingerprint", F.lit("clash")).withColumn("component_id", F.lit(0)).withColumn("__root", F.lit(1))
    got = S.near_duplicates(noisy).collect()
    prints = [brute.fingerprint(t) for _, _, t in rows]
    group, least = brute.components(prints), {}
    for (d, _, _), p in zip(rows, prints, strict=True):
        least[group[p]] = min((x for x in (d, least.get(group[p])) if x is not None), default=None)
    want = [(d, p, least[group[p]]) for (d, _, _), p in zip(rows, prints, strict=True)]
    assert sorted(map(str, want)) == sorted(str((r.doc_id, r.fingerprint % 2**64, r.component_id)) for r in got)


def test_one_of_each_stays(edges, documents):
    rows, df = edges
    kept = S.keep_one_of_each(df.withColumn("__content", F.lit("x")).withColumn("__key", F.lit("y")))
    assert kept.columns == [*df.columns, "__content", "__key"]
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2, 5, 7, 9]
    nameless = documents([(None, "a", "p q r s t"), (None, "a", "p q r s t"), (None, "b", "u v w x y z")])
    assert sorted(r.text for r in S.keep_one_of_each(nameless).collect()) == ["p q r s t", "u v w x y z"]
    assert S.keep_one_of_each(documents([])).collect() == []


def test_the_query(spark, folder, sample):
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in S.op9_simhash_dedup(spark, folder).collect()}
    assert got == brute.near_duplicates([(d, t) for d, _, t in sample[0]])
