import numpy as np
import pytest
from pyspark.sql import functions as F

from signalmill.llm import source_mix as M

from . import brute


def test_splitting_tree_is_exact_and_fair():
    quotas = [1000, 37, 0, 5000, 1]
    tree = M.splitting_tree(quotas, 7, 1)
    assert tree.sum(0).tolist() == quotas and (tree >= 0).all()
    assert max(tree.sum(1)) - min(tree.sum(1)) <= 1
    draws = np.array([M.splitting_tree([60, 40], 4, s)[0, 0] for s in range(400)])
    assert abs(draws.mean() - 15) < 0.5 and abs(draws.var() - 25 * 0.6 * 0.4 * 75 / 99) < 1.5
    assert M.splitting_tree([10**11, 10**10], 2, 3).sum(0).tolist() == [10**11, 10**10]


def check(rows, got):
    sizes = [len(brute.WORD.findall(t or "")) for _, _, t in rows]
    total = {}
    for (_, s, _), n in zip(rows, sizes, strict=True):
        total[s] = total.get(s, 0) + n
    target = brute.targets(total)
    assert sorted(map(str, ((d, n, total[s], s) for (d, s, _), n in zip(rows, sizes, strict=True)))) == sorted(str((r.doc_id, r.size, r.source_size, r.source)) for r in got)
    for s in total:
        own = [r for r in got if r.source == s]
        assert all(r.target == pytest.approx(target[s], abs=1e-6) for r in own)
        assert abs(sum(r.taken for r in own) - target[s]) <= 0.5 + 1e-6
    assert all(0 <= r.taken <= 3 * r.size for r in got)


def test_targets_and_quotas(documents):
    rows = [(i, f"s{i % 5}", "word " * (1 + i * 37 % 400)) for i in range(200)] + [(1000 + i, "t", "x y") for i in range(3)]
    rows += [(2000, "long", "y " * 9000), (2001, None, "z " * 50)]
    got = M.mix_documents(documents(rows), carry=("doc_id", "source")).collect()
    check(rows, got)
    again = M.mix_documents(documents(rows[::-1]).repartition(7), carry=("doc_id", "source")).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_draws_are_disjoint(documents):
    rows = [(i, f"s{i % 3}", "word " * (1 + i * 37 % 4000)) for i in range(100)]
    mix = M.Mix(documents(rows), block_words=100, shards=5)
    draws = mix.draws.collect()
    assert len({(r["__row"], r.block, r.copy) for r in draws}) == len(draws)
    counts = [sum(r.shard == k for r in draws) for k in range(5)]
    assert set(range(5)) == {r.shard for r in draws} and max(counts) - min(counts) <= 1


def test_texts_hold_what_was_taken(spark, documents, tmp_path):
    rows = [(i, f"s{i % 4}", f"a{i}\n" + f"w{i} \t" * (i * 53 % 700)) for i in range(120)]
    df = documents(rows).withColumn("__shard", F.lit("x")).withColumn("takes", F.lit("y"))
    how = {"block_words": 64, "shards": 3}
    taken = {r.doc_id: r.taken for r in M.mix_documents(df, **how).collect()}
    mixed = M.mixed_texts(df.drop("__shard"), **how)
    out = mixed.collect()
    for d, _, text in rows:
        copies = [r.text for r in out if r.doc_id == d]
        assert sum(len(brute.WORD.findall(t)) for t in copies) == taken[d]
        assert all(t == text or len(t) < len(text) for t in copies)
    assert all(r.n_chars == len(r.text) for r in out)
    M.write_shards(mixed, str(tmp_path / "shards"), 3)
    assert spark.read.parquet(str(tmp_path / "shards")).count() == len(out)


def test_edges(edges, documents):
    rows, df = edges
    clash = df.withColumn("size", F.lit("x")).withColumn("s", F.lit(1)).withColumn("target", F.lit(0))
    check(rows, M.mix_documents(clash, carry=("doc_id", "source")).collect())
    out = M.mixed_texts(df)
    assert set(df.columns) < set(out.columns) and all(r.text.strip() for r in out.collect())
    assert M.mix_documents(documents([])).collect() == [] and M.mixed_texts(documents([])).collect() == []
    assert [r.taken for r in M.mix_documents(documents([(1, "a", None), (2, "b", " ")])).collect()] == [0, 0]


def test_joined_when_sources_are_many(documents, monkeypatch):
    rows = [(i, f"s{i % 40}", "word " * (1 + i % 9)) for i in range(400)]
    want = sorted(map(str, M.mix_documents(documents(rows)).collect()))
    monkeypatch.setattr(M, "SENT_SOURCES", 0)
    assert sorted(map(str, M.mix_documents(documents(rows)).collect())) == want


def test_the_query(spark, folder, sample):
    rows, df = sample
    source = {d: s for d, s, _ in rows}
    got = [r.asDict() | {"source": source[r.doc_id]} for r in M.op4_source_mix(spark, folder).collect()]

    class Row(dict):
        __getattr__ = dict.__getitem__

    check(rows, [Row(r) for r in got])
