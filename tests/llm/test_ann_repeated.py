import numpy as np
import pytest
from signalmill.llm import ann as A

from .test_ann import run


def exact(ids, x, k=10):
    """The k nearest other ids of every hundredth id, each with its nearest pair of rows."""
    out = {}
    for q in {int(i) for i in ids if i % 100 == 0}:
        own = x[ids == q]
        d = np.sqrt(((x[:, None, :] - own[None, :, :]) ** 2).sum(2)).min(1)
        least = {}
        for i, v in zip(ids.tolist(), d.tolist(), strict=True):
            if i != q:
                least[i] = min(v, least.get(i, np.inf))
        out[q] = sorted(((v, i) for i, v in least.items()))[:k]
    return {q: [(i, pytest.approx(v, abs=1e-9)) for v, i in found] for q, found in out.items()}


def repeated(number, times, d=16, seed=2):
    """``times`` rows close to one another for each of ``number`` ids, each row twice."""
    rng = np.random.default_rng(seed)
    centre = rng.standard_normal((20, d))[rng.integers(0, 20, number)] * 2 + rng.standard_normal((number, d))
    x = (np.repeat(centre, times, 0) + 0.05 * rng.standard_normal((number * times, d))).astype(np.float32)
    ids = np.repeat(np.arange(number) * 20, times)
    return np.tile(ids, 2), np.tile(x, (2, 1))


def table(ids, x):
    return [(int(i), v.tolist(), "x") for i, v in zip(ids, x, strict=True)]


@pytest.mark.parametrize(("number", "times"), [(60, 5), (30, 50)])
@pytest.mark.parametrize("block", [64, 4096])
def test_repeated_ids_count_once(spark, monkeypatch, number, times, block):
    monkeypatch.setattr(A, "BLOCK", block)
    monkeypatch.setattr(A, "MOST_PARTS", 1)
    ids, x = repeated(number, times)
    assert run(spark, table(ids, x)) == exact(ids, x.astype(float))


def test_an_id_with_many_near_rows_hides_no_other(spark):
    rng = np.random.default_rng(4)
    ids = np.concatenate((np.arange(100), np.full(60, 1000))) + 1
    x = np.concatenate((rng.standard_normal((100, 8)), np.zeros((60, 8)))).astype(np.float32)
    x[99] = 0.5
    x[100:] = x[99] + 0.01 * rng.standard_normal((60, 8)).astype(np.float32)
    assert ids[99] == 100
    assert run(spark, table(ids, x)) == exact(ids, x.astype(float))


@pytest.mark.parametrize(("number", "times"), [(1200, 5), (120, 50)])
def test_recall_with_parts(spark, number, times):
    ids, x = repeated(number, times)
    got, want = run(spark, table(ids, x)), exact(ids, x.astype(float))
    assert set(got) == set(want) and all(len(v) == 10 for v in got.values())
    recall = np.mean([len({v for v, _ in got[q]} & {v for v, _ in want[q]}) / 10 for q in want])
    print("recall", number, times, recall)
    assert recall >= 0.9


def test_one_id_has_no_neighbours(spark):
    ids, x = repeated(1, 700)
    assert run(spark, table(ids, x)) == {}
