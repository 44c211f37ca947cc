import pytest

from signalmill.llm import source_mix as M


def test_all_whole_passes_are_taken(documents):
    rows = [(i, "small", "word " * 10) for i in range(5)] + [(100 + i, "large", "word " * 400) for i in range(10)]
    taken, target = {}, {}
    for r in M.mix_documents(documents(rows), carry=("doc_id", "source"), most=5).collect():
        taken[r.source] = taken.get(r.source, 0) + r.taken
        target[r.source] = r.target
    assert target["small"] == pytest.approx(250)
    assert all(abs(taken[s] - target[s]) <= 0.5 + 1e-6 for s in target)
