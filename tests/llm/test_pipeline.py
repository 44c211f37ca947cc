import corpus_pipeline as C
import pytest

from . import brute


def test_stages_and_run(spark, folder, sample):
    names = [n for n, _ in C.STAGES]
    assert names == ["quality_rules", "line_dedup", "simhash_dedup", "source_mix", "sentencepiece"]
    rows, docs = sample
    columns = docs.columns
    for name, stage in C.STAGES[:-1]:
        before = docs
        docs = C.written(stage(spark, docs, folder), f"test-{name}")
        assert docs.columns == columns
        had = [(r.doc_id, r.source, r.text) for r in before.collect()]
        got = {r.doc_id: r.text for r in docs.collect()}
        if name == "quality_rules":
            assert set(got) == {d for d, v in brute.quality(had).items() if v[-1]}
        elif name == "line_dedup":
            assert got == brute.line_dedup([(d, t) for d, _, t in had])
        elif name == "simhash_dedup":
            assert set(got) == {c for _, c in brute.near_duplicates([(d, t) for d, _, t in had]).values()}
    last = C.run(spark, folder).collect()
    assert len(last) == docs.count() and all(r.lossless for r in last)
    assert sorted((r.doc_id, r.n_pieces) for r in last) == sorted((r.doc_id, r.n_pieces) for r in C.STAGES[-1][1](spark, docs, folder).collect())


@pytest.mark.parametrize("extra", [True, False])
def test_edges_pass_through_every_stage(spark, edges, documents, extra):
    for docs in (edges[1], documents([])):
        for name, stage in C.STAGES:
            docs = C.written(stage(spark, docs, ""), f"edge-{name}")
        assert set(docs.columns) == {"doc_id", "n_pieces", "lossless", "ids"}
        if not extra:
            break
