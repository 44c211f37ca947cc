import math

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from signalmill.llm import pieces as P

PATH = public_tokenizers.path("piece_bpe_32k.model")
TEXTS = ["", "hello world", "  a  b\n\tc ", "日本語 😀😀 ▁x▁ é\x00 z", "a" * 3000 + " b", "\n\n", " ", "😀" * 400, "<s> </s> <0x0A> <unk>", "▁" * 3, "x " * 5000]


@pytest.fixture(scope="module")
def sampler():
    return P.PieceSampler(PATH)


def draw(sampler, texts, seeds):
    ids, at = sampler.sample(texts, np.array(seeds, np.uint64))
    return [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)]


def test_round_trip(sampler):
    library = sentencepiece.SentencePieceProcessor(model_file=PATH)
    for text, ids in zip(TEXTS, draw(sampler, TEXTS, range(len(TEXTS))), strict=True):
        assert sampler.decode(ids) == text
        if "▁" not in text:
            assert library.decode(ids) == text


def test_long_and_short_ways_agree(monkeypatch):
    texts = ["the quick brown fox jumps over the lazy dog, é 日本 again " * 3] * 40
    side = draw(P.PieceSampler(PATH), texts, range(40))
    monkeypatch.setattr(P, "_SIDE_BY_SIDE", 0)
    assert draw(P.PieceSampler(PATH), texts, range(40)) == side


def segmentations(chunk, pieces):
    if not chunk:
        yield ()
    for n in range(1, len(chunk) + 1):
        if chunk[:n] in pieces:
            for rest in segmentations(chunk[n:], pieces):
                yield (pieces[chunk[:n]][0], *rest)


def test_draws_follow_the_weights(sampler):
    """The share of each segmentation of a word is the product of its pieces' weights."""
    word, n = "▁tions", 20_000
    library = sentencepiece.SentencePieceProcessor(model_file=PATH)
    weight = lambda ids: math.prod(1 / (math.e - library.get_score(i)) for i in ids)
    every = {s: weight(s) for s in segmentations(word, sampler.pieces)}
    total = sum(every.values())
    counts = {}
    for ids in draw(sampler, ["tions"] * n, range(1, n + 1)):
        counts[tuple(ids)] = counts.get(tuple(ids), 0) + 1
    assert set(counts) <= set(every)
    for s, w in every.items():
        share = w / total
        assert abs(counts.get(s, 0) - n * share) <= 5 * math.sqrt(n * share) + 3


def test_forgetting_changes_nothing(monkeypatch):
    texts = [f"some words {i} and more" for i in range(30)]
    want = draw(P.PieceSampler(PATH), texts, range(30))
    monkeypatch.setattr(P, "_EDGES_KEPT", 10)
    forgetful = P.PieceSampler(PATH)
    assert [draw(forgetful, [t], [i])[0] for i, t in enumerate(texts)] == want


def test_edges(edges, documents):
    rows, df = edges
    clash = df.withColumn("ids", F.lit("x")).withColumn("__seed", F.lit(1)).withColumn("lossless", F.lit(2))
    encoded = P.encode_pieces(clash, PATH, verify=True)
    got = encoded.collect()
    assert sorted((str(r.doc_id), r.ids is None, r.lossless) for r in got) == sorted((str(d), t is None, None if t is None else True) for d, _, t in rows)
    back = P.decode_pieces(P.encode_pieces(df, PATH, carry=("source",)), PATH).collect()
    assert sorted(str((r.doc_id, r.source, r.text)) for r in back) == sorted(map(str, rows))
    again = P.encode_pieces(df.repartition(5), PATH).collect()
    assert sorted(str((r.doc_id, r.ids)) for r in again) == sorted(str((r.doc_id, r.ids)) for r in got)
    assert P.encode_pieces(documents([]), PATH).collect() == []


def test_seed_and_key_change_the_draw(documents):
    text = "reproducible segmentation of several interesting words " * 5
    df = documents([(1, "a", text), (2, "a", text)])
    one = {r.doc_id: r.ids for r in P.encode_pieces(df, PATH).collect()}
    assert one[1] != one[2] and one != {r.doc_id: r.ids for r in P.encode_pieces(df, PATH, seed=12).collect()}


def test_the_query(spark, folder, sample):
    rows = P.op2_sentencepiece(spark, folder).collect()
    assert len(rows) == len(sample[0]) and all(r.lossless and r.n_pieces == len(r.ids) for r in rows)
