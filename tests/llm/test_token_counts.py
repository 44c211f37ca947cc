import public_tokenizers
import pytest
from pyspark.sql import functions as F

from signalmill.llm import token_counts as T
from signalmill.session import scratch_path

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(PATH)
    return lambda text: len(model.encode(text or "", add_special_tokens=False).ids)


def test_as_the_library_and_from_the_cache(spark, edges, library):
    rows, df = edges
    cache = scratch_path(spark, "test-cache")
    rows = rows + [(20, "a", "<|endoftext|><|startoftext|> x<|endoftext|>y"), (21, "a", "tab\tand\u00a0nbsp\u2003em\x1cfs é e\u0301"), (22, "a", "I'LL we've\n\n  it's 12345 !!!???")]
    df = df.unionByName(spark.createDataFrame([(d, t, "en", s, 0) for d, s, t in rows[-3:]], df.schema))
    want = sorted(str((d, len((t or "").encode()), library(t))) for d, _, t in rows)
    noisy = df.withColumn("digest", F.lit(b"x")).withColumn("n_tokens", F.lit("clash"))
    assert sorted(str(tuple(r)) for r in T.count_tokens(noisy, PATH, cache).collect()) == want
    stored = spark.read.parquet(cache).count()
    assert stored == T.read_cache(spark, cache).count()  # each distinct text once
    assert sorted(str(tuple(r)) for r in T.count_tokens(df, PATH, cache).collect()) == want
    assert spark.read.parquet(cache).count() == stored  # nothing new to encode


def test_hits_are_believed_and_versions_kept_apart(spark, documents, library):
    cache = scratch_path(spark, "test-cache")
    df = documents([(1, "a", "some  words\nhere"), (2, "a", "some words here"), (3, "a", "other")])
    T.count_tokens(df.where("doc_id = 1"), PATH, cache).collect()
    stored = spark.read.parquet(cache)
    assert stored.count() == 1
    fake = scratch_path(spark, "test-cache")
    stored.withColumn("n_tokens", F.lit(99).cast("long")).write.parquet(fake)
    stored.withColumn("version", F.lit("old")).withColumn("n_tokens", F.lit(7).cast("long")).write.mode("append").parquet(fake)
    got = {r.doc_id: r.n_tokens for r in T.count_tokens(df, PATH, fake).collect()}
    assert got == {1: 99, 2: 99, 3: library("other")}


def test_many_misses_take_the_other_way(spark, documents, library, monkeypatch):
    monkeypatch.setattr(T, "SENT_MISSES", 0)
    rows = [(i, "a", f"text number {i % 7}") for i in range(50)]
    got = {r.doc_id: r.n_tokens for r in T.count_tokens(documents(rows), PATH, scratch_path(spark, "test-cache")).collect()}
    assert got == {d: library(t) for d, _, t in rows}


def test_sentencepiece_files(spark, documents):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    rows = [(1, "a", "Hello  world\n"), (2, "a", None), (3, "a", " x")]
    got = {r.doc_id: r.n_tokens for r in T.count_tokens(documents(rows), path, scratch_path(spark, "test-cache")).collect()}
    assert got == {d: len(model.encode(t or "")) for d, _, t in rows}


def test_empty_table(spark, documents):
    assert T.count_tokens(documents([]), PATH, scratch_path(spark, "test-cache")).collect() == []


def test_the_query(spark, folder, sample, library):
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in T.op10_token_counts(spark, folder).collect()}
    assert got == {d: (len(t.encode()), library(t), library(t) > 2048) for d, _, t in sample[0]}
