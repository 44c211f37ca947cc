import pytest
from pyspark.sql import types as T

DOCS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
])


@pytest.fixture(scope="session")
def documents(spark):
    """Makes a documents table from (doc_id, source, text)."""

    def make(rows):
        return spark.createDataFrame([(d, t, "en", s, None if t is None else len(t)) for d, s, t in rows], DOCS)

    return make


@pytest.fixture(scope="session")
def sample(spark, folder):
    """The smallest given documents as rows and as table."""
    df = spark.read.parquet(f"{folder}/documents.parquet")
    return [(r.doc_id, r.source, r.text) for r in df.collect()], df


LONG = " ".join(f"w{i % 977}x{i}" for i in range(30_000))

#: Nulls in every column, empty and blank texts, a very long one, ties and repeated rows.
EDGES = [
    (1, "a", "one two three four five six\nseven eight nine\nten eleven twelve"), (1, "a", "one two three four five six\nseven eight nine\nten eleven twelve"),
    (2, "b", None), (3, None, ""), (None, "a", "one two three four five six\nseven eight nine\nten eleven twelve"), (None, None, None),
    (4, "c", " \n\t \r"), (5, "a", LONG), (6, "b", LONG), (7, "b", "é 日本 😀 ▁x▁ \x00 <s> <|endoftext|> Ünï"), (8, "c", "\n" * 50), (9, "c", "word " * 200),
]


@pytest.fixture(scope="session")
def edges(documents):
    return EDGES, documents(EDGES)
