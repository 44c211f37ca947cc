"""From documents to sampled pieces: quality rules, line dedup, near-duplicates, mixing, encoding.

Each stage takes (spark, docs, sf_dir), works on all rows that the stage before kept, and gives the columns of documents;
the last gives doc_id, the mixed copy's text digest and its pieces. ``run`` writes every stage's result and reads it
again, so a lost executor costs one stage at most.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from signalmill.llm.common import table, written
from signalmill.llm.line_dedup import dedup_lines
from signalmill.llm.pieces import encode_pieces
from signalmill.llm.quality_rules import apply_quality
from signalmill.llm.simhash_dedup import keep_one_of_each
from signalmill.llm.source_mix import mixed_texts

MODEL = "piece_bpe_32k.model"


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rule and are not depleted, without the lines that too many documents share."""
    return apply_quality(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the chunks of lines that have occurred before."""
    return dedup_lines(docs).select(*[F.col(f"`{c}`") for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: four-word shingles, at most four differing bits."""
    return keep_one_of_each(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each copy that the mix takes of a document; a copy taken in part holds the blocks drawn."""
    return mixed_texts(docs).select(*[F.col(f"`{c}`") for c in docs.columns])


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, number of pieces, the pieces, and whether decoding them gives the text."""
    encoded = encode_pieces(docs, public_tokenizers.path(MODEL), verify=True)
    return encoded.select("doc_id", F.size("ids").cast("long").alias("n_pieces"), "lossless", "ids")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality),
    ("line_dedup", lines),
    ("simhash_dedup", near_duplicates),
    ("source_mix", mix),
    ("sentencepiece", encode),
]

#: Rolling hashes, XXH64 fingerprints and the sampled draws have no SQL form.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
