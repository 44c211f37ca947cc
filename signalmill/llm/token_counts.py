"""Token counts through a digest cache: stored counts by digest of content and tokenizer; only new content is encoded.

Content is normalised by turning runs of ASCII white space into one blank, which the tokenizer drops anyway, and
hashed with SHA-256. The cache is a folder of Parquet files (digest, version, n_tokens); a run joins the digests of its
documents to it, encodes the distinct misses once, and appends them.

Texts travel in one shuffle only, compressed, and at most once per digest and scan task: repeated texts stop where
they are read, so a text copied a million times arrives as a few rows. Hits never travel when the misses are few
enough to be sent to every task (a checked bound); otherwise miss marks travel with the texts and are met by sorting.

The library counts distinct words, not whole texts: white space ends every pre-token and every special string, so the
tokens of a text are those of its words, whose counts a bounded dictionary remembers.

Defined results: a null text is empty; empty and blank texts have no tokens; repeated rows count alike.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import scratch_path
from .common import GAP, ship_code, table, written

CACHE_SCHEMA = "digest binary, version string, n_tokens long"
#: Up to so many miss digests (36 bytes each) go to every task; more are joined.
SENT_MISSES = 20_000
_WORDS_KEPT = 400_000


class WordCounter:
    """Token counts of texts as a vocabulary file's library gives them; one per Python worker and file."""

    _open: dict[str, WordCounter] = {}

    def __init__(self, path: str):
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self.each = lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
            self.by_word = False
        else:
            from tokenizers import Tokenizer

            model = Tokenizer.from_file(path)
            model.no_truncation()
            model.no_padding()
            self.each = lambda texts: [len(x.ids) for x in model.encode_batch_fast(texts, add_special_tokens=False)]
            self.by_word = True
        self.known: dict[str, int] = {}

    @classmethod
    def of(cls, path: str) -> WordCounter:
        if path not in cls._open:
            import os

            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            cls._open[path] = cls(path)
        return cls._open[path]

    def count(self, texts: list[str]) -> list[int]:
        if not self.by_word:
            return self.each(texts)
        if len(self.known) > _WORDS_KEPT:
            self.known.clear()
        split = [x.split(" ") for x in texts]
        known = self.known
        new = list(set().union(*split).difference(known))
        known.update(zip(new, self.each(new), strict=True))
        return [sum(map(known.__getitem__, x)) for x in split]


def _splits_at_blanks(path: str) -> bool:
    """Whether the words of a text can be encoded one by one: the file drops white space before it merges."""
    if path.endswith(".model"):
        return False
    import json

    with open(path, encoding="utf-8") as f:
        known = json.load(f)
    text = json.dumps(known.get("pre_tokenizer"))
    return "Removed" in text and not any(c in x["content"] for x in known["added_tokens"] for c in " \t\n\x0b\x0c\r")


def tokenizer_version(path: str) -> str:
    """Digest of the vocabulary file and of the way it is applied."""
    with open(path, "rb") as f:
        return hashlib.sha256(f.read() + b"|no added tokens, no truncation, no padding").hexdigest()


def read_cache(spark, path: str) -> DataFrame:
    """The stored counts; empty if the folder does not exist yet. A count stored twice is read once."""
    try:
        stored = spark.read.schema(CACHE_SCHEMA).parquet(path)
    except AnalysisException:
        stored = spark.createDataFrame([], CACHE_SCHEMA)
    return stored.groupBy("digest", "version").agg(F.max("n_tokens").alias("n_tokens"))


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(digest, text) to (digest, packed text), each digest once per task as far as a bounded set remembers."""
    import zstandard

    press, seen = zstandard.ZstdCompressor(level=1), set()
    for batch in batches:
        digests, texts = batch.column(0).to_pylist(), batch.column(1)
        keep = []
        for i, d in enumerate(digests):
            if d not in seen:
                if len(seen) > 1_000_000:
                    seen.clear()
                seen.add(d)
                keep.append(i)
        packed = [press.compress(texts[i].as_buffer()) if texts[i].as_buffer() is not None else b"" for i in keep]
        yield pa.RecordBatch.from_arrays([pa.array([digests[i] for i in keep], pa.binary()), pa.array(packed, pa.binary())], ["digest", "packed"])


def _encoder(path: str):
    """(digest, packed or null), sorted: encodes the first text of each digest that carries a mark (a null first)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        counter, press = WordCounter.of(path), zstandard.ZstdDecompressor()
        marked, done = None, None
        for batch in batches:
            ids, texts = [], []
            for digest, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if packed is None:
                    marked = digest
                elif digest == marked and digest != done:
                    done = digest
                    ids.append(digest)
                    texts.append(press.decompress(packed).decode() if packed else "")
            for at in range(0, len(ids), 256):
                counts = counter.count(texts[at:at + 256])
                yield pa.RecordBatch.from_arrays([pa.array(ids[at:at + 256], pa.binary()), pa.array(counts, pa.int64())], ["digest", "n_tokens"])

    return run


def count_tokens(docs: DataFrame, tokenizer: str, cache: str, text: str = "text", carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row per document: ``carry``, ``n_bytes``, ``n_tokens``. Distinct misses are appended to the cache folder."""
    spark, version = docs.sparkSession, tokenizer_version(tokenizer)
    ship_code(spark)
    kept = [F.col(f"`{c}`") for c in carry]
    whole = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    normal = F.regexp_replace(whole, GAP, " ") if _splits_at_blanks(tokenizer) else whole
    digest = F.unhex(F.sha2(normal, 256))
    rows = written(docs.select(*kept, digest.alias("__digest"), F.octet_length(whole).cast("long").alias("n_bytes")), "digests")
    stored = read_cache(spark, cache).where(F.col("version") == version)
    misses = written(
        rows.select(F.col("__digest").alias("digest")).distinct().join(stored, "digest", "left_anti"), "misses"
    )
    n_misses = misses.count()
    if n_misses:
        texts = docs.select(digest.alias("digest"), normal.alias("text"))
        if n_misses <= SENT_MISSES:
            texts = texts.join(F.broadcast(misses), "digest", "left_semi")
        packed = texts.mapInArrow(_packed, "digest binary, packed binary")
        marks = misses.select("digest", F.lit(None).cast("binary").alias("packed"))
        met = marks.unionByName(packed).repartition("digest").sortWithinPartitions("digest", F.col("packed").isNotNull())
        new = met.mapInArrow(_encoder(tokenizer), "digest binary, n_tokens long")
        new.select("digest", F.lit(version).alias("version"), "n_tokens").write.mode("append").parquet(cache)
    counts = read_cache(spark, cache).where(F.col("version") == version)
    return rows.join(counts, rows["__digest"] == counts["digest"]).select(*kept, "n_bytes", "n_tokens")


def op10_token_counts(spark, folder: str) -> DataFrame:
    """Over a cache of its own, so that every run does the whole work."""
    import public_tokenizers

    docs = table(spark, folder, "documents").select("doc_id", "text")
    counts = count_tokens(docs, public_tokenizers.path("word_bpe_49k.json"), scratch_path(spark, "token-cache"))
    return counts.withColumn("over_limit", F.col("n_tokens") > 2048)
