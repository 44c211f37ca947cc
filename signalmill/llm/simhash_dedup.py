"""SimHash near-duplicates: 64-bit fingerprints, Golay-code fuzzy keys, verified links, connected components.

A fingerprint falls into segments of 22, 21 and 21 bits, each a word of the perfect binary Golay code of length 23.
The keys of a segment are the indices of all codewords within four bits: one if the nearest codeword is at most two
bits away, else six. Any two words at most two bits apart share such a key. Of at most four differing bits, the two
least affected segments hold at most two together, so two linked fingerprints share a pair of keys for at least one
of the three pairs of segments: about 84 keys a fingerprint. Fingerprints that meet under a key are compared bit by bit.

Copies collapse first: only distinct fingerprints get keys. A key's fingerprints need not be expanded into pairs: within
a key a breadth-first search gives the edges of a spanning forest of the verified links, which keeps connectivity.
Keys with more than ``BLOCK`` fingerprints are dealt out again as pairs of blocks.

Defined results: a null or blank text has fingerprint zero and links like any other; repeated rows share a component; the
component of rows whose ids are all null is null; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import same, ship_code, table, written

SEED = 42
#: Segments as (shift, bits).
SEGMENTS = ((42, 22), (21, 21), (0, 21))
PAIRS = ((0, 1), (0, 2), (1, 2))
#: Generator polynomial of the binary Golay code [23, 12, 7].
GENERATOR = 0b110001110101
#: Fingerprints of one key that one task compares at once.
BLOCK = 1 << 16
#: Keys for one task to sort in memory (12 bytes each).
KEYS_PER_TASK = 4_000_000


def fingerprint(data: bytes, size: int = 4) -> int:
    """SimHash of a UTF-8 text: XXH64 of its ``size``-word shingles after lower-casing A-Z."""
    import xxhash

    found = data.lower().split()
    if not found:
        return 0
    joined = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    if len(found) <= size:
        return xxhash.xxh64_intdigest(joined, SEED)
    starts = np.concatenate(([0], ends[:-size] + 1)).tolist()
    h = xxhash.xxh64_intdigest
    hashes = np.fromiter((h(joined[a:b], SEED) for a, b in zip(starts, ends[size - 1:].tolist(), strict=True)), "<u8", len(starts))
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 8192):
        part = hashes[at:at + 8192].view(np.uint8).reshape(-1, 8)
        ones += np.add.reduce(np.unpackbits(part, axis=1, bitorder="little"), axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def _fingerprints(size: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The last column is the text; it is replaced by its fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column(batch.num_columns - 1).cast(pa.large_binary())
            prints = [fingerprint(x.as_py() or b"", size) for x in text]
            column = pa.array(np.array(prints, np.uint64).view(np.int64), pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], column], [*batch.schema.names[:-1], "fingerprint"])

    return run


def fingerprints(docs: DataFrame, text: str, carry: list[str], size: int = 4) -> DataFrame:
    """``carry`` columns and ``fingerprint`` (the 64 bits as a signed long)."""
    ship_code(docs.sparkSession)
    rows = docs.select(*[F.col(f"`{c}`") for c in carry], F.col(f"`{text}`").alias("__text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(_fingerprints(size), schema + (", " if schema else "") + "fingerprint long")


class Golay:
    """Codeword indices near 23-bit words."""

    _made: Golay | None = None

    def __init__(self) -> None:
        data = np.arange(4096, dtype=np.int64)
        rest = data << 11
        for bit in range(22, 10, -1):
            rest = np.where(rest >> bit & 1, rest ^ (GENERATOR << (bit - 11)), rest)
        self.parity = rest
        near = np.full((2048, 6), -1, np.int64)
        filled = np.zeros(2048, np.int64)
        for weight in range(5):
            for error in _words_of_weight(weight):
                syndrome = int(self.parity[error >> 11] ^ (error & 2047))
                if weight < 4 or near[syndrome, 0] >= 0 and int(near[syndrome, 0]).bit_count() == 3:
                    near[syndrome, filled[syndrome]] = error
                    filled[syndrome] += 1
        self.near = near

    @classmethod
    def get(cls) -> Golay:
        cls._made = cls._made or cls()
        return cls._made

    def keys(self, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Indices of the codewords within four bits of each word (n, 6), and which of them count."""
        errors = self.near[self.parity[found >> 11] ^ (found & 2047)]
        return (found[:, None] ^ errors) >> 11, errors >= 0


def _words_of_weight(weight: int) -> Iterator[int]:
    import itertools

    for places in itertools.combinations(range(23), weight):
        yield sum(1 << p for p in places)


def fuzzy_keys(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(key, index into ``prints``) for every pair of segments and of their codeword indices."""
    parts = [Golay.get().keys((prints >> np.uint64(s)).astype(np.int64) & ((1 << n) - 1)) for s, n in SEGMENTS]
    keys, owners = [], []
    for number, (x, y) in enumerate(PAIRS):
        (kx, mx), (ky, my) = parts[x], parts[y]
        both = (number << 24) | (kx[:, :, None] << 12) | ky[:, None, :]
        there = mx[:, :, None] & my[:, None, :]
        keys.append(both[there])
        owners.append(np.broadcast_to(np.arange(len(prints))[:, None, None], there.shape)[there])
    return np.concatenate(keys), np.concatenate(owners)


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 4096):
            prints = batch.column(0)[at:at + 4096].to_numpy(zero_copy_only=False)
            keys, owners = fuzzy_keys(prints.view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int32)), pa.array(prints[owners])], ["key", "fingerprint"])


def spanning_links(left: np.ndarray, bits: int, right: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Edges that connect what links of at most ``bits`` connect: among ``left``, or between ``left`` and ``right``."""
    if right is not None:
        for x in left:
            near = right[np.bitwise_count(right ^ x) <= bits]
            if len(near):
                yield np.full(1, x), near[:1]
                yield np.full(len(near) - 1, near[0]), near[1:]
        return
    rest = left
    while len(rest):
        front, rest = [rest[0]], rest[1:]
        while front and len(rest):
            x = front.pop()
            near = np.bitwise_count(rest ^ x) <= bits
            if near.any():
                found = rest[near]
                yield np.full(len(found), x), found
                front.extend(found)
                rest = rest[~near]


def _linked(keys: np.ndarray, prints: np.ndarray, bits: int):
    """Links under equal keys: (a, b) arrays, and the rows of keys that are too large: (key, print, block, blocks)."""
    order = np.argsort(keys, kind="stable")
    keys, prints = keys[order], prints[order]
    edges, large = [], []
    starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    sizes = np.diff(np.concatenate((starts, [len(keys)])))
    few = np.repeat(sizes <= 16, sizes) & np.repeat(sizes > 1, sizes)
    k, p = keys[few], prints[few]
    for step in range(1, 16):
        both = k[step:] == k[:-step]
        if not both.any():
            break
        both &= np.bitwise_count(p[step:] ^ p[:-step]) <= bits
        edges.append((p[:-step][both], p[step:][both]))
    for start, size in zip(starts[sizes > 16], sizes[sizes > 16], strict=True):
        own = prints[start:start + size]
        if size > BLOCK:
            blocks = -(-size // BLOCK)
            large.append((np.full(size, keys[start]), own, np.arange(size) // BLOCK, np.full(size, blocks)))
        else:
            edges += spanning_links(own, bits)
    return edges, large


def _join(parts: list, count: int, kinds: list) -> list[np.ndarray]:
    return [np.concatenate([x[i] for x in parts]) if parts else np.zeros(0, kinds[i]) for i in range(count)]


def _meet(bits: int):
    """(key, fingerprint) of whole keys to links (a, b, null), and to rows (print, block, blocks) of too large keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        taken = [(b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False)) for b in batches if b.num_rows]
        if not taken:
            return
        keys, prints = _join(taken, 2, [np.int32, np.int64])
        edges, large = _linked(keys, prints.view(np.uint64), bits)
        a, b = _join(edges, 2, [np.uint64, np.uint64])
        pairs = np.unique(np.stack([np.maximum(a, b), np.minimum(a, b)]), axis=1) if len(a) else np.zeros((2, 0), np.uint64)
        nothing = pa.nulls(pairs.shape[1], pa.int32())
        names = ["a", "b", "key", "block", "blocks"]
        yield pa.RecordBatch.from_arrays([pa.array(pairs[0].copy().view(np.int64)), pa.array(pairs[1].copy().view(np.int64)), *[nothing] * 3], names)
        for key, own, block, blocks in large:
            ints = [pa.array(x.astype(np.int32)) for x in (key, block, blocks)]
            yield pa.RecordBatch.from_arrays([pa.array(own.view(np.int64)), pa.nulls(len(own), pa.int64()), *ints], names)

    return run


def _meet_blocks(bits: int):
    """(fingerprint, key, low, high, is low), sorted: links between the two blocks of each key, or within one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, now = ([], []), None

        def close():
            left, right = (np.array(x, np.int64).view(np.uint64) for x in held)
            links = list(spanning_links(left, bits, None if now[1] == now[2] else right))
            a, b = _join(links, 2, [np.uint64, np.uint64])
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

        for batch in batches:
            for print_, *place, low in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if place != now:
                    if now is not None:
                        yield close()
                    held, now = ([], []), place
                held[0 if low else 1].append(print_)
        if now is not None:
            yield close()

    return run


def fuzzy_links(prints: DataFrame, bits: int = 4) -> DataFrame:
    """Edges (a, b) among distinct ``fingerprint`` values that connect all pairs of at most ``bits`` (four) apart."""
    if bits > 4:
        raise ValueError("three segments find pairs of at most four differing bits")
    spark = prints.sparkSession
    ship_code(spark)
    nodes = written(prints.select("fingerprint"), "prints")
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-nodes.count() * 84 // KEYS_PER_TASK))
    keyed = nodes.mapInArrow(_keys, "key int, fingerprint long").repartition(tasks, "key")
    met = written(keyed.mapInArrow(_meet(bits), "a long, b long, key int, block int, blocks int"), "links")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    large = met.where("key IS NOT NULL").select("a", "key", "block", other.alias("other"))
    dealt = large.select(
        F.col("a").alias("fingerprint"), "key", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"),
        (F.col("block") <= F.col("other")).alias("is_low"),
    )
    blocks = dealt.repartition("key", "low", "high").sortWithinPartitions("key", "low", "high")
    more = blocks.mapInArrow(_meet_blocks(bits), "a long, b long")
    return met.where("b IS NOT NULL").select("a", "b").unionByName(more).where("a != b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of the edges (a, b), by alternating large and small stars; root is the least node."""
    step = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "stars")
    state = None
    while True:
        both = step.unionByName(step.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        step = written(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct(), "stars")
        now = tuple(step.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())
        if now == state:
            return step.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
                step.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
            )
        state = now


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", carry: tuple[str, ...] = (), size: int = 4, bits: int = 4) -> DataFrame:
    """One row per document: ``key``, ``carry``, ``fingerprint``, ``__root`` and ``component_id``.

    The component is the least key of all documents reachable over links of at most ``bits``.
    """
    rows = written(fingerprints(docs, text, [key, *carry], size), "fingerprints")
    nodes = rows.groupBy("fingerprint").agg(F.min(f"`{key}`").alias("__least"))
    roots = components(fuzzy_links(nodes, bits))
    nodes = nodes.join(roots, nodes["fingerprint"] == roots["node"], "left").select(
        "fingerprint", "__least", F.coalesce("root", "fingerprint").alias("__root")
    )
    nodes = written(nodes, "nodes")
    whole = nodes.groupBy("__root").agg(F.min("__least").alias("component_id"))
    owned = nodes.join(whole, "__root").select("fingerprint", "__root", "component_id")
    return rows.join(owned, "fingerprint").select(
        *[rows[f"`{c}`"] for c in (key, *carry)], "fingerprint", "__root", "component_id"
    )


def keep_one_of_each(docs: DataFrame, text: str = "text", key: str = "doc_id", size: int = 4, bits: int = 4) -> DataFrame:
    """One document of each component, with all its columns: the one of the least key (null last), then content."""
    keyed = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__doc"), F.col(f"`{key}`").alias("__key"),
        F.xxhash64(F.col(f"`{text}`")).alias("__content"), F.col(f"`{text}`").alias("__text"),
    )
    found = written(near_duplicates(keyed, "__text", "__key", ("__content",), size, bits), "components")
    first = F.min(F.struct(F.col("__key").isNull().alias("n"), F.col("__key").alias("k"), F.col("__content").alias("c")))
    kept = found.groupBy("__root").agg(first.alias("f")).select(F.col("f.k").alias("__key"), F.col("f.c").alias("__content"))
    rows = keyed.drop("__text")
    rows = rows.join(kept.hint("shuffle_hash"), same(rows, kept, ["__key", "__content"]), "left_semi")
    if not found.groupBy("__key", "__content").count().where("count > 1").isEmpty():  # repeated rows: one of them
        turn = Window.partitionBy("__key", "__content").orderBy(F.xxhash64("__doc"))
        rows = rows.withColumn("__turn", F.row_number().over(turn)).where("__turn = 1")
    return rows.select(*[F.col("__doc").getField(c).alias(c) for c in docs.columns])


def hexadecimal(prints: Column) -> Column:
    return F.lower(F.lpad(F.hex(prints), 16, "0"))


def op9_simhash_dedup(spark, folder: str) -> DataFrame:
    found = near_duplicates(table(spark, folder, "documents").select("doc_id", "text"))
    return found.select("doc_id", hexadecimal(F.col("fingerprint")).alias("fingerprint"), "component_id")
