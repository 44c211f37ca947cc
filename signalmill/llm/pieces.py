"""SentencePiece encoding by forward filtering and backward sampling, and decoding.

The pieces that fit a text form a lattice. A forward pass gives, at each end, the weight of all ways to reach it; a
backward pass then draws, from the end, which piece came last, in proportion to weights, and so on to the start: an exact
draw among all segmentations. A piece weighs 1 / (rank + e), to the power ``sharpness``; its rank is its score's for BPE
models. The draw depends on the row key, the chunk's place and the seed alone, so reruns agree, whatever the partitions.

No piece continues after a blank or across a line feed, so the lattice falls into chunks (blanks and what follows them),
whose forward passes are remembered. The backward pass runs for all chunks of a batch at once, a piece at a time.

Decoding is lossless: characters without a piece become UTF-8 byte pieces, and so does a literal U+2581, which the
vocabulary uses for the blank. Texts are taken as they are, without normalisation, after one blank that decoding drops.

Defined results: a null text gives null, an empty one no pieces; rows with equal keys and texts get equal pieces.
"""

from __future__ import annotations

import math
import re
from array import array
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship_code, table

BLANK = "▁"
#: Stands for a literal U+2581; a lone surrogate is in no UTF-8 text.
_LITERAL = "\ud800"
_CHUNK = re.compile(f"{BLANK}*[^{BLANK}\n]+|{BLANK}+|\n")
#: Edges to remember, characters to take at once, and the longest chunk whose forward pass runs beside others.
_EDGES_KEPT, _CHARS_AT_ONCE, _SIDE_BY_SIDE = 6_000_000, 1_000_000, 40
_STEP, _PLACE = 0xD1B54A32D192ED03, np.uint64(0x9E3779B97F4A7C15)


def _uniform(seeds: np.ndarray) -> np.ndarray:
    """Numbers in [0, 1) from 64-bit seeds, by the splitmix64 finaliser."""
    x = seeds.copy()
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return (x >> np.uint64(11)).astype(np.float64) / float(1 << 53)


class PieceTable:
    """Pieces by hash of their characters: open addressing, looked up for whole arrays at once."""

    BASE, MIX = np.uint64(0x9E3779B97F4A7C55), np.uint64(0xBF58476D1CE4E5B9)

    def __init__(self, pieces: dict[str, tuple[int, float]], bits: int = 18):
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.hash, self.id = np.zeros(1 << bits, np.uint64), np.full(1 << bits, -1, np.int32)
        self.probes = 1
        base = int(self.BASE)
        for piece, (number, _) in pieces.items():
            h = 0
            for char in piece:
                h = (h * base + ord(char) + 1) % (1 << 64)
            slot, tries = h * int(self.MIX) % (1 << 64) >> int(self.shift), 1
            while self.id[slot] >= 0:
                slot, tries = (slot + 1) & self.mask, tries + 1
            self.hash[slot], self.id[slot] = h, number
            self.probes = max(self.probes, tries)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The piece of each hash, or -1."""
        slot = (hashes * self.MIX >> self.shift).astype(np.int64)
        out = np.where(self.hash[slot] == hashes, self.id[slot], np.int32(-1))
        for _ in range(1, self.probes):
            open_ = np.flatnonzero((out < 0) & (self.id[slot] >= 0))
            if not len(open_):
                break
            slot[open_] = (slot[open_] + 1) & self.mask
            hit = open_[self.hash[slot[open_]] == hashes[open_]]
            out[hit] = self.id[slot[hit]]
        return out


class PieceSampler:
    """One vocabulary; remembers the forward passes of chunks.

    Nodes are the ends in a chunk. The pieces into a node lie together, from ``first`` of the node, in ``share`` (of the
    ways into it, up to and with this piece; one at the last), ``before`` (node where the piece starts, -1 at the chunk's
    start) and ``piece`` (below -1 for a character that becomes bytes: -2 - its code).
    """

    _open: dict[tuple[str, float], PieceSampler] = {}

    def __init__(self, path: str, sharpness: float = 1.0):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.bytes_of: list[bytes] = []
        self.pieces: dict[str, tuple[int, float]] = {}
        self.byte_id = [0] * 256
        size = model.get_piece_size()
        self.weight = np.zeros(size + 1)
        for i in range(size):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                value = int(piece[3:5], 16)
                self.byte_id[value] = i
                self.bytes_of.append(bytes([value]))
            elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                self.bytes_of.append(b"")
            else:
                # e squared per character keeps long products near one; it is the same for all ways to one end
                self.weight[i] = (math.e - model.get_score(i)) ** -sharpness * math.exp(2.0 * len(piece))
                self.pieces[piece] = (i, float(self.weight[i]))
                self.bytes_of.append(piece.replace(BLANK, " ").encode())
        if any(BLANK in p.lstrip(BLANK) or "\n" in p for p in self.pieces):
            raise ValueError("a piece goes on after a blank or holds a line feed")
        self.rare = (size + math.e) ** -sharpness
        self.longest = max(map(len, self.pieces))
        self.table = PieceTable(self.pieces)
        self._forget()

    def _forget(self) -> None:
        self.ends: dict[str, int] = {}
        self.share, self.nodes, self.edges = np.zeros(0), 0, 0
        self.before, self.piece, self.first = (np.zeros(0, np.int32) for _ in range(3))

    @classmethod
    def of(cls, path: str, sharpness: float) -> PieceSampler:
        if (path, sharpness) not in cls._open:
            cls._open[path, sharpness] = cls(path, sharpness)
        return cls._open[path, sharpness]

    def _fallback(self, codes: np.ndarray) -> np.ndarray:
        """Weights of characters that become bytes."""
        sizes = 1 + (codes > 0x7F) + (codes > 0x7FF) + (codes > 0xFFFF)
        return self.rare ** sizes.astype(np.float64) * math.exp(2.0)

    def _learn(self, chunks: list[str]) -> None:
        """Adds the forward passes of new chunks: short ones side by side, end by end; long ones one at a time."""
        short = sorted((c for c in chunks if len(c) <= _SIDE_BY_SIDE), key=len, reverse=True)
        parts = [(self.share, self.before, self.piece, self.first)]
        if short:
            parts += self._forward_all(short)
        parts += [self._forward_one(c) for c in chunks if len(c) > _SIDE_BY_SIDE]
        self.share, self.before, self.piece, self.first = (np.concatenate([x[i] for x in parts]) for i in range(4))

    def _forward_all(self, chunks: list[str]) -> list[tuple[np.ndarray, ...]]:
        sizes = np.fromiter(map(len, chunks), np.int64, len(chunks))
        width = int(sizes[0])
        flat = np.frombuffer("".join(chunks).encode("utf-32-le", "surrogatepass"), "<u4")
        codes = np.zeros((width, len(chunks)), np.int64)
        row = np.repeat(np.arange(len(chunks)), sizes)
        codes[np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes), row] = flat
        hashes = np.zeros((width + 1, len(chunks)), np.uint64)
        reach = np.ones((width + 1, len(chunks)))
        powers = [pow(int(PieceTable.BASE), n, 1 << 64) for n in range(self.longest + 1)]
        nodes_of, parts = [0] * (width + 1), []
        for end in range(1, width + 1):
            n = int(np.searchsorted(-sizes, -end, side="right"))
            hashes[end, :n] = hashes[end - 1, :n] * PieceTable.BASE + (codes[end - 1, :n] + 1).astype(np.uint64)
            most = min(end, self.longest)
            found, shares = np.empty((n, most), np.int32), np.empty((n, most))
            for length in range(1, most + 1):
                start = end - length
                found[:, length - 1] = own = self.table.find(hashes[end, :n] - hashes[start, :n] * np.uint64(powers[length]))
                shares[:, length - 1] = self.weight[own] * reach[start, :n]
            bare = np.flatnonzero(found[:, 0] < 0)
            if len(bare):
                found[bare, 0] = -2 - codes[end - 1, bare]
                shares[bare, 0] = self._fallback(codes[end - 1, bare]) * reach[end - 1, bare]
            np.cumsum(shares, axis=1, out=shares)
            total = shares[:, -1].copy()
            reach[end, :n] = total
            nodes_of[end] = self.nodes
            taken = found != -1
            shares /= total[:, None]
            # the last piece into a node closes its share at one
            shares[np.arange(n), most - 1 - np.argmax(taken[:, ::-1], axis=1)] = 1.0
            before = np.where(np.arange(1, most + 1) == end, -1, 0)[None, :] * np.ones((n, 1), np.int64)
            for length in range(1, min(most, end - 1) + 1):
                before[:, length - 1] = nodes_of[end - length] + np.arange(n)
            into = np.count_nonzero(taken, axis=1)
            through = np.cumsum(into)
            parts.append((shares[taken], before[taken].astype(np.int32), found[taken], (self.edges + through - into).astype(np.int32)))
            self.edges += int(through[-1])
            odd = np.flatnonzero((total < 1e-100) | (total > 1e100))
            if len(odd):
                reach[max(0, end - self.longest):end + 1, odd] /= total[odd]
            for r in range(n - 1, -1, -1):
                if sizes[r] != end:
                    break
                self.ends[chunks[r]] = self.nodes + r
            self.nodes += n
        return parts

    def _forward_one(self, chunk: str) -> tuple[np.ndarray, ...]:
        reach, base, get, longest = [1.0], self.nodes, self.pieces.get, self.longest
        share, before, piece, first = array("d"), array("i"), array("i"), array("i")
        for end in range(1, len(chunk) + 1):
            first.append(self.edges + len(piece))
            total, shares = 0.0, []
            back = min(longest, end)
            for length in range(1, back + 1):
                found = get(chunk[end - length:end])
                if found is not None:
                    total += reach[-length] * found[1]
                elif length == 1:
                    total += reach[-1] * float(self._fallback(np.array(ord(chunk[end - 1]))))
                    found = (-2 - ord(chunk[end - 1]), 0.0)
                else:
                    continue
                shares.append(total)
                before.append(base + end - length - 1 if end > length else -1)
                piece.append(found[0])
            share.extend([s / total for s in shares[:-1]])
            share.append(1.0)
            reach = [*reach[-longest:], total]
            if not 1e-100 < total < 1e100:
                reach = [r / total for r in reach]
        self.nodes += len(chunk)
        self.ends[chunk] = self.nodes - 1
        self.edges += len(piece)
        return np.array(share), *(np.array(x, np.int32) for x in (before, piece, first))

    def sample(self, texts: Sequence[str], seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, offsets of the texts in them)."""
        if self.edges > _EDGES_KEPT:
            self._forget()
        split = [_CHUNK.findall(BLANK + x.replace(BLANK, _LITERAL).replace(" ", BLANK)) if x else [] for x in texts]
        new = set().union(*split).difference(self.ends)
        if new:
            self._learn(list(new))
        counts = np.fromiter(map(len, split), np.int64, len(split))
        node = np.fromiter((self.ends[c] for x in split for c in x), np.int64, int(counts.sum()))
        owner = np.repeat(np.arange(len(counts)), counts)
        place = np.arange(len(node)) - np.repeat(np.cumsum(counts) - counts, counts)
        state = seeds.astype(np.uint64)[owner] + place.astype(np.uint64) * _PLACE
        chunk, steps, drawn = np.arange(len(node)), [], []
        length = np.zeros(len(node), np.int64)
        while len(chunk):
            u = _uniform(state[chunk] + np.uint64((len(steps) + 1) * _STEP % (1 << 64)))
            edge = self.first[node].astype(np.int64)
            later = np.flatnonzero(self.share[edge] <= u)
            while len(later):
                edge[later] += 1
                later = later[self.share[edge[later]] <= u[later]]
            steps.append(chunk)
            drawn.append(edge)
            length[chunk] += 1
            node = self.before[edge].astype(np.int64)
            more = node >= 0
            chunk, node = chunk[more], node[more]
        last = np.cumsum(length) - 1
        pieces = np.zeros(int(length.sum()), np.int32)
        for k, (c, e) in enumerate(zip(steps, drawn, strict=True)):
            pieces[last[c] - k] = self.piece[e]
        through = np.concatenate(([0], np.cumsum(length)))[np.concatenate(([0], np.cumsum(counts)))]
        odd = np.flatnonzero(pieces < 0)
        if not len(odd):
            return pieces, through
        sizes = np.ones(len(pieces), np.int64)
        raw = {int(c): [self.byte_id[b] for b in (BLANK if chr(c) == _LITERAL else chr(c)).encode()] for c in np.unique(-2 - pieces[odd])}
        as_bytes = [raw[int(c)] for c in -2 - pieces[odd]]
        sizes[odd] = [len(x) for x in as_bytes]
        ids = np.repeat(pieces, sizes)
        starts = np.concatenate(([0], np.cumsum(sizes)))
        ids[ids < 0] = [b for x in as_bytes for b in x]
        return ids, starts[through]

    def decode(self, ids: Sequence[int]) -> str:
        raw = b"".join(map(self.bytes_of.__getitem__, ids))
        return raw.decode("utf-8", "replace")[1:]


def _groups(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    start, size = 0, 0
    for i, text in enumerate(texts):
        size += len(text or "")
        if size >= _CHARS_AT_ONCE:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def _encode(path: str, sharpness: float, verify: bool):
    """The last two columns are the text and the seed; they are replaced by the pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = PieceSampler.of(path, sharpness)
        for batch in batches:
            texts = batch.column(batch.num_columns - 2).to_pylist()
            seeds = batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False).view(np.uint64)
            for start, end in _groups(texts):
                own = texts[start:end]
                ids, offsets = sampler.sample([x or "" for x in own], seeds[start:end])
                missing = np.array([x is None for x in own])
                listed = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()), mask=pa.array(missing))
                columns = [c.slice(start, end - start) for c in batch.columns[:-2]] + [listed]
                names = [*batch.schema.names[:-2], "ids"]
                if verify:
                    listed_ids = ids.tolist()
                    same = [None if x is None else sampler.decode(listed_ids[a:b]) == x for x, a, b in zip(own, offsets[:-1], offsets[1:], strict=True)]
                    columns.append(pa.array(same, pa.bool_()))
                    names.append("lossless")
                yield pa.RecordBatch.from_arrays(columns, names)

    return run


def encode_pieces(
    docs: DataFrame, model: str, text: str = "text", key: str = "doc_id", carry: Sequence[str] = (), seed: int = 11,
    sharpness: float = 1.0, verify: bool = False,
) -> DataFrame:
    """``key``, ``carry`` and ``ids``, a sampled segmentation; with ``verify``, ``lossless``: whether decoding gives the text."""
    ship_code(docs.sparkSession)
    rows = docs.select(
        *[F.col(f"`{c}`") for c in (key, *carry)], F.col(f"`{text}`").alias("__text"), F.xxhash64(F.lit(seed), F.col(f"`{key}`")).alias("__seed")
    )
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-2]) + ", ids array<int>" + ", lossless boolean" * verify
    return rows.mapInArrow(_encode(model, sharpness, verify), schema)


def decode_pieces(encoded: DataFrame, model: str, ids: str = "ids", out: str = "text") -> DataFrame:
    """Adds the text of the pieces; null for null."""
    ship_code(encoded.sparkSession)

    @F.pandas_udf("string")
    def text(listed):
        sampler = PieceSampler.of(model, 1.0)
        return listed.map(lambda x: None if x is None else sampler.decode(list(x)))

    return encoded.withColumn(out, text(F.col(f"`{ids}`")))


def op2_sentencepiece(spark, folder: str) -> DataFrame:
    """Every document's sampled pieces, decoded again and compared with the text."""
    import public_tokenizers

    docs = table(spark, folder, "documents").select("doc_id", "text")
    encoded = encode_pieces(docs, public_tokenizers.path("piece_bpe_32k.model"), verify=True)
    return encoded.select("doc_id", F.size("ids").cast("long").alias("n_pieces"), "lossless", "ids")
