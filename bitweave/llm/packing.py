"""Packing: shortest-pack-first over the length histogram.

Documents are tokenised, followed by an end id, and cut into pieces of at most
``capacity`` ids.  The histogram of piece lengths (at most ``capacity`` rows,
whatever the corpus holds) is all that the driver sees.  Lengths are placed
longest first, each into the packs with the most room left; packs with equal
contents are one pattern with a count, so the work doesn't depend on the number
of documents.  Every piece has a rank among those of its length, and a pattern
owns an interval of ranks: that joins patterns back to documents.

Bounds: at most two patterns are added for a length, and a pattern holds at most
sqrt(2 * capacity) distinct lengths, so the plan that tasks receive has at most
740,000 intervals (24 MB) for a capacity of 4096, and a few thousand in practice.

Defined results: a null text is an empty one and holds the end id only; rows
with equal ids are packed like any others; an empty table packs nothing; columns
other than id and text are ignored.
"""

from __future__ import annotations

import heapq
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._blocks import bounded_batches, stored
from ._text import _LOWER, Words, column_bytes, kept, make_room, slices

CAPACITY = 4096
END_ID = 2
TOKENIZER = "word_bpe_49k.json"
PIECES = "id long, start long, length int, doc_tokens long, ids binary, ids_crc32 long"

# -- tokenising ---------------------------------------------------------------

_KIND = np.full(256, 3, np.uint8)  # 0 space, 1 ASCII letter, 2 digit, 3 other ASCII, 4 apostrophe, 5 beyond ASCII
_KIND[[0x20, 0x0A]] = 0
_KIND[[*range(65, 91), *range(97, 123)]] = 1
_KIND[48:58] = 2
_KIND[39] = 4
_KIND[128:] = 5
_CUT = np.zeros((6, 6), bool)  # kinds between which a pre-token always ends
for _x in (1, 2, 3):
    for _y in (1, 2, 3):
        _CUT[_x, _y] = _x != _y
_CUT[0, :] = _CUT[:, 0] = True

_SLOTS = 1 << 21
_MOST_CACHED = 900_000
_MOST_AT_ONCE = 500_000
_encoders: dict[str, _Encoder] = {}
kept["packing"] = _encoders


class _Segments(Words):
    """Parts of texts whose ids don't depend on what stands around them, ASCII in lower case (which the tokenizer applies)."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray):  # noqa: super().__init__ cuts at white space
        kind = _KIND[raw]
        edge = np.ones(len(raw) + 1, bool)
        edge[1:-1] = _CUT[kind[:-1], kind[1:]]
        if b"<|" in raw.tobytes():  # special tokens mix letters with signs
            edge[1:-1] = (kind[:-1] == 0) | (kind[1:] == 0)
        edge[offsets] = True
        self.raw, self.offsets = _LOWER[raw], offsets
        self.start = np.flatnonzero(edge[:-1] & (kind > 0))
        self.end = np.flatnonzero(edge[1:] & (kind > 0)) + 1
        self.row = np.searchsorted(offsets, self.start, side="right") - 1
        self.hash = self._hashes()


class _Encoder:
    """A tokenizer, and a hash table (open addressing, in numpy) from segments met before to their ids.

    Segments are told apart by a 64-bit hash; with a million of them in a table
    the odds that any two are confused are about 1 in 10 million.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self._empty()

    def _empty(self) -> None:
        self.keys, self.refs = np.zeros(_SLOTS, np.uint64), np.zeros(_SLOTS, np.int32)
        self.starts, self.lengths, self.known = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64), 0
        self.pool, self.used = np.zeros(1 << 18, np.uint32), 0

    def _find(self, h: np.ndarray) -> np.ndarray:
        """Where each hash is known, or -1."""
        out = np.full(len(h), -1, np.int64)
        left, slot = np.arange(len(h)), (h & np.uint64(_SLOTS - 1)).astype(np.int64)
        while len(left):
            there = self.keys[slot]
            hit = there == h[left]
            out[left[hit]] = self.refs[slot[hit]]
            on = ~hit & (there != 0)
            left, slot = left[on], (slot[on] + 1) & (_SLOTS - 1)
        return out

    def _add(self, h: np.ndarray, ids: list[list[int]]) -> None:
        n, lengths = len(h), np.array([len(x) for x in ids], np.int64)
        flat = np.fromiter((i for x in ids for i in x), np.uint32, int(lengths.sum()))
        while len(self.starts) < self.known + n:
            self.starts, self.lengths = np.concatenate([self.starts, self.starts * 0]), np.concatenate([self.lengths, self.lengths * 0])
        while len(self.pool) < self.used + len(flat):
            self.pool = np.concatenate([self.pool, self.pool * 0])
        self.pool[self.used : self.used + len(flat)] = flat
        self.starts[self.known : self.known + n] = self.used + np.cumsum(lengths) - lengths
        self.lengths[self.known : self.known + n] = lengths
        refs, left, slot = np.arange(self.known, self.known + n), np.arange(n), (h & np.uint64(_SLOTS - 1)).astype(np.int64)
        while len(left):
            free = self.keys[slot] == 0
            self.keys[slot[free]] = h[left[free]]
            mine = free & (self.keys[slot] == h[left])  # of two that want one slot, the later got it
            self.refs[slot[mine]] = refs[left[mine]]
            left, slot = left[~mine], (slot[~mine] + 1) & (_SLOTS - 1)
        self.known += n
        self.used += len(flat)

    def encode(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, how many each text has). Segments are looked up ``_MOST_AT_ONCE`` at a time, so that a text of any length fits the table."""
        part = _Segments(raw, offsets)
        part.hash[part.hash == 0] = 1
        data = part.raw.tobytes()
        ids, lengths = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        for at in range(0, len(part.hash), _MOST_AT_ONCE):
            own, many = self._encode(part, data, at, at + _MOST_AT_ONCE)
            ids.append(own)
            lengths.append(many)
        return np.concatenate(ids), np.bincount(part.row, weights=np.concatenate(lengths), minlength=len(offsets) - 1).astype(np.int64)

    def _encode(self, part: _Segments, data: bytes, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids of the segments [low, high), how many each has)."""
        h = part.hash[low:high]
        refs = self._find(h)
        if (refs < 0).any():
            new, first = np.unique(h[refs < 0], return_index=True)
            if self.known + len(new) > _MOST_CACHED:
                self._empty()
                new, first = np.unique(h, return_index=True)
                at = low + first
            else:
                at = low + np.flatnonzero(refs < 0)[first]
            texts = [data[a:b].decode() for a, b in zip(part.start[at].tolist(), part.end[at].tolist(), strict=True)]
            self._add(new, [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)])
            refs = self._find(h)
        lengths = self.lengths[refs]
        total = np.cumsum(lengths)
        return self.pool[np.repeat(self.starts[refs] - (total - lengths), lengths) + np.arange(total[-1] if len(total) else 0)], lengths


def _encoder(path: str) -> _Encoder:
    if path not in _encoders:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _encoders[path] = _Encoder(path)
    return _encoders[path]


def _tokenise(path: str, capacity: int, end_id: int):
    end = int(end_id).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make_room("packing")
        encoder = _encoder(path)
        for batch in batches:
            raw, offsets, _ = column_bytes(batch.column(1))
            for a, b in slices(raw, offsets, 1 << 20):
                found, counts = encoder.encode(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                data, at = found.astype("<u4").tobytes(), 0
                out: list[list] = [[] for _ in range(6)]
                for key, n in zip(batch.column(0).slice(a, b - a).to_pylist(), counts.tolist(), strict=True):
                    ids = data[at : at + 4 * n] + end
                    at += 4 * n
                    for start in range(0, len(ids), 4 * capacity):
                        piece = ids[start : start + 4 * capacity]
                        for column, value in zip(out, (key, start // 4, len(piece) // 4, len(ids) // 4, piece, zlib.crc32(piece)), strict=True):
                            column.append(value)
                yield pa.record_batch([pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.int64()), strict=True)], names=["id", "start", "length", "doc_tokens", "ids", "ids_crc32"])

    return run


# -- planning -----------------------------------------------------------------


def shortest_pack_first(histogram: dict[int, int], capacity: int) -> list[tuple[int, Counter]]:
    """[(how many packs, lengths in each)] covering the histogram exactly."""
    open_packs: list[tuple[int, int, int, Counter]] = []  # most room first
    full: list[tuple[int, Counter]] = []
    serial = 0
    for length in sorted(histogram, reverse=True):
        n = histogram[length]
        while n:
            if open_packs and -open_packs[0][0] >= length:
                room, _, count, pack = heapq.heappop(open_packs)
                room, used = -room, min(n, count)
                if used < count:
                    serial += 1
                    heapq.heappush(open_packs, (-room, serial, count - used, pack))
                pack = pack + Counter([length])
            else:
                room, used, pack = capacity, n, Counter([length])
            n -= used
            if room == length:
                full.append((used, pack))
            else:
                serial += 1
                heapq.heappush(open_packs, (length - room, serial, used, pack))
    return full + [(count, pack) for _, _, count, pack in sorted(open_packs)]


class Plan:
    """Patterns as intervals over (length, rank), for one binary search a piece."""

    def __init__(self, patterns: list[tuple[int, Counter]]):
        rows, sequence, used = [], 0, Counter()
        for count, pack in patterns:
            offset = 0
            for length in sorted(pack, reverse=True):
                each = pack[length]
                rows.append((length, used[length], sequence, each, offset))
                used[length] += count * each
                offset += length * each
            sequence += count
        rows.sort()
        self.sequences = sequence
        table = np.array(rows, dtype=np.int64).reshape(-1, 5)
        self.lengths, self.ranks, self.first, self.each, self.offsets = table.T
        self.bounds = {int(k): (int(a), int(b)) for k, a, b in zip(*self._runs(), strict=True)}

    def _runs(self):
        keys, first, count = np.unique(self.lengths, return_index=True, return_counts=True)
        return keys, first, first + count

    def place(self, lengths: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sequence, offset) of each piece."""
        sequence, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
        for length in np.unique(lengths):
            own = np.flatnonzero(lengths == length)
            a, b = self.bounds[int(length)]
            i = a + np.searchsorted(self.ranks[a:b], ranks[own], side="right") - 1
            step = ranks[own] - self.ranks[i]
            sequence[own] = self.first[i] + step // self.each[i]
            offset[own] = self.offsets[i] + step % self.each[i] * length
        return sequence, offset


def _place(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = shared.value
        for batch in batches:
            sequence, offset = plan.place(np.asarray(batch.column("length")).astype(np.int64), np.asarray(batch.column("rank")))
            yield pa.record_batch([batch.column("piece"), pa.array(sequence), pa.array(offset)], names=["piece", "sequence_id", "offset"])

    return run


# -- the operator -------------------------------------------------------------


def pack_documents(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """One row per piece: id, start, length, doc_tokens, ids (little-endian 32-bit), ids_crc32, sequence_id, offset."""
    spark = bounded_batches(docs.sparkSession)
    pieces = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text")).mapInArrow(_tokenise(tokenizer_path, capacity, end_id), PIECES)
    pieces = stored(pieces.withColumn("piece", F.monotonically_increasing_id()))
    sizes = pieces.select("piece", "length").withColumn("chunk", F.pmod(F.xxhash64("piece"), F.lit(_chunks(pieces))).cast("int"))
    counts = sizes.groupBy("length", "chunk").agg(F.count(F.lit(1)).alias("n"))
    counts = stored(counts.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan = Plan(shortest_pack_first(histogram, capacity))
    local = sizes.withColumn("k", F.row_number().over(Window.partitionBy("length", "chunk").orderBy("piece")))
    ranked = local.join(counts.hint("merge"), ["length", "chunk"]).select("piece", "length", (F.col("before") + F.col("k") - 1).alias("rank"))
    placed = ranked.mapInArrow(_place(spark.sparkContext.broadcast(plan)), "piece long, sequence_id long, offset long")
    return pieces.join(placed, "piece").drop("piece").withColumnRenamed("id", id_col).withColumn("length", F.col("length").cast("bigint"))


def _chunks(pieces: DataFrame) -> int:
    """So many that a chunk of a length that a third of all pieces share has a few hundred thousand rows."""
    return max(64, pieces.count() // 500_000)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    out = pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path(TOKENIZER))
    return out.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
