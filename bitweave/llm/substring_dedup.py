"""Substring dedup: words covered by a window that an earlier document already has are removed.

A window is ``size`` consecutive words of one document.  Rabin-Karp hashes of
every window are counted in Spark; a window is repeated when its word sequence
also starts in a document with a smaller id.  Overlapping repeated windows merge
into maximal removal intervals.

How it runs: documents are shuffled once into id-ordered blocks of about 6 MB.
Each block sends its distinct window hashes, delta-coded, to hash buckets; a
bucket answers with a bit for every hash that a lower block holds too.  Repeats
inside a block are found in the block.  Since blocks are ordered by id, nothing
but hashes travels, and no window, however frequent, meets more than one entry
per block in its bucket.

Defined results: null or empty text has no words and keeps ''; a null id is
neither smaller nor larger than another, so such rows keep all their words and
remove nothing elsewhere; rows that share an id don't remove each other's words;
an empty table gives an empty result; columns named in ``carry`` pass unchanged,
others are dropped, and none of them can clash with the result's own names.
Hashes are 64 bits wide: over w distinct windows about w*w/2**65 pairs differ
and still compare equal (0.0005 of one pair at 0.5 GB).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._blocks import block_count, bounded_batches, bucket_bits, by_bucket, decode, encode, id_blocks, text_bytes
from ._text import trimmed, words_of

WINDOW = 13


def _block_windows(ids: pa.ChunkedArray, texts, size: int):
    """(rows of the block in id order, its words a slice at a time, windows: hash, row, first word)."""
    known = np.asarray(ids.is_valid())
    for a, b, words in words_of(texts):
        first, h = words.windows(size)
        row = words.row[first]
        keep = known[a + row]
        yield a, b, words, first[keep], h[keep], row[keep]


def _send(size: int, bits: int):
    @trimmed
    def run(table: pa.Table) -> pa.Table:
        block = table.column("_block")[0].as_py()
        found = [np.unique(h) for *_, h, _ in _block_windows(table.column("_id"), table.column("_text"), size)]
        values = np.unique(np.concatenate(found)) if found else np.zeros(0, np.uint64)
        del found
        parts = by_bucket(values, bits)
        return pa.table({"_bucket": pa.array([k for k, _ in parts], pa.int32()), "_block": pa.array([block] * len(parts), pa.int32()), "_data": pa.array([encode(v) for _, v in parts], pa.binary())})

    return run


@trimmed
def _answer(table: pa.Table) -> pa.Table:
    """In one bucket: a bit for each hash of each block, set if a lower block has it."""
    table = table.sort_by("_block")
    parts = [decode(x.as_py()) for x in table.column("_data")]
    sizes = np.array([len(p) for p in parts], dtype=np.int64)
    every = np.concatenate(parts)
    del parts
    order = np.argsort(every, kind="stable")
    ranked = every[order]
    again = np.zeros(len(every), dtype=bool)
    again[order[1:]] = ranked[1:] == ranked[:-1]
    bits = [np.packbits(x).tobytes() for x in np.split(again, np.cumsum(sizes)[:-1])]
    return pa.table({"_bucket": table.column("_bucket").cast(pa.int32()), "_block": table.column("_block").cast(pa.int32()), "_data": pa.array(bits, pa.binary())})


def _cover(first: np.ndarray, size: int, n_words: int) -> np.ndarray:
    """Which of a slice's words repeated windows cover."""
    depth = np.zeros(n_words + 1, dtype=np.int32)
    np.add.at(depth, first, 1)
    np.add.at(depth, first + size, -1)
    return np.cumsum(depth[:-1]) > 0


def _spans(gone: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]])))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))


def _hits(ids: pa.ChunkedArray, texts, answers: pa.Table, size: int, bits: int) -> np.ndarray:
    """Of all windows of a block, in id order: whether a document with a smaller id has it too."""
    hashes, rows = [np.zeros(0, np.uint64)], [np.zeros(0, np.int32)]
    for a, _, _, _, h, row in _block_windows(ids, texts, size):
        hashes.append(h)
        rows.append((a + row).astype(np.int32))
    every, rows = np.concatenate(hashes), np.concatenate(rows)
    del hashes
    hit = np.zeros(len(every), bool)
    if not len(every):
        return hit
    order = np.argsort(every, kind="stable").astype(np.int32)
    every, rows = every[order], rows[order]
    fresh = np.ones(len(every), bool)
    fresh[1:] = every[1:] != every[:-1]
    values, start = every[fresh], np.flatnonzero(fresh)
    del every
    held = dict(zip(answers.column("_bucket").to_pylist(), answers.column("_data").to_pylist(), strict=True)) if answers.num_rows else {}
    repeated, at = np.zeros(len(values), bool), 0
    for k, part in by_bucket(values, bits):
        repeated[at : at + len(part)] = np.unpackbits(np.frombuffer(held[k], np.uint8), count=len(part)).astype(bool)
        at += len(part)
    numbers = np.asarray(ids.fill_null(0))
    many = np.diff(np.append(start, len(rows)))
    hit[order] = np.repeat(repeated, many) | (numbers[rows] > np.repeat(numbers[rows[start]], many))
    return hit


def _cut(size: int, bits: int, id_col: str, carry: list[str], schema: pa.Schema, tidy: bool):
    @trimmed
    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        docs = docs.take(pa.compute.sort_indices(docs.column("_id"))) if docs.num_rows else docs
        ids = docs.column("_id")
        hit = _hits(ids, docs.column("_text"), answers, size, bits)
        out, at = [], 0
        # the words are read a second time, a slice at a time, rather than held for the whole block
        for a, b, words, first, h, _ in _block_windows(ids, docs.column("_text"), size):
            gone = _cover(first[hit[at : at + len(h)]], size, len(words.start))
            at += len(h)
            part = docs.slice(a, b - a)
            n_removed, kept, spans = [], [], []
            for i, text in enumerate(part.column("_text").to_pylist()):
                own = gone[words.first[i] : words.first[i + 1]]
                cut = own.any()
                found = (text or "").encode().split() if tidy or cut else ()
                if cut:
                    found = [w for w, g in zip(found, own.tolist(), strict=True) if not g]
                spans.append([{"start": x, "end": y} for x, y in _spans(own)] if cut else [])
                n_removed.append(int(own.sum()))
                kept.append(b" ".join(found).decode() if tidy or cut else text or "")
            columns = [part.column("_id").combine_chunks().cast(schema.field(id_col).type), pa.array(words.count, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string()), pa.array(spans, schema.field("removed").type)]
            columns += [part.column(f"_c{i}").combine_chunks().cast(schema.field(c).type) for i, c in enumerate(carry)]
            out.append(pa.record_batch(columns, schema=schema))
        return pa.Table.from_batches(out, schema=schema)

    return run


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = WINDOW, carry: tuple[str, ...] = (), tidy: bool = True) -> DataFrame:
    """Returns id, n_words, n_removed, kept (words joined by one space; texts that lose nothing stay as they are if not ``tidy``), removed (spans [start, end) of words), and ``carry``."""
    from pyspark.sql.pandas.types import to_arrow_schema

    bounded_batches(docs.sparkSession)
    blocks = block_count(text_bytes(docs, text_col))
    bits = bucket_bits(blocks)
    carry = [c for c in carry if c not in (id_col, "n_words", "n_removed", "kept", "removed")]
    source = docs.select(id_blocks(docs, id_col, blocks, F.col(text_col)).alias("_block"), F.col(id_col).cast("bigint").alias("_id"), F.col(text_col).alias("_text"), *(F.col(c).alias(f"_c{i}") for i, c in enumerate(carry)))
    sent = source.groupBy("_block").applyInArrow(_send(size, bits), "_bucket int, _block int, _data binary")
    answers = sent.groupBy("_bucket").applyInArrow(_answer, "_bucket int, _block int, _data binary")
    span = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
    schema = T.StructType([T.StructField(id_col, T.LongType()), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept", T.StringType()), T.StructField("removed", span), *(T.StructField(c, docs.schema[c].dataType) for c in carry)])
    return source.groupBy("_block").cogroup(answers.groupBy("_block")).applyInArrow(_cut(size, bits, id_col, carry, to_arrow_schema(schema), tidy), schema)


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
