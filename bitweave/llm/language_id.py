"""Language ID by word-first backoff.

A known word scores by its log frequency in each language; an unseen word falls
back to its character 5-grams, and, while none of those is known, to 4-, 3-, 2-
and 1-grams.  Each word's scores are normalised over the languages, so that a
rare word weighs no more than a common one, and a document's are added up over
its whole text.  A word is a run of letters and combining marks, in lower case.

The model is fitted on a sample of labelled rows, chosen by a hash of id and text
and bounded by ``sample_docs`` rows and ``sample_bytes`` of text on average; all
words and n-grams of the sample are kept.  That bounds the model, at less than
``2.5 * sample_bytes`` words and n-grams of ``8 + 4 * languages`` bytes each if no
word occurred twice, and some tenth of that in practice, and makes its size
independent of the corpus, which is why tasks may receive it whole.

Words are split, folded and numbered by Arrow, hashed and looked up in numpy: no
Python object per word.  Words and n-grams are told apart by 64-bit hashes; among
the ten million of the largest model the odds that any two are confused are one
in 400,000.

Defined results: ``und`` with score 0 for null texts, texts without a letter,
and when nothing was learned; ties go to the language whose name sorts first;
rows with equal ids are judged one by one; only id and text (and, to learn from,
the label) are read, and other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._blocks import bounded_batches, stored
from ._text import column_bytes, give_back, make_room, mix, slices

SAMPLE_DOCS = 20_000
SAMPLE_BYTES = 32 << 20
LENGTHS = (5, 4, 3, 2, 1)
_BREAK = r"[^\p{L}\p{M}]+"
_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)
_LONG = 64  # characters; longer words are hashed one by one
_EDGE = 0x20  # stands before and after a word's characters


def split(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(distinct words, number of each word of the texts in order, text that it is in)."""
    lists = pc.split_pattern_regex(pc.utf8_lower(pc.fill_null(texts, "").cast(pa.large_string())), pattern=_BREAK)
    flat = pc.dictionary_encode(lists.flatten())
    words, code = flat.dictionary, np.asarray(flat.indices).astype(np.int64)
    letters = np.asarray(pc.match_substring_regex(words, r"\p{L}")) if len(words) else np.zeros(0, bool)
    row = np.repeat(np.arange(len(lists)), np.diff(np.asarray(lists.offsets)))
    keep = letters[code]
    place = np.cumsum(letters) - 1
    return words.filter(pa.array(letters)), place[code[keep]], row[keep]


class Characters:
    """The characters of words, each word between two edges, and the hashes of its n-grams."""

    def __init__(self, words: pa.Array):
        raw, offsets, _ = column_bytes(words)
        head = (raw & 0xC0) != 0x80  # a character's first byte
        before = np.concatenate([[0], np.cumsum(head)])
        points = np.frombuffer(raw.tobytes().decode().encode("utf-32-le"), "<u4")
        self.count = before[offsets[1:]] - before[offsets[:-1]]
        n = len(self.count)
        self.first = np.concatenate([[0], np.cumsum(self.count + 2)])  # of each word's leading edge
        self.points = np.full(self.first[-1], _EDGE, _U)
        self.word = np.repeat(np.arange(n), self.count + 2)
        edge = np.zeros(len(self.points), bool)
        edge[self.first[:-1]] = edge[self.first[1:] - 1] = True
        self.points[~edge] = points
        self.edge = edge

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(hash, word) of every n-gram; n is 0 for whole words, and edges count as characters if n is 2 or more."""
        if n == 0:
            return self._whole(), np.arange(len(self.count))
        many = len(self.points) - n + 1
        if many <= 0:
            return np.zeros(0, _U), np.zeros(0, np.int64)
        h = np.zeros(many, _U)
        for k in range(n):
            h = h * _BASE + self.points[k : k + many] + _U(1)
        inside = self.word[:many] == self.word[n - 1 :]
        if n == 1:
            inside &= ~self.edge
        return mix(h[inside] + _U(n)), self.word[:many][inside]

    def _whole(self) -> np.ndarray:
        h, at = np.zeros(len(self.count), _U), self.first[:-1] + 1
        left = np.flatnonzero(self.count <= _LONG)
        for k in range(_LONG):
            left = left[self.count[left] > k]
            h[left] = h[left] * _BASE + self.points[at[left] + k] + _U(1)
        for i in np.flatnonzero(self.count > _LONG):
            h[i] = int.from_bytes(blake2b(self.points[at[i] : at[i] + self.count[i]].tobytes(), digest_size=8).digest(), "little")
        return mix(mix(h) + self.count.astype(_U))


def _texts(column) -> Iterator[tuple[int, int, pa.Array]]:
    """A column about a MB at a time."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    raw, offsets, _ = column_bytes(column)
    for a, b in slices(raw, offsets, 1 << 20):
        yield a, b, column.slice(a, b - a)


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    make_room()
    for batch in batches:
        langs = batch.column("lang").dictionary_encode()
        of_row = np.asarray(langs.indices)
        for a, b, part in _texts(batch.column("text")):
            words, code, row = split(part)
            if not len(words):
                continue
            key, many = np.unique(of_row[a:b][row] * np.int64(len(words)) + code, return_counts=True)
            yield pa.record_batch([langs.dictionary.take(pa.array(key // len(words))), words.take(pa.array(key % len(words))).cast(pa.string()), pa.array(many, pa.int64())], names=["lang", "word", "count"])


def _count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From counted words: the counts of their n-grams, and of the words themselves as length 0."""
    for batch in batches:
        langs = batch.column("lang").dictionary_encode()
        of_row, count = np.asarray(langs.indices), np.asarray(batch.column("count"))
        chars = Characters(batch.column("word"))
        for n in (0, *LENGTHS):
            h, word = chars.grams(n)
            order = np.lexsort((h, of_row[word]))
            h, lang, many = h[order], of_row[word][order], count[word][order]
            fresh = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (lang[1:] != lang[:-1])])) if len(h) else np.zeros(0, np.int64)
            sums = np.add.reduceat(many, fresh) if len(h) else many
            yield pa.record_batch([pa.array(np.full(len(fresh), n), pa.int32()), pa.array(h[fresh].view(np.int64)), langs.dictionary.take(pa.array(lang[fresh])), pa.array(sums, pa.int64())], names=["n", "gram", "lang", "count"])


class Model:
    """Normalised log scores by word (length 0) and by n-gram: for each length, sorted hashes and a row of scores for each."""

    def __init__(self, langs: list[str], tables: dict[int, tuple[np.ndarray, np.ndarray]]):
        self.langs = langs
        self.tables = tables

    def _find(self, n: int, h: np.ndarray) -> np.ndarray:
        """The row of each hash, or -1."""
        keys = self.tables[n][0]
        if not len(keys):
            return np.full(len(h), -1, np.int64)
        at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
        return np.where(keys[at] == h, at, -1)

    def score(self, words: pa.Array) -> np.ndarray:
        """Log posteriors of each word: its own, or those of its longest known n-grams together."""
        out = np.full((len(words), len(self.langs)), -np.log(max(1, len(self.langs))))
        left = np.arange(len(words))
        for n in (0, *LENGTHS):
            if not len(left):
                break
            h, word = Characters(words.take(pa.array(left))).grams(n)
            at = self._find(n, h)
            known, at = word[at >= 0], at[at >= 0]
            sums = np.stack([np.bincount(known, weights=x, minlength=len(left)) for x in self.tables[n][1][at].T], axis=1)
            done = np.bincount(known, minlength=len(left)) > 0
            out[left[done]] = sums[done] if n == 0 else _normal(sums[done])
            left = left[~done]
        return out

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        if not self.langs:
            return ["und"] * len(texts), np.zeros(len(texts))
        words, code, row = split(texts)
        scores = self.score(words)
        total = np.stack([np.bincount(row, weights=x[code], minlength=len(texts)) for x in scores.T], axis=1)
        best = total.argmax(axis=1)
        found = np.bincount(row, minlength=len(texts)) > 0
        share = 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
        return [self.langs[k] if f else "und" for k, f in zip(best.tolist(), found.tolist(), strict=True)], np.where(found, share, 0.0)


def _normal(scores: np.ndarray) -> np.ndarray:
    """Log posteriors along the last axis, no lower than -8: one word decides nothing alone."""
    top = scores - scores.max(axis=-1, keepdims=True)
    return np.maximum(top - np.log(np.exp(top).sum(axis=-1, keepdims=True)), -8.0)


def train(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_docs: int = SAMPLE_DOCS, sample_bytes: int = SAMPLE_BYTES) -> Model:
    rows = labelled.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("lang is not null and text is not null")
    n, size = rows.agg(F.count(F.lit(1)), F.sum(F.octet_length("text").cast("bigint"))).first()
    share = min(1.0, sample_docs / max(1, n), sample_bytes / max(1, size or 0))
    if share < 1:  # a hash of 63 bits: the share is never rounded to nothing
        rows = rows.where(F.shiftrightunsigned(F.xxhash64("id", "text", F.lit("sample")), 1) < F.lit(int(share * 2**63)))
    words = rows.select("text", "lang").mapInArrow(_count_words, "lang string, word string, count long").groupBy("lang", "word").agg(F.sum("count").alias("count"))
    counts = stored(stored(words).mapInArrow(_count_grams, "n int, gram long, lang string, count long").groupBy("n", "gram", "lang").agg(F.sum("count").alias("count")))
    langs = sorted(r["lang"] for r in counts.select("lang").distinct().collect())
    each = [F.sum(F.when(F.col("lang") == x, F.col("count")).otherwise(0)).alias(f"c{i}") for i, x in enumerate(langs)]
    tables = {}
    for k in (0, *LENGTHS):  # the driver gets one length at a time
        own = counts.where(F.col("n") == k).groupBy("gram").agg(*each).toArrow() if langs else None
        keys = np.asarray(own.column("gram")).view(_U) if langs else np.zeros(0, _U)
        order = np.argsort(keys)
        seen = np.stack([np.asarray(own.column(f"c{i}"))[order] for i in range(len(langs))], axis=1).astype(float) if langs else np.zeros((0, 0))
        tables[k] = keys[order], _normal(np.log((seen + 0.05) / (seen.sum(axis=0) + 0.05 * len(seen)))).astype(np.float32) if len(keys) else seen
    return Model(langs, tables)


def _predict(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make_room()
        model = shared.value
        for batch in batches:
            for a, b, texts in _texts(batch.column("_text")):
                lang, score = model.predict(texts)
                part = batch.slice(a, b - a)
                names = [x for x in part.schema.names if x != "_text"]
                yield pa.record_batch([*(part.column(x) for x in names), pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=[*names, "_lang", "_score"])
        give_back()

    return run


def identify_language(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text", names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """Returns the columns ``keep``, then the prediction and its score under ``names``, which replace columns of the same name."""
    shared = bounded_batches(docs.sparkSession).sparkContext.broadcast(model)
    keep = [c for c in keep if c not in names]
    rows = docs.select(*(F.col(f"`{c}`").alias(f"_k{i}") for i, c in enumerate(keep)), F.col(text_col).alias("_text"))
    fields = "".join(f"_k{i} {docs.schema[c].dataType.simpleString()}, " for i, c in enumerate(keep))
    found = rows.mapInArrow(_predict(shared), f"{fields}_lang string, _score double")
    return found.select(*(F.col(f"_k{i}").alias(c) for i, c in enumerate(keep)), F.col("_lang").alias(names[0]), F.col("_score").alias(names[1]))


def held_out(id_col: str = "doc_id") -> Column:
    """Rows that nothing may be learned from; a null id has no hash and is learned from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs.where(~held_out()))
    out = identify_language(docs, model)
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
