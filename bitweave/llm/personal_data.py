"""Personal data: base patterns, and information-theoretic sanitisation of what stands around them.

Four patterns find e-mail addresses, IP addresses, card and phone numbers; each
value found is a protected entity.  A word that stands near an entity (at most
``NEAR`` words away, in the same line) may reveal it after the entity itself is
gone.  How much it reveals is estimated from the whole corpus, with a random word
of it as the event: the information of an entity is -log2 p(near it), and a
term's pointwise mutual information with it is log2 p(term, near) / (p(term)
p(near)).  What is left after the term is known, information minus PMI, is
-log2 of the share of the term's occurrences that stand near the entity.  A term
that leaves ``SLACK`` bits or less discloses the entity, provided that it was seen
near it between at least two different words on either side, so that copies of
one passage are one piece of evidence.

In a document that holds the entity, a disclosing term is generalised to its form
(name, number, word), or removed if its form alone discloses the entity as well.
Documents without base matches stay as they are.

Work on texts is two or three passes: patterns and neighbourhoods; counts of the
terms that are in question, of which a filter of a fixed most size says which
words may be one (exactly joined afterwards); places of the disclosing terms.
Every group by entity, term or text is counted before it is shuffled.

Defined results: a null text is empty; each row counts for itself, repeated ids or
not; equal texts have equal spans; terms are told apart by 64-bit hashes of
their lower-case letters (A-Z) and digits; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._blocks import bounded_batches, heavy_keys, spread_join, stored
from ._text import Words, column_bytes, slices

KINDS = ("email", "ip", "card", "phone")
FORMS = ("name", "number", "word")
NEAR = 12
SLACK = 1
LEAST_BITS, MOST_BITS = 20, 26
FLUSH = 1 << 20

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9]){12,}")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]")
_TERM = np.full(256, 0x20, np.uint8)
_TERM[128:] = np.arange(128, 256)
for _low, _high in ((48, 58), (97, 123)):
    _TERM[_low:_high] = np.arange(_low, _high)
_TERM[65:91] = np.arange(97, 123)


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """No local part holds an @, so each match belongs to the @ before a domain, and reaches back as far as it can."""
    last = 0
    for m in _DOMAIN.finditer(text):
        begin = m.start()
        while begin > last and text[begin - 1] in _LOCAL:
            begin -= 1
        if begin < m.start():
            last = m.end()
            yield begin, last


def _addresses(text: str) -> Iterator[tuple[int, int]]:
    """Four numbers at a time of each dotted run of numbers."""
    for m in _DOTTED.finditer(text):
        parts, at = m[0].split("."), m.start()
        for k in range(0, len(parts) - 3, 4):
            four = parts[k : k + 4]
            end = at + sum(map(len, four)) + 3
            if all(len(x := p.lstrip("0")) < 4 and int(x or 0) <= 255 for p in four):
                yield at, end
            at = end + 1


def luhn(digits: str) -> bool:
    values = [int(d) for d in reversed(digits)]
    return (sum(values[::2]) + sum(d * 2 - 9 * (d > 4) for d in values[1::2])) % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) in code points, by kind and start; in time linear in the text."""
    found = [(0, a, b) for a, b in _emails(text)] if "@" in text else []
    if _DIGITS.search(text):
        found += [(1, a, b) for a, b in _addresses(text)]
        for m in _CARD.finditer(text):
            digits = "".join(_DIGITS.findall(m[0])) if len(m[0]) < 38 else ""  # 19 digits and 18 separators at most
            if 13 <= len(digits) <= 19 and luhn(digits):
                found.append((2, m.start(), m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= len(_DIGITS.findall(m[0])) <= 15:
                    found.append((3, m.start(), m.end()))
    return found


def entity(kind: int, value: str) -> str:
    """The protected value, the same for all its spellings."""
    return f"{KINDS[kind]}:{value.lower() if kind < 2 else ''.join(_DIGITS.findall(value))}"


class Terms(Words):
    """The terms of several texts: runs of letters and digits, with ``form``, and with place and line counted in code points of their text."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray):
        super().__init__(_TERM[raw], offsets)
        self.term = self.hash.view(np.int64)
        self.own = raw

    @property
    def form(self) -> np.ndarray:
        """0 for a capital first letter, 1 for digits alone, 2 otherwise."""
        digits = np.concatenate([[0], np.cumsum((self.own >= 48) & (self.own < 58))])
        first, second = self.own[self.start], self.own[np.minimum(self.start + 1, len(self.own) - 1)] if len(self.start) else self.start
        capital = ((first >= 65) & (first < 91)) | ((first == 0xC3) & (second >= 0x80) & (second <= 0x9E) & (second != 0x97))
        return np.where(capital, 0, np.where(digits[self.end] - digits[self.start] == self.end - self.start, 1, 2))

    def places(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        points = np.concatenate([[0], np.cumsum((self.own & 0xC0) != 0x80)])
        base = points[self.offsets[:-1]][self.row]
        lines = np.concatenate([[0], np.cumsum(self.own == 10)])
        return points[self.start] - base, points[self.end] - base, lines[self.start]


def _free(start: np.ndarray, end: np.ndarray, spans: list[tuple[int, int, int]]) -> np.ndarray:
    """Which terms of one text lie outside all spans."""
    free = np.ones(len(start), bool)
    for _, a, b in spans:
        free[np.searchsorted(end, a, side="right") : np.searchsorted(start, b)] = False
    return free


def _near(text: str, spans: list[tuple[int, int, int]]) -> list[dict]:
    """For each entity of a text, the terms near it: (term, term before, term after, form)."""
    raw = np.frombuffer(text.encode(), np.uint8)
    terms = Terms(raw, np.array([0, len(raw)]))
    start, end, line = terms.places()
    free, form = _free(start, end, spans), terms.form
    around = np.concatenate([[0], terms.term, [0]])
    newlines = np.array([m.start() for m in re.finditer("\n", text)])
    at: dict[str, list[np.ndarray]] = {}
    for kind, a, b in spans:
        first, last = int(np.searchsorted(end, a, side="right")), int(np.searchsorted(start, b))
        near = np.r_[max(0, first - NEAR) : first, last : min(len(start), last + NEAR)]
        at.setdefault(entity(kind, text[a:b]), []).append(near[free[near] & (line[near] == np.searchsorted(newlines, a))])
    out = []
    for name, parts in at.items():
        k = np.unique(np.concatenate(parts))
        columns = (around[k + 1], around[k], around[k + 2], form[k])
        out.append({"entity": name, "terms": [dict(zip(("term", "before", "after", "form"), map(int, x), strict=True)) for x in zip(*columns, strict=True)]})
    return out


_SPAN = "struct<kind: int, start: bigint, end: bigint>"
_SCANNED = f"_id bigint, spans array<{_SPAN}>, _text string, near array<struct<entity: string, terms: array<struct<term: bigint, before: bigint, after: bigint, form: int>>>>"
_PLACED = "_text string, term bigint, form int, start bigint, end bigint"


def _digest(text: str) -> str:
    return hashlib.md5(text.encode(), usedforsecurity=False).hexdigest()


def _scan(schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans, keys, near = [], [], []
            for x in batch.column("_text"):
                text = x.as_py() or ""
                found = base_spans(text)
                spans.append([{"kind": k, "start": a, "end": b} for k, a, b in found])
                keys.append(_digest(text) if found else None)
                near.append(_near(text, found) if found else [])
            yield pa.record_batch([batch.column("_id"), pa.array(spans, schema.types[1]), pa.array(keys, pa.string()), pa.array(near, schema.types[3])], schema=schema)

    return run


class Filter:
    """Which hashes may be among those of a table: one bit each for their first ``bits`` bits, 2 ** ``MOST_BITS`` bits at most."""

    def __init__(self, terms: DataFrame, n: int):
        self.bits = min(MOST_BITS, max(LEAST_BITS, int(n).bit_length() + 4))
        place = F.shiftrightunsigned("term", 64 - self.bits)
        words = terms.select(F.shiftright(place, 6).alias("word"), F.expr(f"shiftleft(1L, cast(shiftrightunsigned(term, {64 - self.bits}) & 63 as int))").alias("bit"))
        rows = words.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()  # a row for each 64 bits of the filter
        self.words = np.zeros(1 << (self.bits - 6), np.uint64)
        self.words[rows.column("word").to_numpy()] = rows.column("bits").to_numpy().view(np.uint64)

    def may_hold(self, terms: np.ndarray) -> np.ndarray:
        place = terms.view(np.uint64) >> np.uint64(64 - self.bits)
        return (self.words[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))) & np.uint64(1) == 1


def _terms_of(batch: pa.RecordBatch) -> Iterator[tuple[int, Terms]]:
    raw, offsets, _ = column_bytes(batch.column("_text"))
    for a, b in slices(raw, offsets):
        yield a, Terms(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])


_COUNTED = pa.schema([("term", pa.int64()), ("form", pa.int32()), ("n", pa.int64())])


def _count(held):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, forms, waiting, size = held.value, np.zeros(len(FORMS), np.int64), [], 0

        def summed() -> pa.RecordBatch:
            terms = np.concatenate([x[0] for x in waiting]) if waiting else np.zeros(0, np.int64)
            values, at = np.unique(terms, return_inverse=True)
            n = np.bincount(at, np.concatenate([x[1] for x in waiting]), len(values)) if len(values) else values
            return pa.record_batch([pa.array(values, pa.int64()), pa.nulls(len(values), pa.int32()), pa.array(n.astype(np.int64))], schema=_COUNTED)

        for batch in batches:
            for _, terms in _terms_of(batch):
                forms += np.bincount(terms.form, minlength=len(FORMS))
                values, n = np.unique(terms.term[wanted.may_hold(terms.term)], return_counts=True)
                waiting.append((values, n))
                size += len(values)
                if size > FLUSH:
                    yield summed()
                    waiting, size = [], 0
        yield summed()
        yield pa.record_batch([pa.nulls(len(FORMS), pa.int64()), pa.array(range(len(FORMS)), pa.int32()), pa.array(forms)], schema=_COUNTED)

    return run


def _place(held, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = held.value
        for batch in batches:
            for a, terms in _terms_of(batch):
                hit = np.flatnonzero(wanted.may_hold(terms.term))
                start, end, form = *terms.places()[:2], terms.form
                for row in np.unique(terms.row[hit]).tolist():
                    text = batch.column("_text")[a + row].as_py()
                    spans = base_spans(text)
                    own = slice(terms.first[row], terms.first[row + 1])
                    at = np.arange(own.start, own.stop)[_free(start[own], end[own], spans)] if spans else hit[:0]
                    at = np.intersect1d(at, hit, assume_unique=True)
                    if len(at):
                        yield pa.record_batch([pa.array([_digest(text)] * len(at)), pa.array(terms.term[at]), pa.array(form[at].astype(np.int32)), pa.array(start[at]), pa.array(end[at])], schema=schema)

    return run


def disclosures(scanned: DataFrame, texts: DataFrame) -> DataFrame:
    """(entity, term, n_near, n_term, n_entity, n_words, information, pmi) of the terms that disclose an entity. texts: (_text)."""
    spark = texts.sparkSession
    near = scanned.select(F.explode("near").alias("_near")).select("_near.entity", F.explode("_near.terms").alias("_t")).select("entity", "_t.*")
    pairs = near.groupBy("entity", "term").agg(F.count(F.lit(1)).alias("n_near"), *(f(x).alias(f"_{f.__name__}_{x}") for x in ("before", "after") for f in (F.min, F.max)))
    pairs = stored(pairs.where("_min_before <> _max_before AND _min_after <> _max_after").select("entity", "term", "n_near"))
    terms = pairs.select("term").distinct()
    n = terms.count()
    if not n:
        return pairs.select("*", *(F.lit(0).cast("bigint").alias(c) for c in ("n_term", "n_entity", "n_words")), F.lit(0.0).alias("information"), F.lit(0.0).alias("pmi"))
    held = spark.sparkContext.broadcast(Filter(terms, n))
    counts = stored(texts.mapInArrow(_count(held), "term bigint, form int, n bigint").groupBy("term", "form").agg(F.sum("n").alias("n")))
    words = counts.where("term IS NULL").agg(F.sum("n").alias("n_words"))  # one row
    around = near.groupBy("entity").agg(F.count(F.lit(1)).alias("n_entity"))
    told = pairs.join(counts.where("term IS NOT NULL").select("term", F.col("n").alias("n_term")), "term").where(F.col("n_term") <= F.col("n_near") * (1 << SLACK))
    told = told.join(around, "entity").crossJoin(F.broadcast(words))
    log = lambda x, y: F.log2(x.cast("double") / y)
    information = log(F.col("n_words"), F.col("n_entity"))
    pmi = log(F.col("n_near").cast("double") * F.col("n_words"), F.col("n_term").cast("double") * F.col("n_entity"))
    out = told.select("entity", "term", "n_near", "n_term", "n_entity", "n_words", information.alias("information"), pmi.alias("pmi"))
    forms = counts.where("term IS NULL").select("form", F.col("n").alias("n_form"))  # three rows
    alone = near.groupBy("entity", "form").agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(forms), "form").where(F.col("n_form") <= F.col("n") * (1 << SLACK))
    return out.join(alone.groupBy("entity").agg(F.collect_set("form").alias("bare_forms")), "entity", "left")


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Returns the id, ``text_key`` (MD5 of a text with matches), base (spans of the four patterns) and terms (spans to generalise, or to remove, with their form)."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    spark = bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("_id"), F.col(f"`{text_col}`").cast("string").alias("_text"))
    scanned = stored(rows.mapInArrow(_scan(to_arrow_schema(StructType.fromDDL(_SCANNED))), _SCANNED)).withColumnRenamed("_text", "text_key")
    texts = rows.select("_text").where("_text IS NOT NULL")
    told = stored(disclosures(scanned, texts))
    empty = F.array().cast("array<struct<start: bigint, end: bigint, form: int, removed: boolean>>")
    plain = scanned.select(F.col("_id").alias(id_col), "text_key", F.col("spans").alias("base"))
    terms = told.select("term").distinct()
    n = terms.count()
    if not n:
        return plain.withColumn("terms", empty)
    held = spark.sparkContext.broadcast(Filter(terms, n))
    placed = texts.mapInArrow(_place(held, to_arrow_schema(StructType.fromDDL(_PLACED))), _PLACED).distinct()
    holding = scanned.where("text_key IS NOT NULL").select("text_key", F.explode("near.entity").alias("entity")).distinct()
    bare = F.coalesce(F.array_contains("bare_forms", F.col("form")), F.lit(False)) if "bare_forms" in told.columns else F.lit(False)
    hits = placed.join(told, "term").withColumnRenamed("_text", "text_key").join(holding, ["text_key", "entity"])
    hits = hits.groupBy("text_key", "start", "end", "form").agg(F.max(bare).alias("removed"))
    each = stored(hits.groupBy("text_key").agg(F.array_sort(F.collect_list(F.struct("start", "end", "form", "removed"))).alias("terms")))
    copies = heavy_keys(plain.where("text_key IS NOT NULL").groupBy("text_key").agg(F.count(F.lit(1)).alias("n")), "text_key", "n")
    joined = spread_join(plain.where("text_key IS NOT NULL"), each, "text_key", F.col(id_col), copies, "left").select(id_col, "text_key", "base", F.coalesce("terms", empty).alias("terms"))
    return joined.unionByName(plain.where("text_key IS NULL").withColumn("terms", empty))


def sanitised(docs: DataFrame, found: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of docs with ``sanitised``: matches become [EMAIL], [IP], [CARD], [PHONE], terms [NAME], [NUMBER], [WORD], or vanish."""
    every = found.where("text_key IS NOT NULL").groupBy("text_key").agg(F.any_value("base").alias("_base"), F.any_value("terms").alias("_terms"))

    @F.udf("string")
    def cut(text, base, terms):
        marks = [(x.start, x.end, f"[{KINDS[x.kind].upper()}]") for x in base or []] + [(x.start, x.end, "" if x.removed else f"[{FORMS[x.form].upper()}]") for x in terms or []]
        out, at = [], 0
        for start, end, mark in sorted(marks):
            if start >= at:
                out += [text[at:start], mark]
            at = max(at, end)
        return "".join([*out, text[at:]])

    text = F.col(f"`{text_col}`")
    keyed = docs.withColumn("_key", F.md5(text.cast("binary")))
    both = keyed.join(every, F.col("_key") == F.col("text_key"), "left")
    return both.withColumn("sanitised", F.when(F.col("_base").isNull(), text).otherwise(cut(text, "_base", "_terms"))).select(*(F.col(f"`{c}`") for c in docs.columns), "sanitised")


def spans_text(spans: Column, kind) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", kind(x), x.start, x.end)), ",")


def op13_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal_data(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    of_kind = lambda k: F.size(F.filter("base", lambda x: x.kind == k))  # noqa: E731  (a second parameter of the inner one would be the place in the array)
    counts = [of_kind(k).cast("bigint").alias(f"n_{name}") for k, name in enumerate(KINDS)]
    base = spans_text(F.col("base"), lambda x: F.element_at(F.lit(list(KINDS)), x.kind + 1))
    terms = spans_text(F.array_sort("terms"), lambda x: F.when(x.removed, "remove").otherwise("generalise"))
    every = F.concat_ws(",", F.when(base != "", base), F.when(terms != "", terms))
    return found.select("doc_id", *counts, F.sha2(base.cast("binary"), 256).alias("base_sha256"), every.alias("spans"))
