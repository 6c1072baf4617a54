"""Benchmark decontamination by template canonicalisation.

Texts become token sequences in lower case without punctuation, in which numbers,
units after a number and names (capitalised inside a sentence) are typed
placeholders; the values they stand for are kept as slots.  Windows of eight
template tokens are hash-joined with the benchmark's, once with names as
placeholders and once as words.  All is done a second time with capitalised words
that start a sentence as names, too, but for those that the benchmark writes in
lower case elsewhere ("Alice has 5 pens. Bob has 3."); an item is found if either
reading finds it.  The windows that match are aligned; an alignment
counts if its slots are consistent, that is, if each value of the benchmark item
always stands for one value in the document.  So a question whose numbers, units
or names were replaced throughout is found, and a text that merely has the same
shape in places is not.  Equal numbers before different words are different
values (2 pens and 2 books), a unit's singular and plural are one.

Of an alignment that contradicts itself the places that agree with most of their
value's places are kept (none on a tie), and only the windows over the others are
left out; apart from that, the windows whose slots equal the item's are kept.  A
stretch of either kind counts if it is as long as the rule below asks, so that a
contradiction elsewhere doesn't clear a long copy, and a short text that
contradicts itself is clean.

A document is contaminated by an item when alignments that agree with each other
cover ``min(13, max(8, 0.6 n))`` of the item's n tokens (an item of fewer than
eight tokens must be covered whole), at least ``LEAST_WORDS`` of them words.  The
longest alignment comes first, and each is added to the first mapping of values
that it doesn't contradict: one item is never put together from passages that
stand for different values.  Of an item with fewer words than that all must be
covered, and only by windows whose slots equal the item's: a template of so few
words fits anything.

Windows that are frequent on both sides (lines of numbers) make many alignments.
Beyond ``MOST_MATCHES`` a document's matches are counted by alignment in parts and
read one alignment at a time, so memory follows the lengths, not their product.

The benchmark's windows go to every task in parts of at most ``MOST_TOKENS``
tokens (about 100 MB); a larger benchmark takes several passes over the corpus,
each exact, and nothing of the corpus is ever shuffled.

Defined results: null or empty texts are clean; a null benchmark text or id is no
item; items with equal ids are matched one by one and reported once; rows with
equal ids are judged one by one; columns named in ``keep`` pass unchanged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._blocks import bounded_batches
from ._text import Words, column_bytes, make_room, mix, slices

WINDOW = 8
LONG_RUN = 13
SHARE = 0.6
LEAST_WORDS = 5
MOST_TOKENS = 1_000_000
MOST_MATCHES = 1_000_000
# Unit words and symbols that may follow a number.
UNITS = "% $ € £ ° mm cm m km in inch inches ft foot feet yd yard yards mi mile miles mg g kg gram grams kilogram kilograms oz ounce ounces lb lbs pound pounds ton tons tonne tonnes ml l liter liters litre litres gallon gallons cup cups s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years ms hz khz mhz ghz w kw watt watts v volt volts a amp amps j joule joules cal kcal calories k c f kelvin celsius degrees degree percent cent cents dollar dollars euro euros usd eur mph kph kmh rpm bit bits byte bytes kb mb gb tb pa kpa bar atm mol n newton newtons".split()

_U = np.uint64
_NUMBER, _UNIT, _NAME = (_U(x) for x in (0xA5A5A5A55A5A5A5B, 0xC3C3C3C33C3C3C3D, 0xE1E1E1E11E1E1E1F))
_CLASS = np.zeros(256, np.uint8)  # 0 between tokens, 1 letters and other bytes, 2 digits
_CLASS[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 1
_CLASS[48:58] = 2
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_STOP = np.zeros(256, bool)
_STOP[[ord(x) for x in ".!?:;\n\"("]] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord("%"), ord("$")]] = True


class Template(Words):
    """Canonical tokens of several texts: ``typed`` (hashes, names as placeholders), ``plain`` (names as words), ``slot`` (is a placeholder).

    With ``common`` (hashes of words that are no names), a capitalised word that starts a sentence is a name too, and
    there is no reading of names as words; ``sure`` are the placeholders that there are without it.
    """

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, common: np.ndarray | None = None):  # noqa: super().__init__ cuts at white space
        self.wide = common is not None
        n = len(raw)
        self.raw, self.offsets = _FOLD[raw], offsets
        kind = _CLASS[raw]
        if n > 2:  # 1,000 and 3.5 are one number
            inner = (raw[1:-1] == 44) | (raw[1:-1] == 46)
            kind[1:-1][inner & (kind[:-2] == 2) & (kind[2:] == 2)] = 2
        kind = kind + 3 * _SYMBOL[raw]
        edge = np.ones(n + 1, bool)
        edge[1:n] = kind[1:] != kind[:-1]
        edge[offsets] = True
        self.start = np.flatnonzero(edge[:-1] & (kind > 0))
        self.end = np.flatnonzero(edge[1:] & (kind > 0)) + 1
        self.row = np.searchsorted(offsets, self.start, side="right") - 1
        self.count = np.bincount(self.row, minlength=len(offsets) - 1).astype(np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.count)]).astype(np.int64)
        self.hash = self._hashes()
        m = len(self.start)
        if not m:
            self.typed = self.plain = self.one = self.hash
            self.slot = self.sure = self.number = np.zeros(0, bool)
            return
        number = kind[self.start] == 2
        same = np.zeros(m, bool)
        same[1:] = self.row[1:] == self.row[:-1]
        after = np.zeros(m, bool)
        after[1:] = number[:-1]
        unit = after & same & np.isin(self.hash, _UNITS)
        stops = np.flatnonzero(_STOP[raw])
        quiet = np.zeros(m, bool)
        quiet[1:] = np.searchsorted(stops, self.start[1:]) == np.searchsorted(stops, self.end[:-1])
        first = raw[self.start]
        capital = (first >= 65) & (first <= 90) & ~unit
        name = capital & same & quiet
        self.sure, self.lower = number | unit | name, ~capital & ~number & ~unit
        if self.wide:
            name |= capital & (self.end - self.start > 1) & ~np.isin(self.hash, common)
        self.plain = self.hash.copy()
        self.plain[number], self.plain[unit] = _NUMBER, _UNIT
        self.typed = self.plain.copy()
        self.typed[name] = _NAME
        self.slot, self.number = number | unit | name, number
        self.one = _singular(self.hash)

    def windows_of(self, size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(first token, hash) of windows: of all with names as placeholders, and of those that hold a name with names as words."""
        kept = self.hash
        for tokens in (self.typed,) if self.wide else (self.typed, self.plain):
            self.hash = tokens
            at, h = self.windows(size)
            if tokens is self.plain and not self.wide:
                names = np.concatenate([[0], np.cumsum(self.typed != self.plain)])
                named = names[at + size] > names[at] if len(at) else np.zeros(0, bool)
                at, h = at[named], h[named]
            yield at, mix(h + _U(size))
        self.hash = kept


def _template(texts: list[str], common: np.ndarray | None = None) -> Template:
    data = [x.encode() for x in texts]
    return Template(np.frombuffer(b"".join(data), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in data])]).astype(np.int64), common)


def lower_words(texts: list[str]) -> np.ndarray:
    """Hashes of the words that texts write in lower case: no names, where they start a sentence."""
    t = _template(texts)
    return np.unique(t.hash[t.lower]) if len(t.hash) else t.hash


def _word_hashes(words: list[str]) -> np.ndarray:
    raw = " ".join(words).encode()
    return Words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), lower=True).hash


_UNITS = _word_hashes(UNITS)
_SINGULAR = {"inches": "inch", "feet": "foot"} | {f"{x}s": x for x in UNITS if len(x) > 1 and f"{x}s" in UNITS}
_PLURALS, _SINGULARS = _word_hashes(list(_SINGULAR)), _word_hashes(list(_SINGULAR.values()))
_BY_HASH = np.argsort(_PLURALS)
_PLURALS, _SINGULARS = _PLURALS[_BY_HASH], _SINGULARS[_BY_HASH]


def _singular(h: np.ndarray) -> np.ndarray:
    """Units in the singular; other values as they are."""
    at = np.minimum(np.searchsorted(_PLURALS, h), len(_PLURALS) - 1)
    return np.where(_PLURALS[at] == h, _SINGULARS[at], h)


class Benchmark:
    """Template windows of some items, as sorted arrays with a bitmap in front."""

    def __init__(self, items: list[tuple[int, str]], window: int = WINDOW, common: np.ndarray | None = None):
        self.ids, self.common = [i for i, _ in items], common
        self.template = t = _template([x for _, x in items], common)
        self.words = np.bincount(t.row, weights=~t.sure, minlength=len(items)).astype(np.int64)
        self.window = window
        self.sizes = sorted({min(window, int(n)) for n in t.count if n})
        hashes, first = [np.zeros(0, _U)], [np.zeros(0, np.int64)]
        for k in self.sizes:
            for at, h in t.windows_of(k):
                keep = (t.count[t.row[at]] == k) | (k == window)  # a short item is one window
                hashes.append(h[keep])
                first.append(at[keep])
        h, at = np.concatenate(hashes), np.concatenate(first)
        order = np.lexsort((at, h))
        self.hashes, self.at = h[order], at[order]
        self.bitmap = np.zeros(1 << 22, bool)
        self.bitmap[(self.hashes & _U((1 << 22) - 1)).astype(np.int64)] = True
        # places of one hash are a run; run and place together ascend over the whole table
        self.run = np.cumsum(np.concatenate([[0], (self.hashes[1:] != self.hashes[:-1]).astype(np.int64)]))[: len(self.at)]
        self.stride = len(t.start) + 1
        self.places = self.run * self.stride + self.at
        counts = t.number.copy()  # what a slot is about: its value, and for a number what it counts
        following = np.zeros(len(t.start), _U)
        if len(counts):
            counts[-1] = False
            counts[:-1] &= t.row[1:] == t.row[:-1]
            following[:-1] = t.one[1:]
        self.thing = mix(t.one * _U(0x9FB21C651E98DF25) + np.where(counts, mix(following + _U(1)), _U(0)))

    def judge(self, t: Template) -> dict[int, dict[int, int]]:
        """{row: {item position: covered tokens}} of contaminated rows."""
        found: list[tuple[np.ndarray, np.ndarray]] = []
        for k in self.sizes:
            for at, h in t.windows_of(k):
                maybe = np.flatnonzero(self.bitmap[(h & _U((1 << 22) - 1)).astype(np.int64)])
                low = np.searchsorted(self.hashes, h[maybe])
                hit = self.hashes[np.minimum(low, len(self.hashes) - 1)] == h[maybe]
                found.append((at[maybe[hit]], self.run[low[hit]]))
        q, run = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (zip(*found, strict=True) if found else ((), ())))
        out: dict[int, dict[int, int]] = {}
        if not len(q):
            return out
        order = np.argsort(q, kind="stable")
        q, run = q[order], run[order]
        low, high = self._between(run, 0, self.stride - 1)
        rows = t.row[q]
        cuts = np.flatnonzero(np.diff(rows)) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(q)], strict=True):
            row = int(rows[a])
            for item, alignments in self._aligned(q[a:b], run[a:b], low[a:b], high[a:b]):
                covered = self._covered(t, item, alignments)
                if covered:
                    out.setdefault(row, {})[item] = covered
        return out

    def _between(self, run: np.ndarray, first, end) -> tuple[np.ndarray, np.ndarray]:
        """Where in the table each run's places in [first, end) lie."""
        base = run * self.stride
        return np.searchsorted(self.places, base + first), np.searchsorted(self.places, base + end)

    def _expand(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number of the range, place) of all entries in the ranges [low, high) of the table."""
        many = high - low
        ends = np.cumsum(many)
        entry = np.repeat(low - (ends - many), many) + np.arange(int(many.sum()))
        return np.repeat(np.arange(len(low)), many), self.at[entry]

    def _aligned(self, q, run, low, high) -> Iterator[tuple[int, Iterator[tuple[int, np.ndarray]]]]:
        """For each item that a document's windows meet: its alignments (shift, windows' first tokens in the item), those with most windows first."""
        if int((high - low).sum()) <= MOST_MATCHES:
            of, p = self._expand(low, high)
            item, shift = self.template.row[p], q[of] - p
            order = np.lexsort((p, shift, item))
            item, shift, p = item[order], shift[order], p[order]
            edge = np.flatnonzero((np.diff(item) != 0) | (np.diff(shift) != 0)) + 1
            begin, end = np.concatenate([[0], edge]), np.concatenate([edge, [len(p)]])
            owner = item[begin]
            for i in np.unique(owner):
                own = np.flatnonzero(owner == i)
                own = own[np.argsort(-(end[own] - begin[own]), kind="stable")]
                yield int(i), ((int(shift[begin[k]]), np.unique(p[begin[k] : end[k]])) for k in own)
            return
        first = self.template.first
        runs, where = np.unique(run, return_index=True)
        met = np.zeros(len(self.ids), bool)
        for k in where.tolist():
            met[np.unique(self.template.row[self.at[low[k] : high[k]]])] = True
        for i in np.flatnonzero(met):
            yield int(i), self._large(q, run, int(first[i]), int(first[i + 1]))

    def _large(self, q, run, first: int, end: int) -> Iterator[tuple[int, np.ndarray]]:
        """The alignments of one item, without ever holding all matches."""
        low, high = self._between(run, first, end)
        own = high > low
        q, run, low, high = q[own], run[own], low[own], high[own]
        least = int(q[0]) - end
        many = np.zeros(int(q[-1]) - first - least + 1, np.int64)
        ends = np.cumsum(high - low)
        a = 0
        while a < len(q):
            b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + MOST_MATCHES, side="right")))
            of, p = self._expand(low[a:b], high[a:b])
            shift = q[a:b][of] - p - least
            many[: int(shift.max()) + 1] += np.bincount(shift)
            a = b
        for k in np.argsort(-many, kind="stable"):
            if not many[k]:
                return
            shift = int(k) + least
            p = q - shift
            inside = (p >= first) & (p < end)
            at, _ = self._between(run[inside], p[inside], p[inside])
            hit = self.places[np.minimum(at, len(self.places) - 1)] == run[inside] * self.stride + p[inside]
            yield shift, np.unique(p[inside][hit])

    def _covered(self, t: Template, item: int, alignments: Iterator[tuple[int, np.ndarray]]) -> int:
        """How many of an item's tokens alignments that agree cover, or 0 if that is too little."""
        first, n = int(self.template.first[item]), int(self.template.count[item])
        size = min(self.window, n)
        least = n if n < self.window else min(LONG_RUN, max(self.window, SHARE * n))
        own = int(self.words[item])
        slot, sure, one = self.template.slot[first : first + n], self.template.sure[first : first + n], self.template.hash[first : first + n]
        thing = np.unique(self.thing[first : first + n], return_inverse=True)[1]
        minds: list[tuple[np.ndarray, np.ndarray]] = []  # what each thing stands for, and which tokens are covered
        for shift, windows in alignments:
            windows = windows - first
            there = np.arange(first + shift, first + shift + n)
            there = np.where((there >= 0) & (there < len(t.start)), there, 0)
            value, changed = t.one[there], slot & (t.hash[there] != one)
            if own < LEAST_WORDS:
                pieces = [_cover(_clear(windows, size, changed), size, n)]
            else:
                pieces = _agreeing(windows, size, n, slot, thing, value, changed, least)
            for piece in pieces:
                if not piece.any():
                    continue
                held = np.flatnonzero(piece & slot)
                for values, covered in minds:
                    if covered[piece].all():
                        break
                    known = values[thing[held]]
                    if ((known == 0) | (known == value[held])).all():
                        values[thing[held]] = value[held]
                        covered |= piece
                        break
                else:
                    values, covered = np.zeros(n, _U), piece.copy()
                    values[thing[held]] = value[held]
                    minds.append((values, covered))
                if covered.sum() >= least and (covered & ~sure).sum() >= min(LEAST_WORDS, own):
                    return int(covered.sum())
        return 0


def _cover(windows: np.ndarray, size: int, n: int) -> np.ndarray:
    """Which of n tokens the windows cover."""
    depth = np.bincount(windows, minlength=n + 1)[: n + 1] - np.bincount(windows + size, minlength=n + 1)[: n + 1]
    return np.cumsum(depth[:n]) > 0


def _clear(windows: np.ndarray, size: int, bad: np.ndarray) -> np.ndarray:
    before = np.concatenate([[0], np.cumsum(bad)])
    return windows[before[windows + size] == before[windows]]


def _agreeing(windows, size: int, n: int, slot, thing, value, changed, least: float) -> list[np.ndarray]:
    """Parts of an alignment that count: one value of the item, one value in the document."""
    places = _cover(windows, size, n)
    held = np.flatnonzero(places & slot)
    order = held[np.lexsort((value[held], thing[held]))]
    if not len(order):
        return [places]
    new = np.concatenate([[True], (np.diff(thing[order]) != 0) | (value[order][1:] != value[order][:-1])])
    start = np.flatnonzero(new)  # of each value of each thing
    many = np.diff(np.append(start, len(order)))
    of = thing[order[start]]
    if (np.diff(of) != 0).all():
        return [places]
    most = np.zeros(n, np.int64)
    np.maximum.at(most, of, many)
    top = many == most[of]
    ties = np.bincount(of[top], minlength=n)
    right = top & (ties[of] == 1)
    wrong = np.zeros(n, bool)
    wrong[order[np.repeat(~right, many)]] = True
    out = []
    for bad in (wrong, changed & places):
        kept = _cover(_clear(windows, size, bad), size, n)
        edge = np.flatnonzero(np.diff(np.concatenate([[0], kept.astype(np.int8), [0]])))
        for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
            if b - a >= least:
                piece = np.zeros(n, bool)
                piece[a:b] = True
                out.append(piece)
    return out


def _judge(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make_room()
        readings = shared.value
        for batch in batches:
            raw, offsets, _ = column_bytes(batch.column("_text"))
            names = [x for x in batch.schema.names if x != "_text"]
            for a, b in slices(raw, offsets, 1 << 20):
                found: dict[int, set[int]] = {}
                for benchmark in readings:
                    for k, own in benchmark.judge(Template(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], benchmark.common)).items():
                        found.setdefault(k, set()).update(benchmark.ids[i] for i in own)
                items = [sorted(found.get(k, ())) for k in range(b - a)]
                part = batch.slice(a, b - a)
                yield pa.record_batch([*(part.column(x) for x in names), pa.array(items, pa.list_(pa.int64()))], names=[*names, "item_ids"])

    return run


def decontaminate(docs: DataFrame, benchmark: DataFrame, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """Returns the columns ``keep`` (one that has the name of a result is left out), contaminated, n_items and item_ids (ascending)."""
    spark = bounded_batches(docs.sparkSession)
    items = benchmark.select(F.col(item_col).cast("bigint").alias("id"), F.col(item_text_col).alias("text")).where("id is not null and text is not null")
    size = int(items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // 4
    parts = max(1, -(-size // MOST_TOKENS))
    keep = [c for c in keep if c not in ("contaminated", "n_items", "item_ids")]
    own_names = [f"_k{i}" for i in range(len(keep))]
    fields = "".join(f"{k} {docs.schema[c].dataType.simpleString()}, " for k, c in zip(own_names, keep, strict=True))
    rows = docs.select(*(F.col(f"`{c}`").alias(k) for k, c in zip(own_names, keep, strict=True)), F.col(text_col).alias("_text"))
    found = None
    for k in range(parts):
        own = items.where(F.pmod(F.xxhash64("id", "text"), F.lit(parts)) == k) if parts > 1 else items
        pairs = sorted((r["id"], r["text"]) for r in own.collect())
        shared = spark.sparkContext.broadcast([Benchmark(pairs, window), Benchmark(pairs, window, lower_words([x for _, x in pairs]))])
        # later passes read the text again, next to what was found so far
        source = rows if found is None else found.withColumnRenamed("item_ids", "_before").select(*own_names, "_before", "_text")
        names = fields + ("_before array<bigint>, " if found is not None else "") + ("_text string, " if k < parts - 1 else "")
        found = source.mapInArrow(_with_text(_judge(shared)) if k < parts - 1 else _judge(shared), f"{names}item_ids array<bigint>")
        if "_before" in found.columns:
            found = found.withColumn("item_ids", F.array_sort(F.array_union("_before", "item_ids"))).drop("_before")
    back = (F.col(k).alias(c) for k, c in zip(own_names, keep, strict=True))
    return found.select(*back, (F.size("item_ids") > 0).alias("contaminated"), F.size("item_ids").cast("bigint").alias("n_items"), "item_ids")


def _with_text(judge):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            items = pa.chunked_array([x.column("item_ids") for x in judge(iter([batch]))], pa.list_(pa.int64())).combine_chunks()
            yield pa.record_batch([*batch.columns, items], names=[*batch.schema.names, "item_ids"])

    return run


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
