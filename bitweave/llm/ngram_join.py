"""N-gram Jaccard self-join by T-occurrence search (DivideSkip).

Two documents link when 100 * |A & B| >= 75 * |A | B| over their sets of
distinct 5-word shingles.  The result gives each document its set size and the
smallest id that it reaches by links.

How it runs
1. Equal texts become one class (map-side first, so a huge group of copies is
   one row per task before anything is shuffled).
2. Classes are gathered into blocks by text hash; the blocks learn every
   shingle's document frequency through the compact bucket exchange.  Ordered by
   (frequency, hash), two linked sets must share a shingle among the first
   n - ceil(0.75 n) + 1 of each, and a shingle of frequency one links nothing.
   What is left of those prefixes is a small fraction of all shingles.
3. Classes that share prefix shingles, directly or in a chain, form a candidate
   cluster; no link can leave it.  Clusters are cut into groups of at most
   ``GROUP`` classes.
4. In a group each class is searched with DivideSkip: the longest L inverted
   lists are set aside, the shorter ones are merged with a heap that skips
   whatever cannot occur T - L times, and the long ones are probed by binary
   search for the survivors.  A union-find drops pairs that are connected
   already; a spanning forest of links leaves the task.
5. A cluster of more than one group is joined up by searching a few central
   classes of it in all its groups, and then, exactly, by searching every class
   that is still outside the cluster's largest component in each group that
   shares a prefix shingle with it (no other can hold a link of it).  Pairs
   inside one component need no search, so no link is lost and no group of
   copies is expanded into pairs.

Defined results: null, empty or blank text has an empty set, size 0, and links
with nothing; fewer than five words make one shingle of all words; ids are
taken to be unique, and rows that share one are read one by one; columns other than id and text are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from math import log2

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._blocks import block_count, bounded_batches, bucket_bits, by_bucket, decode, encode, heavy_keys, spread_join, stored, text_bytes
from ._components import components
from ._text import trimmed, words_of

SHINGLE = 5
GROUP = 256
HUBS = 16
MU = 0.0085  # DivideSkip's weight of a heap step against a probe


# -- shingle sets -------------------------------------------------------------


def _distinct_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per text and task."""
    seen: set[bytes] = set()
    for batch in batches:
        keys = batch.column("_key").to_pylist()
        new = [i for i, k in enumerate(keys) if k not in seen and not seen.add(k)]
        if new:
            yield batch.take(pa.array(new, pa.int64()))


def _sets(texts, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, bounds): text i has the sorted distinct hashes [bounds[i], bounds[i + 1])."""
    parts, counts = [np.zeros(0, np.uint64)], [0]
    for a, b, words in words_of(texts, lower=True):
        first, h = words.windows(shingle)
        row = words.row[first]
        short = np.flatnonzero((words.count > 0) & (words.count < shingle))
        if len(short):
            whole = []
            for i in short:
                own = words.hash[words.first[i] : words.first[i + 1]]
                acc = len(own)
                for x in own.tolist():
                    acc = (acc ^ x) * 0x9FB21C651E98DF25 % 2**64
                    acc ^= acc >> 32
                whole.append(acc)
            row, h = np.concatenate([row, short]), np.concatenate([h, np.array(whole, np.uint64)])
        order = np.lexsort((h, row))
        row, h = row[order], h[order]
        fresh = np.ones(len(h), bool)
        fresh[1:] = (row[1:] != row[:-1]) | (h[1:] != h[:-1])
        parts.append(h[fresh])
        counts.extend(np.bincount(row[fresh], minlength=b - a).tolist())
    return np.concatenate(parts), np.cumsum(counts)


def _once(table: pa.Table) -> pa.Table:
    """Rows of a block, one per text, in the order of their keys."""
    table = table.sort_by("_key")
    keys = table.column("_key").to_pylist()
    return table.take(pa.array([i for i, k in enumerate(keys) if not i or keys[i - 1] != k], pa.int64()))


def _send(shingle: int, bits: int):
    @trimmed
    def run(table: pa.Table) -> pa.Table:
        block = table.column("_block")[0].as_py()
        h, _ = _sets(_once(table).column("_text"), shingle)
        values, counts = np.unique(h, return_counts=True)
        parts, many, at = by_bucket(values, bits), [], 0
        for _, part in parts:
            own = counts[at : at + len(part)]
            at += len(part)
            many.append(_pack(own))
        return pa.table({"_bucket": pa.array([k for k, _ in parts], pa.int32()), "_block": pa.array([block] * len(parts), pa.int32()), "_data": pa.array([encode(v) for _, v in parts], pa.binary()), "_many": pa.array(many, pa.binary())})

    return run


def _pack(counts: np.ndarray) -> bytes:
    """A bit for each count over one, then those counts."""
    more = counts > 1
    return np.packbits(more).tobytes() + counts[more].astype("<u4").tobytes()


def _unpack(data: bytes, n: int) -> np.ndarray:
    flags = (n + 7) // 8
    counts = np.ones(n, np.int64)
    counts[np.unpackbits(np.frombuffer(data, np.uint8, flags), count=n).astype(bool)] = np.frombuffer(data, "<u4", offset=flags)
    return counts


@trimmed
def _answer(table: pa.Table) -> pa.Table:
    """In one bucket: the corpus frequency of each hash of each block."""
    parts = [decode(x.as_py()) for x in table.column("_data")]
    counts = np.concatenate([_unpack(x.as_py(), len(p)) for x, p in zip(table.column("_many"), parts, strict=True)])
    cuts = np.cumsum([len(p) for p in parts])[:-1]
    _, place = np.unique(np.concatenate(parts), return_inverse=True)
    total = np.bincount(place, weights=counts).astype(np.int64)[place]
    return pa.table({"_bucket": table.column("_bucket").cast(pa.int32()), "_block": table.column("_block").cast(pa.int32()), "_many": pa.array([_pack(x) for x in np.split(total, cuts)], pa.binary())})


CLASSES = "_key binary, n long, prefix array<long>, shingles binary, score double"


def _prefixes(shingle: int, bits: int, percent: int):
    @trimmed
    def run(texts: pa.Table, answers: pa.Table) -> pa.Table:
        texts = _once(texts) if texts.num_rows else texts
        h, bounds = _sets(texts.column("_text"), shingle)
        values, place = np.unique(h, return_inverse=True)
        df = np.ones(len(values), np.int64)
        held, at = dict(zip(answers.column("_bucket").to_pylist(), answers.column("_many").to_pylist(), strict=True)), 0
        for k, part in by_bucket(values, bits):
            df[at : at + len(part)] = _unpack(held[k], len(part))
            at += len(part)
        df = df[place]
        sizes, prefixes, kept, scores = np.diff(bounds), [], [], []
        for i, n in enumerate(sizes.tolist()):
            own, often = h[bounds[i] : bounds[i + 1]], df[bounds[i] : bounds[i + 1]]
            order = np.argsort(often, kind="stable")[: n - (-(-percent * n // 100)) + 1] if n else np.zeros(0, np.int64)
            shared = order[often[order] > 1]
            prefixes.append(own[shared].view(np.int64) if len(shared) else None)
            kept.append(own[often > 1].astype("<u8").tobytes() if len(shared) else None)
            scores.append(float(often[order].sum() / max(1, len(order))))
        return pa.table({"_key": texts.column("_key").combine_chunks().cast(pa.binary()), "n": pa.array(sizes, pa.int64()), "prefix": pa.array(prefixes, pa.list_(pa.int64())), "shingles": pa.array(kept, pa.binary()), "score": pa.array(scores, pa.float64())})

    return run


# -- T-occurrence search ------------------------------------------------------


class Index:
    """Inverted lists over the sets of one group, positions ascending."""

    def __init__(self, sets: list[np.ndarray], sizes: list[int]):
        self.sizes = sizes
        tokens = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        order = np.argsort(tokens, kind="stable")
        tokens, owner = tokens[order], owner[order]
        cut = np.flatnonzero(np.diff(tokens)) + 1
        heads = tokens[np.concatenate([[0], cut])].tolist() if len(tokens) else []
        self.lists = dict(zip(heads, (x.tolist() for x in np.split(owner, cut)), strict=True)) if heads else {}

    def search(self, tokens: list[int], n: int, percent: int, after: int = -1, skip=None) -> Iterator[int]:
        """Positions past ``after`` whose overlap with a set of size n reaches the threshold. skip(position): needn't be looked at."""
        least = max(1, -(-percent * n // 100))  # overlap is at least this share of the larger set
        lists = [x for t in tokens if (x := self.lists.get(t)) and x[-1] > after]
        if len(lists) < least:
            return
        lists.sort(key=len)
        n_long = min(least - 1, int(least / (MU * log2(max(2, len(lists[-1]))) + 1)))
        short, long = lists[: len(lists) - n_long], lists[len(lists) - n_long :]
        need = least - n_long
        for at, count in merge_skip(short, need, after):
            if skip and skip(at):
                continue
            most = self.sizes[at]
            for left, x in zip(range(n_long, 0, -1), long, strict=True):
                if 100 * (count + left) < percent * (n + most - count - left):
                    break
                k = bisect_left(x, at)
                count += k < len(x) and x[k] == at
            if 100 * count >= percent * (n + most - count):
                yield at


def merge_skip(lists: list[list[int]], need: int, after: int = -1) -> Iterator[tuple[int, int]]:
    """Heap-merge of ascending lists: (value, occurrences) for values past ``after`` that occur ``need`` times or more."""
    at = [bisect_right(x, after) for x in lists]
    heap = [(x[p], i) for i, (x, p) in enumerate(zip(lists, at, strict=True)) if p < len(x)]
    heapify(heap)
    while len(heap) >= need:
        value, out = heap[0][0], []
        while heap and heap[0][0] == value:
            out.append(heappop(heap)[1])
        if len(out) >= need:
            yield value, len(out)
            for i in out:
                at[i] += 1
        else:  # the next possible value is the need-th smallest from here: all before it are skipped
            while heap and len(out) < need - 1:
                out.append(heappop(heap)[1])
            if not heap:
                return
            goal = heap[0][0]
            for i in out:
                at[i] = bisect_left(lists[i], goal, at[i])
        for i in out:
            if at[i] < len(lists[i]):
                heappush(heap, (lists[i][at[i]], i))


def _search(percent: int):
    """One bundle of groups: searches each group's queries, or each member against those after it, and returns a forest of links."""

    @trimmed
    def run(table: pa.Table) -> pa.Table:
        groups: dict[tuple[int, int], tuple[list, list]] = {}
        rows = zip(*(table.column(c).to_pylist() for c in ("cluster", "part", "query", "cid", "root", "n", "shingles")), strict=True)
        for cluster, part, query, *row in rows:
            groups.setdefault((cluster, part), ([], []))[query].append(row)
        a, b = [], []
        for members, queries in groups.values():
            members.sort(key=lambda r: (r[2], r[0]))
            up: dict[int, int] = {}

            def find(x: int) -> int:
                while (p := up.setdefault(x, x)) != x:
                    up[x] = x = up[p] if p in up else p
                return x

            sets = [np.frombuffer(r[3], "<u8").astype(np.uint64) for r in members]
            index = Index(sets, [r[2] for r in members])
            alone = not queries or queries[0][1] is None  # the first pass also joins the group itself
            work = [(k, r, s) for k, (r, s) in enumerate(zip(members, sets, strict=True))] if alone else []
            work += [(-1, r, np.frombuffer(r[3], "<u8").astype(np.uint64)) for r in queries]
            node = [r[0] if r[1] is None else r[1] for r in members]
            for after, r, own in work:
                me = r[0] if r[1] is None else r[1]
                for at in index.search(own.tolist(), r[2], percent, after, lambda k: find(node[k]) == find(me)):
                    x, y = find(me), find(node[at])
                    if x != y:
                        up[max(x, y)] = min(x, y)
                        a.append(me)
                        b.append(node[at])
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def _links(members: DataFrame, queries: DataFrame | None, percent: int, bundles: int) -> DataFrame:
    columns = ["cluster", "part", "query", "cid", "root", "n", "shingles"]
    rows = members.select(*columns) if queries is None else members.select(*columns).unionByName(queries.select(*columns))
    return rows.groupBy(F.pmod(F.xxhash64("cluster", "part"), F.lit(bundles)).alias("bundle")).applyInArrow(lambda t: _search(percent)(t), "a long, b long")


# -- the operator -------------------------------------------------------------


def ngram_jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, percent: int = 75) -> DataFrame:
    """Returns id, n_shingles, component_id (the smallest id reachable by links, its own included)."""
    bounded_batches(docs.sparkSession)
    blocks = block_count(text_bytes(docs, text_col))
    bits = bucket_bits(blocks)
    rows = docs.select(F.col(id_col).cast("bigint").alias("_id"), F.unhex(F.md5(F.col(text_col).cast("binary"))).alias("_key"), F.col(text_col).alias("_text"))
    texts = rows.where("_key is not null").select("_key", "_text").mapInArrow(_distinct_texts, "_key binary, _text string")
    texts = texts.select(F.pmod(F.xxhash64("_key"), F.lit(blocks)).cast("int").alias("_block"), "_key", "_text")
    sent = texts.groupBy("_block").applyInArrow(_send(shingle, bits), "_bucket int, _block int, _data binary, _many binary")
    answers = sent.groupBy("_bucket").applyInArrow(_answer, "_bucket int, _block int, _many binary")
    found = texts.groupBy("_block").cogroup(answers.groupBy("_block")).applyInArrow(_prefixes(shingle, bits, percent), CLASSES)
    smallest = rows.where("_key is not null").groupBy("_key").agg(F.min("_id").alias("cid"), F.count(F.lit(1)).alias("copies"))
    classes = stored(found.join(smallest, "_key"))

    live = classes.where("shingles is not null and cid is not null")
    postings = live.select("cid", F.explode("prefix").alias("token"))
    pivots = postings.groupBy("token").agg(F.min("cid").alias("pivot"), F.max("cid").alias("last")).where("pivot <> last").select("token", "pivot")
    near = postings.join(pivots, "token").where("cid <> pivot").select(F.col("cid").alias("a"), F.col("pivot").alias("b")).distinct()
    clusters = components(near).select(F.col("node").alias("cid"), F.col("root").alias("cluster"))
    sizes = clusters.groupBy("cluster").agg(F.ceil(F.count(F.lit(1)) / F.lit(GROUP)).cast("int").alias("parts"))
    members = stored(live.select("cid", "n", "shingles", "score").join(clusters, "cid").join(sizes, "cluster").withColumn("part", F.pmod(F.xxhash64("cid"), F.col("parts")).cast("int")).withColumn("query", F.lit(0)).withColumn("root", F.lit(None).cast("bigint")))
    total, most = members.agg(F.count(F.lit(1)), F.max("parts")).first()
    bundles = max(64, total // GROUP)
    edges = stored(_links(members, _hubs(members) if (most or 0) > 1 else None, percent, bundles))
    roots = components(edges)
    if (most or 0) > 1:
        roots = _outsiders(members, postings, edges, roots, percent, bundles)
    by_class = classes.select("_key", "n", "cid").join(roots.select(F.col("node").alias("cid"), "root"), "cid", "left").select("_key", "n", F.coalesce("root", "cid").alias("_component"))
    out = spread_join(rows.where("_key is not null").select("_id", "_key"), by_class, "_key", F.col("_id"), heavy_keys(classes, "_key", "copies"))
    out = out.select("_id", "n", F.when(F.col("n") > 0, F.col("_component")).otherwise(F.col("_id")).alias("root"))
    out = out.unionByName(rows.where("_text is null").select("_id", F.lit(0).cast("bigint").alias("n"), F.col("_id").alias("root")))
    return out.select(F.col("_id").alias(id_col), F.col("n").alias("n_shingles"), F.col("root").alias("component_id"))


def _hubs(members: DataFrame) -> DataFrame:
    """The most central classes of each cluster that has several groups, sent to every group but their own."""
    from pyspark.sql import Window

    best = members.where("parts > 1").groupBy("cluster", "parts", "part").agg(F.max_by(F.struct("cid", "n", "shingles", "score"), F.struct("score", "cid")).alias("x"))
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("cluster").orderBy(F.col("x.score").desc(), "x.cid"))).where(F.col("rank") <= HUBS)
    sent = ranked.select("cluster", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("part").alias("own"), "x.cid", "x.n", "x.shingles")
    return sent.where("part <> own").withColumn("query", F.lit(1)).withColumn("root", F.lit(None).cast("bigint"))


def _outsiders(members: DataFrame, postings: DataFrame, edges: DataFrame, roots: DataFrame, percent: int, bundles: int) -> DataFrame:
    """Exact completion of clusters with several groups: whatever is outside the largest component is searched wherever a link of it can be."""
    large = members.where("parts > 1").drop("root").join(roots.select(F.col("node").alias("cid"), "root"), "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    large = stored(large)
    inside = large.groupBy("cluster", "root").agg(F.count(F.lit(1)).alias("size")).groupBy("cluster").agg(F.max_by("root", F.struct("size", "root")).alias("main"))
    outside = stored(large.join(inside, "cluster").where("root <> main").drop("main"))
    tokens = postings.join(large.select("cid", "part"), "cid").select("token", "part").distinct()  # a token lies in one cluster only
    where = postings.join(outside.select("cid"), "cid", "left_semi").join(tokens, "token").select("cid", "part").distinct()
    queries = outside.drop("part").join(where, "cid").withColumn("query", F.lit(1))
    touched = large.join(queries.select("cluster", "part").distinct(), ["cluster", "part"], "left_semi")
    more = _links(touched, queries, percent, bundles)
    return components(edges.unionByName(more))


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard_join(spark.read.parquet(f"{sf_dir}/documents.parquet"))
