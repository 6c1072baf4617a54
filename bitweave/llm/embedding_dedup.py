"""Embedding near-dedup: an inverted multi-index with multi-sequence traversal.

Vectors are compared when their labels are equal and link at a cosine of 0.98 or
more.  Two independent codebooks, one for each half of the (unit) vector, form a
product grid of cells.  A vector looks in the nearest cells in order of a lower
bound of the distance to anything in the cell - the sum, over the halves, of the
squared distance to the cell's Voronoi boundary - until the bound passes a
radius: the multi-sequence algorithm, a heap over pairs of places in the two
ascending sequences of bounds.  The radius is calibrated so that ``recall`` of the hardest links (exactly
at the threshold, in random directions) fall inside it; links closer than that
are found more surely still.  Of two cells only the vectors of the lower one
look into the other, and a link found counts for both its ends; within a cell
each vector looks for itself.  Every candidate is verified in double precision.

Vectors travel as bytes, of floats where the column has floats and of doubles
otherwise; all sums are in double precision.

Equal vectors of a label are one class with a multiplicity.  A crowded cell is
cut into parts on either side, so a block of at most ``PART`` indexed vectors
meets at most ``PART`` searching ones in one matrix product; pairs are counted,
not emitted, and only a spanning forest of links leaves a task.

The codebooks are fitted on at most about ``sample`` vectors, more only to give
each vector length ``LEAST_SAMPLE`` and each centre eight (a bound on the training,
all vectors are indexed and all search), and grow with the table so that a cell
holds a few dozen vectors of a label, up to ``MOST_CENTRES`` a half: enough for
500 million vectors of a label.  Each vector length has a grid of its own.

Defined results: rows whose vector or label or id is null, whose vector is zero,
empty, or holds null or non-finite components link with nothing; vectors of
different lengths don't link with each other; -0.0 is 0.0; ids are taken to be unique, and rows that
share one are read one by one, each with a result of its own; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._blocks import heavy_keys, spread_join, stored
from ._components import components

THRESHOLD = 0.98
RECALL = 0.9999
SAMPLE = 20_000
LEAST_SAMPLE = 1_000
PART = 384
OCCUPANCY = 32
MOST_CENTRES = 4096


def kmeans(points: np.ndarray, k: int, rounds: int = 12, seed: int = 5) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centres = points[rng.choice(len(points), min(k, len(points)), replace=False)].copy()
    for _ in range(rounds):
        near = squared(points, centres).argmin(1)
        sums, counts = np.zeros_like(centres), np.bincount(near, minlength=len(centres))
        np.add.at(sums, near, points)
        centres[counts > 0] = sums[counts > 0] / counts[counts > 0, None]
    return np.unique(centres, axis=0)


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a**2).sum(1)[:, None] - 2 * (a @ b.T) + (b**2).sum(1), 0)


class Grid:
    """Codebooks of both halves, and the radius of the traversal."""

    def __init__(self, sample: np.ndarray, k: int, threshold: float, recall: float):
        self.half = sample.shape[1] // 2
        self.books = [kmeans(sample[:, : self.half], k), kmeans(sample[:, self.half :], k)] if self.half else [np.zeros((1, 0)), kmeans(sample, k)]
        rng = np.random.default_rng(6)
        x = sample[rng.integers(0, len(sample), 20_000)]
        y = rng.normal(size=x.shape)
        y -= (y * x).sum(1)[:, None] * x
        y *= np.sqrt(max(0.0, 1 - threshold**2)) / np.maximum(np.linalg.norm(y, axis=1), 1e-12)[:, None]
        (near1, bound1), (near2, bound2) = self.bounds(x)
        own1, own2 = (b[0] for b in self.bounds(threshold * x + y))
        rows = np.arange(len(x))
        # beyond 2 - 2 * threshold no link can lie
        self.radius = min(float(np.quantile(bound1[rows, own1] + bound2[rows, own2], recall)), 2 - 2 * threshold) + 1e-9

    def bounds(self, x: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each half: the nearest centre, and a lower bound of the squared distance to what each centre owns."""
        out = []
        for part, book in zip((x[:, : self.half], x[:, self.half :]), self.books, strict=True):
            d = squared(part, book)
            near = d.argmin(1)
            gap = np.sqrt(squared(book[near], book))
            low = (d - d[np.arange(len(d)), near][:, None]) / (2 * np.maximum(gap, 1e-9))
            out.append((near, np.maximum(low, 0) ** 2))
        return out

    def visit(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(own cell of each row; then row and cell of every visit, nearest cells first): the multi-sequence traversal.

        Cells below the own one aren't returned: their vectors come from the other side.
        """
        (near1, bound1), (near2, bound2) = self.bounds(x)
        k = len(self.books[1])
        own = near1 * k + near2
        rows, cells = [], []
        order1, order2 = bound1.argsort(1), bound2.argsort(1)
        for i in range(len(x)):
            place1, place2 = order1[i], order2[i]
            found = np.array(list(traverse(bound1[i, place1].tolist(), bound2[i, place2].tolist(), self.radius)), np.int64).reshape(-1, 2)
            seen = place1[found[:, 0]] * k + place2[found[:, 1]]
            seen = seen[seen >= own[i]]
            rows.append(np.full(len(seen), i))
            cells.append(seen)
        return own, np.concatenate(rows), np.concatenate(cells)


def traverse(first: list[float], second: list[float], most: float) -> Iterator[tuple[int, int]]:
    """The multi-sequence algorithm: pairs of places in two ascending sequences, by ascending sum, while it is at most ``most``."""
    heap = [(first[0] + second[0], 0, 0)]
    while heap:
        cost, i, j = heappop(heap)
        if cost > most:
            return
        yield i, j
        if j + 1 < len(second):  # each pair has one predecessor, so none comes twice
            heappush(heap, (first[i] + second[j + 1], i, j + 1))
        if j == 0 and i + 1 < len(first):
            heappush(heap, (first[i + 1] + second[0], i + 1, 0))


def _lengths(rows, form: np.dtype) -> np.ndarray:
    """Components of each row's vector."""
    return np.array([len(x) // form.itemsize for x in rows.column("vec").to_pylist()], np.int64)


def _matrix(data: list[bytes], form: np.dtype) -> np.ndarray:
    return np.frombuffer(b"".join(data), form).reshape(len(data), -1).astype(np.float64)


def _scaled(data: list[bytes], form: np.dtype) -> np.ndarray:
    """The vectors, each by the power of two that brings its largest component to about one: squares neither vanish nor overflow, and no bit is lost."""
    x = _matrix(data, form)
    return np.ldexp(x, -np.frexp(np.abs(x).max(1))[1][:, None])


def _unit(data: list[bytes], form: np.dtype) -> np.ndarray:
    x = _scaled(data, form)
    return x / np.linalg.norm(x, axis=1)[:, None]


_PLACED = "label string, cid long, copies long, vec binary, cell int, query boolean, guest boolean"


def _place(shared, form: np.dtype):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grids = shared.value
        for batch in batches:
            lengths = _lengths(batch, form)
            for d, at in ((d, at) for d in np.unique(lengths) for at in range(0, int((lengths == d).sum()), 250)):
                part = batch.take(pa.array(np.flatnonzero(lengths == d)[at : at + 250]))
                cell, row, visits = grids[int(d)].visit(_unit(part.column("vec").to_pylist(), form))
                take = np.concatenate([np.arange(len(cell)), row])
                rows = part.take(pa.array(take))
                at_cell, query = np.concatenate([cell, visits]), np.concatenate([np.zeros(len(cell), bool), np.ones(len(row), bool)])
                placed = [pa.array(at_cell, pa.int32()), pa.array(query), pa.array(at_cell != cell[take])]
                yield pa.record_batch([*(rows.column(c) for c in ("label", "cid", "copies", "vec")), *placed], names=["label", "cid", "copies", "vec", "cell", "query", "guest"])

    return run


def _packed(form: np.dtype, names: tuple[str, ...], out: str):
    """Those columns, and the vector as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = [np.array(x, form).tobytes() for x in batch.column("vec").to_pylist()]
            yield pa.record_batch([*(batch.column(c) for c in names), pa.array(vectors, pa.binary())], names=[*names, out])

    return run


def _compare(threshold: float, form: np.dtype):
    def run(table: pa.Table) -> pa.Table:
        groups: dict[tuple, tuple[list, list]] = {}
        for *key, query, cid, copies, vec, guest in zip(*(table.column(c).to_pylist() for c in ("label", "cell", "a", "b", "query", "cid", "copies", "vec", "guest")), strict=True):
            groups.setdefault(tuple(key), ([], []))[query].append((cid, copies, vec, guest))
        node, links, a, b = [], [], [], []
        up: dict[int, int] = {}

        def find(x: int) -> int:
            while (p := up.setdefault(x, x)) != x:
                up[x] = x = up[p]
            return x

        for held, seeking in groups.values():
            if not held or not seeking:
                continue
            ids, others = np.array([r[0] for r in seeking]), np.array([r[0] for r in held])
            x, y = (_scaled([r[2] for r in side], form) for side in (seeking, held))
            cosine = (x @ y.T) / (np.linalg.norm(x, axis=1)[:, None] * np.linalg.norm(y, axis=1))
            near = (cosine >= threshold) & (ids[:, None] != others)
            counts = near @ np.array([r[1] for r in held], dtype=np.int64)
            back = np.array([r[1] * r[3] for r in seeking], dtype=np.int64) @ near
            for who, count in ((ids, counts), (others, back)):
                node.extend(who[count > 0].tolist())
                links.extend(count[count > 0].tolist())
            for k in np.flatnonzero(counts):
                for j in np.flatnonzero(near[k]):
                    p, q = find(int(ids[k])), find(int(others[j]))
                    if p != q:
                        up[max(p, q)] = min(p, q)
                        a.append(int(ids[k]))
                        b.append(int(others[j]))
        return pa.table({"a": pa.array(node + a, pa.int64()), "b": pa.array([None] * len(node) + b, pa.int64()), "n": pa.array(links + [None] * len(a), pa.int64())})

    return run


def near_duplicates(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = THRESHOLD, recall: float = RECALL, sample: int = SAMPLE) -> DataFrame:
    """Returns id, n_links, component_id, kept."""
    spark = table.sparkSession
    v = F.col(vector_col)
    single = table.schema[vector_col].dataType == T.ArrayType(T.FloatType(), table.schema[vector_col].dataType.containsNull)
    form = np.dtype("<f4" if single else "<f8")
    rows = table.select(F.col(id_col).cast("bigint").alias("id"), F.col(label_col).cast("string").alias("label"), F.transform(v.cast("array<double>"), lambda x: x + F.lit(0.0)).alias("vec"))
    fine = F.coalesce(F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("vec", lambda x: x != 0), F.lit(False))
    valid = fine & F.col("label").isNotNull() & F.col("id").isNotNull()
    # only vectors of one length are compared: the length is part of the label
    good = rows.where(valid).withColumn("label", F.concat_ws(":", F.size("vec"), "label"))
    classes = stored(good.groupBy("label", "vec").agg(F.min("id").alias("cid"), F.count(F.lit(1)).alias("copies")).mapInArrow(_packed(form, ("label", "cid", "copies"), "vec"), "label string, cid long, copies long, vec binary"))
    length = (F.octet_length("vec") / form.itemsize).cast("int")
    sizes = {r["d"]: (r["n"], r["crowd"]) for r in classes.groupBy(length.alias("d"), "label").count().groupBy("d").agg(F.sum("count").alias("n"), F.max("count").alias("crowd")).collect()}
    if not sizes:
        return rows.select(F.col("id").alias(id_col), F.lit(0).cast("bigint").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    total = sum(n for n, _ in sizes.values())
    grids = {}
    for d, (n, crowd) in sizes.items():
        centres = int(min(MOST_CENTRES, max(8, (crowd / OCCUPANCY) ** 0.5)))
        wanted = max(sample * n / total, min(n, max(LEAST_SAMPLE, 8 * centres)))
        share = F.shiftrightunsigned(F.xxhash64("cid", "vec"), 1) < F.lit(min(2**63 - 1, int(wanted / n * 2**63)))
        chosen = [bytes(r["vec"]) for r in classes.where((length == d) & (share if n > wanted else F.lit(True))).select("vec").collect()]
        grids[d] = Grid(_unit(chosen, form), centres, threshold, recall)

    placed = stored(classes.mapInArrow(_place(spark.sparkContext.broadcast(grids), form), _PLACED))
    crowds = placed.groupBy("label", "cell").agg(*(F.ceil(F.sum((F.col("query") == q).cast("int")) / PART).cast("int").alias(name) for name, q in (("parts_a", False), ("parts_b", True))))
    crowds = crowds.where("parts_a > 0 and parts_b > 0")
    spread = placed.join(crowds, ["label", "cell"])

    def across(own: str, other: str) -> DataFrame:
        side = spread.where(F.col("query") == F.lit(own == "b"))
        mine = F.pmod(F.xxhash64("cid"), F.col(f"parts_{own}")).cast("int").alias(own)
        return side.select("label", "cell", "query", "cid", "copies", "vec", "guest", mine, F.explode(F.sequence(F.lit(0), F.col(f"parts_{other}") - 1)).alias(other))

    blocks = across("a", "b").unionByName(across("b", "a"))
    bundles = max(256, total // 1000)
    found = stored(blocks.groupBy(F.pmod(F.xxhash64("label", "cell", "a", "b"), F.lit(bundles)).alias("bundle")).applyInArrow(_compare(threshold, form), "a long, b long, n long"))
    links = found.where("n is not null").groupBy(F.col("a").alias("cid")).agg(F.sum("n").alias("links"))
    roots = components(found.where("b is not null").select("a", "b")).select(F.col("node").alias("cid"), "root")
    known = classes.select("label", "vec", "cid", "copies").join(links, "cid", "left").join(roots, "cid", "left")
    known = known.select(_key("vec"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"), F.coalesce("root", "cid").alias("root"))
    heavy = heavy_keys(classes.select(_key("vec"), "copies"), "key", "copies")
    out = spread_join(good.select("id", "label", "vec").mapInArrow(_packed(form, ("id", "label"), "key"), "id long, label string, key binary").select("id", _key("key")), known, "key", F.col("id"), heavy)
    alone = rows.where(~valid).select("id", F.lit(0).cast("bigint").alias("links"), F.col("id").alias("root"))
    every = out.select("id", "links", "root").unionByName(alone)
    return every.select(F.col("id").alias(id_col), F.col("links").cast("bigint").alias("n_links"), F.col("root").alias("component_id"), F.coalesce(F.col("id") == F.col("root"), F.lit(True)).alias("kept"))


def _key(vector: str) -> Column:
    """Label and vector as one binary key."""
    return F.concat(F.col("label").cast("binary"), F.lit(bytearray([0])), F.col(vector)).alias("key")


def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
