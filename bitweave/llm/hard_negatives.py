"""Hard-negative mining by a two-dimensional block matrix multiply (SUMMA).

Vectors are quantised to integers.  Anchors and rows are cut into blocks, and the
dimensions into chunks; a cell of the grid (anchor block, row block, chunk)
multiplies its two panels, the shuffle adds the partial int64 tiles of a block
pair, and a tile gives away only the best few rows of each anchor and window.

Two products are needed, since a window is known only after the positives are.
The first one meets anchors and rows of the same label and keeps each anchor's
best; the second one meets all anchors with all rows, and keeps for each anchor
and positive the best rows of other labels whose score lies in the window
[low * positive, high * positive] / 100.  Rows are ordered by (length, label,
id), so that blocks are slices of one order, whatever a label holds; every cell is
a group of two panels, and no group grows with the table.

Partial tiles travel as int64 in as few bytes as the largest needs (zigzag, byte
planes).  Products are exact: in floating point while all sums stay under 2^53,
in int64 beyond.

Defined results: rows whose id, label or vector is null, or whose vector has null
or non-finite components, take no part; nor do quantised vectors of a norm of 2^28
or more, whose scores (times 100) could pass 64 bits; vectors of different lengths
have no score; rows of one id are not each other's positives or negatives;
otherwise each repeated row counts by itself; anchors without positives and
windows without negatives give no row; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._blocks import stored
from ._running import running

ANCHORS = 256
ROWS = 2048
CHUNK = 32
MOST_CHUNKS = 4
_U = np.uint64


def packed(tile: np.ndarray) -> bytes:
    """int64 values as zigzag byte planes, as many as the largest needs."""
    z = ((tile << 1) ^ (tile >> 63)).ravel().astype(_U)
    width = max(1, (int(z.max(initial=0)).bit_length() + 7) // 8)
    return np.ascontiguousarray(z.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def unpacked(data: bytes, shape: tuple[int, int]) -> np.ndarray:
    n = shape[0] * shape[1]
    planes = np.zeros((n, 8), np.uint8)
    planes[:, : len(data) // n] = np.frombuffer(data, np.uint8).reshape(-1, n).T
    z = planes.reshape(-1).view("<u8").astype(_U)
    return ((z >> _U(1)).astype(np.int64) ^ -(z & _U(1)).astype(np.int64)).reshape(shape)


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T of integer matrices, exactly."""
    x, y = a.astype(np.float64), b.astype(np.float64)
    if np.sqrt((x**2).sum(1).max(initial=0) * (y**2).sum(1).max(initial=0)) < 2**52:
        return (x @ y.T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


_WINDOWS = "array<struct<positive_id: bigint, score: bigint>>"
_CELL = f"length int, label bigint, i bigint, j bigint, k int, rows boolean, members array<struct<number: bigint, id: bigint, label: bigint, windows: {_WINDOWS}>>, pieces array<array<int>>"
_TILE = f"length int, label bigint, i bigint, j bigint, tile binary, anchors array<struct<number: bigint, id: bigint, label: bigint, windows: {_WINDOWS}>>, others array<struct<number: bigint, id: bigint, label: bigint, windows: {_WINDOWS}>>"


def _matrix(pieces: pa.ListScalar) -> np.ndarray:
    return np.asarray(pieces.values.flatten().to_numpy(), np.int64).reshape(len(pieces.values), -1) if len(pieces.values) else np.zeros((0, 0), np.int64)


def _multiply(schema: pa.Schema):
    def run(panels: pa.Table) -> pa.Table:
        sides = {x: k for k, x in enumerate(panels.column("rows").to_pylist())}
        if len(sides) < 2:  # one of the blocks is empty
            return schema.empty_table()
        a, b = sides[False], sides[True]
        tile = product(_matrix(panels.column("pieces")[a]), _matrix(panels.column("pieces")[b]))
        key = [panels.column(c).combine_chunks().slice(a, 1) for c in ("length", "label", "i", "j")]
        own = [panels.column("members").combine_chunks().slice(x, 1) for x in (a, b)]
        return pa.Table.from_arrays([*key, pa.array([packed(tile)]), *own], schema=schema)

    return run


def _numbers(members: pa.ListScalar, field: str) -> np.ndarray:
    return members.values.field(field).to_numpy(zero_copy_only=False)


def _added(tiles: Iterator[pa.RecordBatch]) -> tuple[np.ndarray, pa.ListScalar, pa.ListScalar]:
    """The sum of the partial tiles of a block pair, at most ``MOST_CHUNKS``, and the members of both blocks, which come with the first chunk's."""
    parts, anchors, others = [], None, None
    for batch in tiles:
        for data, left, right in zip(batch.column("tile"), batch.column("anchors"), batch.column("others"), strict=True):
            parts.append(data.as_py())
            if left.is_valid:
                anchors, others = left, right
    shape = (len(anchors.values), len(others.values))
    total = np.zeros(shape, np.int64)
    for data in parts:
        total += unpacked(data, shape)
    return total, anchors, others


_BEST = pa.schema([("number", pa.int64()), ("anchor_id", pa.int64()), ("id", pa.int64()), ("score", pa.int64())])
_FOUND = pa.schema([("number", pa.int64()), ("anchor_id", pa.int64()), ("place", pa.int32()), ("positive_id", pa.int64()), ("positive_score", pa.int64()), ("negative_id", pa.int64()), ("negative_score", pa.int64())])


def _best(most: int):
    def run(tiles: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores, anchors, others = _added(tiles)
        ids, own = _numbers(others, "id"), _numbers(anchors, "id")
        out = []
        for row, anchor, number in zip(scores, own, _numbers(anchors, "number"), strict=True):
            at = np.flatnonzero(ids != anchor)
            if len(at) > most:  # ties with the last place stay, to be told apart by id
                at = at[row[at] >= np.partition(row[at], -most)[-most]]
            at = at[np.lexsort((ids[at], -row[at]))][:most]
            out.append((np.full(len(at), number), np.full(len(at), anchor), ids[at], row[at]))
        yield pa.record_batch([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], schema=_BEST)

    return run


def _in_windows(most: int, low: int, high: int):
    def run(tiles: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores, anchors, others = _added(tiles)
        ids, labels, own = _numbers(others, "id"), _numbers(others, "label"), _numbers(anchors, "id")
        number, label = _numbers(anchors, "number"), _numbers(anchors, "label")
        out = [[np.zeros(0, np.int64)] * 7]
        for i, windows in enumerate(anchors.values.field("windows").to_pylist()):
            if not windows:
                continue
            row = scores[i] * 100
            at = np.flatnonzero((labels != label[i]) & (ids != own[i]) & (row >= low * min(w["score"] for w in windows)))
            at = at[np.lexsort((ids[at], -row[at]))]
            falling = -row[at]
            for place, w in enumerate(windows):
                first, last = np.searchsorted(falling, -high * w["score"]), np.searchsorted(falling, -low * w["score"], side="right")
                part = at[first : min(last, first + most)]
                if len(part):
                    same = [number[i], own[i], place, w["positive_id"], w["score"]]
                    out.append([*(np.full(len(part), x, np.int64) for x in same), ids[part], scores[i, part]])
        yield pa.record_batch([pa.array(np.concatenate(x)).cast(t) for x, t in zip(zip(*out, strict=True), _FOUND.types, strict=True)], schema=_FOUND)

    return run


def _panels(rows: DataFrame, number: str, size: int, label: Column, windows: Column) -> DataFrame:
    """A row per (length, label, block, chunk): the block's members (with the first chunk only) and their pieces of that chunk."""
    chunks = F.greatest(F.lit(1), F.least(F.lit(MOST_CHUNKS), F.ceil(F.col("length") / CHUNK).cast("int")))
    wide = F.greatest(F.lit(1), F.ceil(F.col("length") / chunks).cast("int"))
    cut = rows.select("length", label.alias("_label"), F.floor(F.col(number) / size).alias("block"), F.struct(F.col(number).alias("number"), "id", "label", windows.cast(_WINDOWS).alias("windows")).alias("_member"), "vec", wide.alias("_wide"), F.explode(F.sequence(F.lit(0), chunks - 1)).alias("k"))
    cut = cut.withColumn("_piece", F.slice("vec", F.col("k") * F.col("_wide") + 1, F.col("_wide")))
    group = cut.groupBy("length", "_label", "block", "k").agg(F.array_sort(F.collect_list(F.struct("_member.number", "_member", "_piece"))).alias("_all"))
    return group.select("length", F.col("_label").alias("label"), "block", "k", F.when(F.col("k") == 0, F.col("_all._member")).alias("members"), F.col("_all._piece").alias("pieces"))


def _cells(anchors: DataFrame, rows: DataFrame) -> DataFrame:
    """Sends each anchor panel to every row block of its length (and label), and each row panel to every anchor block."""
    ranges = [x.groupBy("length", "label").agg(F.min("block").alias("_from"), F.max("block").alias("_to")) for x in (anchors.where("k = 0"), rows.where("k = 0"))]
    same = lambda x, y: x.join(y.select(F.col("length").alias("_length"), F.col("label").alias("_of"), "_from", "_to"), (F.col("length") == F.col("_length")) & F.col("label").eqNullSafe(F.col("_of")))
    every = F.explode(F.sequence("_from", "_to"))
    left = same(anchors, ranges[1]).select("length", "label", F.col("block").alias("i"), every.alias("j"), "k", F.lit(False).alias("rows"), "members", "pieces")
    right = same(rows, ranges[0]).select("length", "label", every.alias("i"), F.col("block").alias("j"), "k", F.lit(True).alias("rows"), "members", "pieces")
    return left.unionByName(right)


def _tiles(anchors: DataFrame, rows: DataFrame) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    cells = _cells(anchors, rows)
    return cells.groupBy("length", "label", "i", "j", "k").applyInArrow(_multiply(to_arrow_schema(StructType.fromDDL(_TILE))), _TILE)


def quantised(vectors: DataFrame, id_col: str, label: Column, vec_col: str, scale: float) -> DataFrame:
    """(id, label, length, vec of ints) of the rows that take part."""
    x = F.col(f"`{vec_col}`")
    whole = F.transform(x, lambda v: F.floor(v.cast("double") * scale))
    good = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) < F.lit(float(1 << 28))))
    norm = F.aggregate("_whole", F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double"))
    rows = vectors.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), label.cast("bigint").alias("label"), F.when(good, whole).alias("_whole"))
    rows = rows.where("id IS NOT NULL AND label IS NOT NULL AND _whole IS NOT NULL").where(norm < float(1 << 56))
    return rows.select("id", "label", F.size("_whole").alias("length"), F.transform("_whole", lambda v: v.cast("int")).alias("vec"))


def hard_negatives(rows: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100) -> DataFrame:
    """rows: (id, label, length, vec) of ``quantised``. Returns anchor_id, positive_id, rank, negative_id and both scores."""
    rows = rows.withColumn("_row", F.monotonically_increasing_id()).withColumns({"_one": F.lit(1).cast("bigint"), "_anchor": F.when(is_anchor, 1).otherwise(0).cast("bigint")})
    rows = running(rows, ["length", "label", "id", "_row"], {"number": "_one", "_seen": "_anchor"})
    rows = rows.select("id", "label", "length", "vec", (F.col("number") - 1).alias("number"), (F.col("_seen") - 1).alias("anchor"), F.col("_anchor").alias("is_anchor"))
    anchors, none, any_label = rows.where("is_anchor = 1"), F.lit(None), F.lit(None).cast("bigint")

    same = _tiles(_panels(anchors, "anchor", ANCHORS, F.col("label"), none), _panels(rows, "number", ROWS, F.col("label"), none))
    best = same.groupBy("length", "label", "i", "j").applyInArrow(_best(positives), "number bigint, anchor_id bigint, id bigint, score bigint")
    first = F.row_number().over(Window.partitionBy("number").orderBy(F.desc("score"), "id"))
    best = best.withColumn("_rank", first).where(F.col("_rank") <= positives)
    windows = stored(best.groupBy("number").agg(F.array_sort(F.collect_list(F.struct("_rank", F.col("id").alias("positive_id"), "score"))).alias("_windows")))

    searching = anchors.join(windows.withColumnRenamed("number", "anchor"), "anchor")
    to = F.transform("_windows", lambda w: F.struct(w.positive_id.alias("positive_id"), w.score.alias("score")))
    pairs = _tiles(_panels(searching, "anchor", ANCHORS, any_label, to), _panels(rows, "number", ROWS, any_label, none))
    found = pairs.groupBy("length", "label", "i", "j").applyInArrow(_in_windows(negatives, low, high), "number bigint, anchor_id bigint, place int, positive_id bigint, positive_score bigint, negative_id bigint, negative_score bigint")
    rank = F.row_number().over(Window.partitionBy("number", "place").orderBy(F.desc("negative_score"), "negative_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= negatives).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.col("label").cast("bigint")
    label = F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label)
    rows = quantised(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id", label, "embedding", 256.0)
    return hard_negatives(rows, F.col("id") % 100 == 0)


ORACLE_SQL = """
WITH v AS (SELECT CAST(vec_id AS BIGINT) AS id, CASE WHEN vec_id % 7 = 0 THEN (CAST(label AS BIGINT) + 1) % 10 ELSE CAST(label AS BIGINT) END AS label, list_transform(CAST(embedding AS DOUBLE[]), lambda x: floor(256 * x)) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.id AS anchor, a.label AS own, b.id AS id, b.label AS label, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score FROM v a JOIN v b ON a.id % 100 = 0 AND a.id <> b.id AND len(a.q) = len(b.q)),
p AS (SELECT anchor, id AS positive, score FROM s WHERE label = own QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, id) <= 5)
SELECT p.anchor AS anchor_id, p.positive AS positive_id, CAST(row_number() OVER (PARTITION BY p.anchor, p.positive ORDER BY s.score DESC, s.id) AS INT) AS rank, s.id AS negative_id, p.score AS positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor = p.anchor AND s.label <> s.own AND 80 * p.score <= 100 * s.score AND 100 * s.score <= 100 * p.score
QUALIFY rank <= 5
"""
