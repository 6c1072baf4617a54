"""Document blocks, hash buckets and the compact exchange between them.

Counting every shingle or window of a corpus as one shuffled row each would
move several times the corpus.  Instead documents are gathered into blocks of a
bounded size; a block sends each hash bucket ONE row that holds its distinct
sorted hashes, delta-coded (about six bytes a hash); the bucket answers each
block with one bit, or one count, per hash.  Every step is a plain Spark shuffle
over rows that can be recomputed, and no step holds more than one block or one
bucket.  Buckets grow in number with the blocks, so that neither grows with the
corpus; a block never sends more rows than it has hashes.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.shared import shared_folder as shared_dir

BLOCK_BYTES = 6 << 20
LEAST_BLOCKS = 64
HEAVY = 1000
SALTS = 64
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
_U = np.uint64


def block_count(n_bytes: int, block_bytes: int = BLOCK_BYTES) -> int:
    return max(LEAST_BLOCKS, math.ceil(n_bytes / block_bytes))


def bucket_bits(blocks: int) -> int:
    """Buckets are a power of two, at least as many as there are blocks: each holds a block's worth of hashes at any size."""
    return max(7, math.ceil(math.log2(max(1, blocks))))


def text_bytes(df: DataFrame, text_col: str) -> int:
    return int(df.agg(F.sum(F.octet_length(F.col(text_col)).cast("bigint"))).first()[0] or 0)


def encode(values: np.ndarray) -> bytes:
    """Sorted distinct 64-bit values: the first one, then the gaps in as few bytes each as the largest needs."""
    if not len(values):
        return b""
    gaps = np.diff(values)
    width = max(1, (int(gaps.max()).bit_length() + 7) // 8) if len(gaps) else 1
    planes = gaps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]
    return bytes([width]) + int(values[0]).to_bytes(8, "little") + planes.tobytes()


def decode(data: bytes) -> np.ndarray:
    if not data:
        return np.zeros(0, _U)
    width = data[0]
    planes = np.frombuffer(data, np.uint8, offset=9).reshape(-1, width)
    out = np.zeros((len(planes) + 1, 8), np.uint8)
    out[1:, :width] = planes
    out = out.reshape(-1).view("<u8").astype(_U)
    out[0] = int.from_bytes(data[1:9], "little")
    return np.cumsum(out, dtype=_U)


def by_bucket(values: np.ndarray, bits: int) -> list[tuple[int, np.ndarray]]:
    """Sorted values cut where their top ``bits`` change: (bucket, values)."""
    top = (values >> _U(64 - bits)).astype(np.int64)
    cut = np.flatnonzero(np.diff(top)) + 1
    return [(int(part[0] >> _U(64 - bits)), part) for part in np.split(values, cut) if len(part)]


def id_blocks(df: DataFrame, id_col: str, blocks: int, salt: Column) -> Column:
    """A block number that never falls as the id grows: at most 256 approximate quantiles, each cut evenly by id. Null ids go to any block, by ``salt``."""
    n_q = min(256, blocks)
    inner = math.ceil(blocks / n_q)
    x = F.col(id_col)
    row = df.agg(F.min(x), F.max(x), F.percentile_approx(x, [k / n_q for k in range(1, n_q)] or [0.5], 4000)).first()
    anywhere = F.pmod(F.xxhash64(salt), F.lit(blocks)).cast("int")
    if row[0] is None:
        return anywhere
    bounds = sorted({row[0], *row[2], row[1] + 1})

    def tree(lo: int, hi: int) -> Column:
        if hi - lo == 1:
            a, width = bounds[lo], max(1, bounds[hi] - bounds[lo])
            step = F.floor((x - F.lit(a)).cast("double") * F.lit(inner / width)).cast("int")
            return F.lit(lo * inner) + F.greatest(F.lit(0), F.least(step, F.lit(inner - 1))) if inner > 1 else F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(x < F.lit(bounds[mid]), tree(lo, mid)).otherwise(tree(mid, hi))

    return F.when(x.isNull(), anywhere).otherwise(tree(0, len(bounds) - 1)).cast("int")


def bounded_batches(spark: SparkSession) -> SparkSession:
    """Sends rows to Python 1,000 at a time rather than 10,000 (the default), which texts of a few KB make 20 MB buffers of; a number set by the user stays."""
    if spark.conf.get(_BATCH) == "10000":
        spark.conf.set(_BATCH, "1000")
    return spark


def stored(df: DataFrame, at: str | None = None) -> DataFrame:
    """Writes a table to the shared folder and reads it back: lineage ends there, and a lost executor loses nothing."""
    spark = df.sparkSession
    at = at or shared_dir(spark)
    schema = df.schema
    df.write.mode("overwrite").option("compression", "zstd").parquet(at)
    out = spark.read.schema(schema).parquet(at)
    out._stored_at = at
    return out


def forget(*tables: DataFrame) -> None:
    """Deletes tables of ``stored`` that nothing reads any more, such as those of earlier rounds."""
    for df in tables:
        at = getattr(df, "_stored_at", None)
        if at:
            path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(at)
            path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def heavy_keys(counts: DataFrame, key: str, n: str) -> list:
    """Keys that hold more than a ``HEAVY``-th of all rows: fewer than ``HEAVY``, whatever the table holds. counts: a row per key."""
    total = counts.agg(F.sum(n)).first()[0] or 0
    return [r[0] for r in counts.where(F.col(n) * F.lit(HEAVY) > F.lit(max(total, 100 * HEAVY))).select(key).collect()]


def spread_join(rows: DataFrame, classes: DataFrame, key: str, salt: Column, heavy: list, how: str = "inner") -> DataFrame:
    """Joins rows with a table of one row per key; rows of a heavy key are dealt over ``SALTS`` parts, and its one row is sent to each."""
    if not heavy:
        return rows.join(classes, key, how)
    is_heavy = F.coalesce(F.col(key).isin(heavy), F.lit(False))
    left = rows.withColumn("_salt", F.when(is_heavy, F.pmod(F.xxhash64(salt), F.lit(SALTS)).cast("int")).otherwise(0))
    right = classes.withColumn("_salt", F.explode(F.when(is_heavy, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))))
    return left.join(right, [key, "_salt"], how).drop("_salt")
