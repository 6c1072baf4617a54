"""Sharding: minimax contiguous partition of groups of equal texts.

Groups of equal texts are atomic.  They are ordered by a digest of the text and
summed into at most ``shards * ATOMS`` ordered atoms (a group is never divided
between atoms), so the driver sees a bounded list of sizes however large the
corpus is.  The smallest feasible shard capacity over that ordered list is found
by binary search, each capacity checked greedily; cuts are then made there, each
as late as needed and no later than the capacity allows, so that sizes are near
equal and no shard is left empty while atoms remain.

The main path is DataFrame operations only.  A row's shard is an expression over
its own text and the cuts; its slot is its rank inside a bounded chunk of the
shard plus the sizes of the chunks before, so no task holds a whole shard.

Defined results: a null text is an empty one (size 16, crc 0, same group); ids may repeat (each row has its own slot); an empty table gives an
empty result; columns other than id and text are ignored.
"""

from __future__ import annotations

from bisect import bisect_right
from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._blocks import stored

SHARDS = 40
ATOMS = 4096
OVERHEAD = 16


def shards_needed(ends: list[int], capacity: int, start: int = 0) -> int:
    """How many shards the atoms from ``start`` on take if each is filled as far as the capacity goes. ends: running sums."""
    n = 0
    while start < len(ends):
        start = bisect_right(ends, (ends[start - 1] if start else 0) + capacity)
        n += 1
    return n


def smallest_capacity(sizes: list[int], shards: int) -> int:
    """The least capacity with which contiguous atoms fit into so many shards."""
    ends = list(accumulate(sizes))
    low, high = max(max(sizes), -(-ends[-1] // shards)), ends[-1]
    while low < high:
        middle = (low + high) // 2
        if shards_needed(ends, middle) <= shards:
            high = middle
        else:
            low = middle + 1
    return low


def balanced_cuts(sizes: list[int], shards: int) -> list[int]:
    """Cut positions under the smallest capacity: a shard closes nearest to its share of what is left, and never later than the rest allows."""
    ends = list(accumulate(sizes))
    capacity, cuts, at, done = smallest_capacity(sizes, shards), [], 0, 0
    for left in range(shards, 1, -1):
        share = done + (ends[-1] - done) / left
        stop = bisect_right(ends, done + capacity)
        near = max(at, bisect_right(ends, share))
        if near < stop and near < len(ends) and ends[near] - share < share - (ends[near - 1] if near else 0):
            near += 1
        near = min(near, stop)
        low, high = near, stop  # the rest must fit into the shards that are left
        while low < high:
            middle = (low + high) // 2
            if shards_needed(ends, capacity, middle) <= left - 1:
                high = middle
            else:
                low = middle + 1
        near = low
        cuts.append(near)
        at, done = near, ends[near - 1] if near else 0
    return cuts


def assign_shards(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS, atoms: int = ATOMS) -> DataFrame:
    """Returns id, size, text_crc32, law, shard, slot, grown_shard (null: the law is ``bytes``), atom."""
    n_atoms = shards * atoms
    utf8 = F.col(text_col).cast("binary")
    atom = _atom(text_col, n_atoms)
    rows = docs.select(F.col(id_col), (F.coalesce(F.octet_length(utf8), F.lit(0)) + F.lit(OVERHEAD)).cast("bigint").alias("size"), F.coalesce(F.crc32(utf8), F.lit(0)).cast("bigint").alias("text_crc32"), atom.alias("atom"))
    sums = rows.groupBy("atom").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")).collect()  # at most shards * atoms rows
    found = sorted((r["atom"], r["size"]) for r in sums)
    cuts = [found[k][0] if k < len(found) else n_atoms for k in (balanced_cuts([s for _, s in found], shards) if found else [])]
    placed = rows.withColumn("shard", _shard(F.col("atom"), cuts))
    chunks = max(64, sum(r["n"] for r in sums) // (shards * 250_000))
    placed = placed.withColumn("_chunk", (F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(0)) % chunks).cast("int"))
    counts = placed.groupBy("shard", "_chunk").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("shard").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1))
    counts = stored(counts.select("shard", "_chunk", F.coalesce(before, F.lit(0)).alias("_before")))
    rank = F.row_number().over(Window.partitionBy("shard", "_chunk").orderBy("atom", id_col, "text_crc32"))
    ranked = placed.withColumn("_rank", rank).join(counts, ["shard", "_chunk"])
    return ranked.select(F.col(id_col), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("_before") + F.col("_rank") - 1).cast("bigint").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "atom")


def _shard(atom: Column, cuts: list[int]) -> Column:
    """How many cuts lie at or before the atom, as a balanced tree of comparisons."""

    def tree(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(atom < F.lit(cuts[middle]), tree(low, middle)).otherwise(tree(middle + 1, high))

    return tree(0, len(cuts)).cast("int")


def _atom(text_col: str, n_atoms: int) -> Column:
    digest = F.md5(F.coalesce(F.col(text_col).cast("binary"), F.lit(bytearray())))
    return (F.conv(F.substring(digest, 1, 12), 16, 10).cast("bigint") % n_atoms).cast("int")


def write_shards(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS, atoms: int = ATOMS) -> None:
    """Writes the documents themselves, a folder for each shard. A shard follows from the atom, of which there are ``shards * atoms``."""
    homes = stored(assign_shards(docs, id_col, text_col, shards, atoms).select("atom", "shard").distinct()).select(F.col("atom").alias("_atom"), F.col("shard").alias("_shard"))
    placed = docs.withColumn("_atom", _atom(text_col, shards * atoms)).join(F.broadcast(homes), "_atom").drop("_atom")
    placed.write.partitionBy("_shard").parquet(path)


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = assign_shards(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
