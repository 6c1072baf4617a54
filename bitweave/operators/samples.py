"""Sample tables of ISO base media: chunks, runs, offsets and key flags as joins and windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ordered import with_last_known, with_running_sum


def expand_runs(runs: DataFrame, chunks: DataFrame) -> DataFrame:
    """runs (track, first_chunk, per_chunk) over chunks (track, chunk, chunk_offset): each chunk with its sample count.

    The run in force is the last one that starts at or before the chunk: an
    equi-join and a carried value, not a range join.
    """
    starts = runs.groupBy("track", F.col("first_chunk").alias("chunk")).agg(F.max("per_chunk").cast("bigint").alias("_own"))
    both = chunks.select("track", "chunk", "chunk_offset").join(starts, ["track", "chunk"], "full")  # a run may start at a chunk that is missing
    return with_last_known(both, {"per_chunk": F.col("_own")}, "chunk", ("track",)).where("chunk_offset is not null").drop("_own")


def sample_table(runs: DataFrame, chunks: DataFrame, sizes: DataFrame, keys: DataFrame | None = None) -> DataFrame:
    """track, sample, chunk, offset, size, is_key. sizes (track, sample, size), samples from 1; keys (track, sample): none given means every sample is a key."""
    filled = with_running_sum(expand_runs(runs, chunks), {"_to": F.col("per_chunk")}, "chunk", ("track",)).withColumn("first", F.col("_to") - F.col("per_chunk") + 1)
    placed = filled.select("track", "chunk", "chunk_offset", F.explode(F.when(F.col("per_chunk") > 0, F.sequence("first", F.col("first") + F.col("per_chunk") - 1))).alias("sample"))
    rows = placed.join(sizes, ["track", "sample"])  # a last chunk that is only partly filled keeps what it has
    inside = Window.partitionBy("track", "chunk").orderBy("sample").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("offset", F.col("chunk_offset") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
    if keys is None:
        rows = rows.withColumn("is_key", F.lit(True))
    else:
        rows = rows.join(keys.select("track", "sample", F.lit(True).alias("_key")).distinct(), ["track", "sample"], "left").withColumn("is_key", F.coalesce("_key", F.lit(False)))
    return rows.select("track", "sample", "chunk", "offset", "size", "is_key")


def _numbered_runs(runs: DataFrame, value: str) -> DataFrame:
    """runs (track, run, n, value) with ``first``, the number of each run's first sample, and ``start``, the sum of the values before it."""
    sums = with_running_sum(runs, {"_to": F.col("n"), "_sum": F.col("n") * F.col(value)}, "run", ("track",))
    return sums.where("n > 0").select("track", value, "n", (F.col("_to") - F.col("n") + 1).alias("first"), (F.col("_sum") - F.col("n") * F.col(value)).alias("start"))


def expand_times(runs: DataFrame) -> DataFrame:
    """runs (track, run, n, delta): one row per sample with its decoding time, the sum of the deltas before it."""
    flat = _numbered_runs(runs, "delta").select("track", "start", "delta", F.posexplode(F.sequence(F.col("first"), F.col("first") + F.col("n") - 1)).alias("k", "sample"))
    return flat.select("track", "sample", (F.col("start") + F.col("k") * F.col("delta")).alias("dts"))


def moved_offsets(boxes: DataFrame, removed: DataFrame, file_col: str | None = None) -> DataFrame:
    """boxes (box, offset, size) in file order without removed (box): each kept box with its new offset and shift; ``file_col`` names the file of a box where there are several."""
    file = [file_col] if file_col else []
    kept = boxes.join(removed, [*file, "box"], "left_anti")
    w = Window.partitionBy(*file).orderBy("offset").rowsBetween(Window.unboundedPreceding, -1)  # top-level boxes of a file: a handful
    return kept.withColumn("new_offset", F.coalesce(F.sum("size").over(w), F.lit(0))).withColumn("shift", F.col("offset") - F.col("new_offset"))


def composition_times(times: DataFrame, offsets: DataFrame) -> DataFrame:
    """times of ``expand_times``, offsets (track, run, n, offset) in decoding order: track, sample, dts, cts; a sample without an offset is shown when it is decoded."""
    shown = _numbered_runs(offsets, "offset").select("track", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("n") - 1)).alias("sample"), "offset")
    return times.join(shown, ["track", "sample"], "left").select("track", "sample", "dts", (F.col("dts") + F.coalesce("offset", F.lit(0))).alias("cts"))
