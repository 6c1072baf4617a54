"""Removal of boxes from files: sizes, places and the offsets that point at moved bytes.

Every change to a file is an edit: from a place on, all bytes stand further on (or
back) by so much.  A box that is removed is an edit at its end; a table that needs
wider entries, or a box that needs a wider size, is one where it grows.  Where a
byte of the old file comes to stand is a sum over the edits at or before it, and
how much a box has grown is the difference of that sum at its two ends, however
deep it lies in the tree: one ordered pass, no walk over levels.  Offsets that no
longer fit 32 bits make their table wider, which moves what follows, which may
make other tables wider: edits are added until a pass adds none.  They are never
taken back, so this ends; each pass adds all that is known to be needed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.byte_streams import parts_of, read_ranges, write_stream
from .ordered import SPAN, with_lag, with_running_sum
from .shared import written

#: The first number that 32 bits don't hold.
LIMIT = 1 << 32
#: Entries of an offset table that are written as one piece.
_ENTRIES = 1024


def shifted(points: DataFrame, edits: DataFrame, by: tuple[str, ...] = (), at: str = "at", span: int = SPAN, large: DataFrame | None = None) -> DataFrame:
    """Adds shift: the sum of delta over edits (by, at, delta) of the point's file at or before its place."""
    marks = points.select(*by, (F.col(at) * 2 + 1).alias("_o"), F.lit(0).cast("bigint").alias("_d"), F.struct(*points.columns).alias("_p"))
    moves = edits.select(*by, (F.col("at") * 2).alias("_o"), F.col("delta").cast("bigint").alias("_d"), F.lit(None).cast(marks.schema["_p"].dataType).alias("_p"))
    return with_running_sum(marks.unionByName(moves), {"shift": F.col("_d")}, "_o", by, span, large).where("_p is not null").select("_p.*", "shift")


def _edits(rows: DataFrame, by: tuple[str, ...], *changes: tuple[Column, Column]) -> DataFrame:
    """A row for each (place, delta) of each row."""
    both = F.explode(F.array(*(F.struct(at.cast("bigint").alias("at"), delta.cast("bigint").alias("delta")) for at, delta in changes)))
    return rows.select(*by, both.alias("_x")).select(*by, "_x.*")


def without_boxes(boxes: DataFrame, removed: DataFrame, chunks: DataFrame, by: tuple[str, ...] = (), limit: int = LIMIT, span: int = SPAN) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Files without some boxes and all that is in them: (boxes, chunks, edits) of the new files.

    boxes: by, box, kind, offset, size, header (its bytes, 8 or 16).  removed: by, box.
    chunks: by, box (the stco or co64 that holds it), k, chunk_offset.
    The new boxes have new_offset, new_size and new_header besides; a stco whose offsets reach ``limit`` is a co64, a
    box whose size does has a header of 16 bytes.  The new chunks have new_chunk_offset, null where the chunk's bytes
    are removed.  edits: by, at, delta.
    """
    on = [*by, "box"]
    large = None
    if by:  # places are far apart, so only files of many rows are cut by them: a box has two ends and at most three edits
        rows = boxes.select(*by, F.lit(5).alias("_n")).unionByName(chunks.select(*by, F.lit(1).alias("_n")))
        large = written(rows.groupBy(*by).agg(F.sum("_n").alias("_n")).where(F.col("_n") > span).select(*by))
    marked = written(boxes.select(*on, "kind", "offset", "size", "header").join(removed.select(*on).distinct().withColumn("_gone", F.lit(True)), on, "left"))
    gone = marked.where("_gone")
    # a box is inside a removed one if more of these have begun before it than have ended by then
    inside = _edits(gone, by, (F.col("offset") + 1, F.lit(1)), (F.col("offset") + F.col("size"), F.lit(-1)))
    marked = written(shifted(marked, inside, by, "offset", span, large).where("shift = 0").drop("shift"))
    edits = written(_edits(marked.where("_gone"), by, (F.col("offset") + F.col("size"), -F.col("size"))))
    lost = _edits(marked.where("_gone"), by, (F.col("offset"), F.lit(1)), (F.col("offset") + F.col("size"), F.lit(-1)))
    kept = marked.where("_gone is null").drop("_gone")
    tables = kept.where("kind in ('stco', 'co64')").select(*on)
    chunks = written(shifted(chunks.select(*on, "k", "chunk_offset").join(tables, on), lost, by, "chunk_offset", span, large).withColumnRenamed("shift", "_lost"))
    ends = kept.select(*on, "kind", "offset", "size", "header", F.explode(F.array(F.lit(False), F.lit(True))).alias("_end"))
    ends = written(ends.withColumn("_at", F.when(F.col("_end"), F.col("offset") + F.col("size")).otherwise(F.col("offset"))))
    wide = None
    while True:
        places = shifted(ends, edits, by, "_at", span, large)
        moved = shifted(chunks, edits, by, "chunk_offset", span, large).withColumn("new_chunk_offset", F.when(F.col("_lost") == 0, F.col("chunk_offset") + F.col("shift"))).drop("shift")
        rows = places.groupBy(*on, "kind", "offset", "size", "header").agg(F.max(F.when(~F.col("_end"), F.col("shift"))).alias("_a"), F.max(F.when(F.col("_end"), F.col("shift"))).alias("_b"))
        rows = rows.select(*on, "kind", "offset", "size", "header", (F.col("offset") + F.col("_a")).alias("new_offset"), (F.col("size") + F.col("_b") - F.col("_a")).alias("new_size"))
        top = moved.groupBy(*on).agg(F.max("new_chunk_offset").alias("_top"), F.count(F.lit(1)).alias("_n"))
        rows = rows.join(top, on, "left")
        if wide is not None:
            rows = rows.join(wide, [*on], "left")
        else:
            rows = rows.withColumns({"_table": F.lit(None).cast("boolean"), "_header": F.lit(None).cast("boolean")})
        rows = written(rows)
        more_table = (F.col("kind") == "stco") & F.col("_table").isNull() & (F.col("_top") >= limit)
        more_header = (F.col("header") == 8) & F.col("_header").isNull() & (F.col("new_size") >= limit)
        grown = rows.select(*on, "offset", "size", "_n", F.coalesce(more_table, F.lit(False)).alias("_t"), F.coalesce(more_header, F.lit(False)).alias("_h"), "_table", "_header").where("_t or _h")
        if grown.isEmpty():
            break
        new = _edits(grown.where("_t"), by, (F.col("offset") + F.col("size"), F.col("_n") * 4)).unionByName(_edits(grown.where("_h"), by, (F.col("offset") + 8, F.lit(8))))
        edits = written(edits.unionByName(new))
        true = F.lit(True)
        wide = written(rows.select(*on, F.when(more_table, true).otherwise(F.col("_table")).alias("_table"), F.when(more_header, true).otherwise(F.col("_header")).alias("_header")).where("_table or _header"))
    kind = F.when(F.col("_table"), F.lit("co64")).otherwise(F.col("kind"))
    header = F.when(F.col("_header"), F.lit(16)).otherwise(F.col("header"))
    return rows.select(*on, kind.alias("kind"), "offset", "size", "header", "new_offset", "new_size", header.cast("int").alias("new_header")), moved.drop("_lost"), edits


def _bytes(value: Column, n: int) -> Column:
    return F.lpad(F.hex(value.cast("bigint")), 2 * n, F.lit("0"))


def write_without(spark: SparkSession, source: str, target: str, boxes: DataFrame, removed: DataFrame, chunks: DataFrame, limit: int = LIMIT, split_bytes: int = 1 << 20, span: int = SPAN) -> list[tuple[str, int]]:
    """``without_boxes`` of one file, written to ``target``; returns the (path, bytes) of its parts.

    Headers and offset tables are written anew (entries 1,024 at a time), all else is copied by byte ranges of the
    source, each cut where something new or nothing stands.  A lost chunk's offset is written as 0.
    """
    total = sum(n for _, n in parts_of(source))
    new, moved, edits = without_boxes(boxes, removed, chunks, (), limit, span)
    size32 = F.when(F.col("new_header") == 16, F.concat(_bytes(F.lit(1), 4), F.hex(F.encode("kind", "iso-8859-1")), _bytes(F.col("new_size"), 8))).otherwise(F.concat(_bytes(F.col("new_size"), 4), F.hex(F.encode("kind", "iso-8859-1"))))
    heads = new.select(F.col("new_offset").alias("to"), F.unhex(size32).alias("data"))
    tables = new.where("kind in ('stco', 'co64')")
    numbers = tables.join(moved.groupBy("box").agg(F.count(F.lit(1)).alias("_n")), "box", "left")
    numbers = numbers.select((F.col("new_offset") + F.col("new_header")).alias("to"), F.unhex(F.concat(F.lit("00000000"), _bytes(F.coalesce("_n", F.lit(0)), 4))).alias("data"))
    first = moved.groupBy("box").agg(F.min("k").alias("_first"))
    entries = moved.join(first, "box").join(tables.select("box", "kind", "new_offset", "new_header"), "box").withColumn("k", F.col("k") - F.col("_first"))
    value, width = F.coalesce("new_chunk_offset", F.lit(0)), F.when(F.col("kind") == "co64", 8).otherwise(4)
    entries = entries.select("box", "k", F.floor(F.col("k") / _ENTRIES).alias("_part"), (F.col("new_offset") + F.col("new_header") + 8).alias("_at"), width.alias("_w"), F.when(F.col("kind") == "co64", _bytes(value, 8)).otherwise(_bytes(value, 4)).alias("_x"))
    entries = entries.groupBy("box", "_part", "_at", "_w").agg(F.array_sort(F.collect_list(F.struct("k", "_x"))).alias("_xs"))
    entries = entries.select((F.col("_at") + F.col("_part") * _ENTRIES * F.col("_w")).cast("bigint").alias("to"), F.unhex(F.array_join(F.col("_xs._x"), "")).alias("data"))

    # what is copied stands between what is replaced or removed
    replaced = new.select("offset", F.when(F.col("kind").isin("stco", "co64"), F.col("size")).otherwise(F.col("header")).cast("bigint").alias("n"))
    dropped = edits.where("delta < 0").select((F.col("at") + F.col("delta")).alias("offset"), (-F.col("delta")).alias("n"))
    end = spark.createDataFrame([(total, 0)], "offset long, n long")
    cuts = written(replaced.unionByName(dropped).unionByName(end).withColumn("_stop", F.col("offset") + F.col("n")))
    gaps = with_lag(cuts, {"_start": "_stop"}, "offset", (), span).withColumn("_start", F.coalesce("_start", F.lit(0))).where("_start < offset").select("_start", F.col("offset").alias("_stop"))
    gaps = shifted(written(gaps), edits, (), "_start", span)
    runs = gaps.withColumn("split", F.explode(F.sequence(F.expr(f"_start div {split_bytes}"), F.expr(f"(_stop - 1) div {split_bytes}"))))
    low, high = F.greatest("_start", F.col("split") * split_bytes), F.least("_stop", (F.col("split") + 1) * split_bytes)
    runs = runs.select("split", (low + F.col("shift")).alias("to"), (low - F.col("split") * split_bytes + 1).cast("int").alias("_from"), (high - low).cast("int").alias("_n"))
    copied = read_ranges(spark, source, split_bytes).select("split", "data").join(runs, "split").select("to", F.substring("data", F.col("_from"), F.col("_n")).alias("data"))
    return write_stream(heads.unionByName(numbers).unionByName(entries).unionByName(copied), target, ["to"], "data")
