"""Queries over files that are rewritten, and over the parts of a stream that a locator needs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import locator_index, rewrite
from ..operators.locator import compile_locator
from ..operators.shared import shared_folder, written
from . import tree_queries

_LIMIT = 20_000


def _files(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A file per customer: a head with a track for each order (an offset table, and a note), then the data of all lines, a chunk each."""
    orders = spark.read.parquet(f"{sf}/orders.parquet").select(F.col("o_custkey").alias("file"), F.col("o_orderkey").alias("o"), F.length("o_orderpriority").cast("bigint").alias("note"))
    lines = spark.read.parquet(f"{sf}/lineitem.parquet").select(F.col("l_orderkey").alias("o"), F.struct("l_linenumber", "l_partkey", "l_suppkey").alias("line"))
    tracks = orders.join(lines.groupBy("o").agg(F.array_sort(F.collect_list("line")).alias("lines")), "o", "left").withColumn("n", F.coalesce(F.size("lines"), F.lit(0)).cast("bigint")).withColumn("n", F.greatest("n", F.lit(0)))
    sizes = F.coalesce(F.transform("lines", lambda x: x["l_partkey"].cast("bigint") + 1), F.array().cast("array<bigint>"))
    tracks = tracks.withColumn("sizes", sizes).withColumn("bytes", F.aggregate("sizes", F.lit(0).cast("bigint"), lambda a, b: a + b))
    before = Window.partitionBy("file").orderBy("o").rowsBetween(Window.unboundedPreceding, -1)  # the orders of a customer
    whole = F.col("n") * 4 + 32 + F.col("note")
    tracks = tracks.withColumns({"at": F.coalesce(F.sum(whole).over(before), F.lit(0)) + 8, "data_at": F.coalesce(F.sum("bytes").over(before), F.lit(0)), "whole": whole})
    totals = tracks.groupBy("file").agg((F.sum("whole") + 8).alias("head"), F.sum("bytes").alias("data"))
    tracks = written(tracks.join(totals, "file"))
    row = lambda box, kind, offset, size: F.struct((F.lit(box) if isinstance(box, int) else box).cast("bigint").alias("box"), F.lit(kind).alias("kind"), offset.cast("bigint").alias("offset"), size.cast("bigint").alias("size"), F.lit(8).alias("header"))
    o, at = F.col("o") * 4, F.col("at")
    inner = F.array(row(o + 1, "trak", at, F.col("whole")), row(o + 2, "stco", at + 8, F.col("n") * 4 + 16), row(o + 3, "udta", at + F.col("n") * 4 + 24, F.col("note") + 8))
    outer = F.array(row(0, "moov", F.lit(0), F.col("head")), row(-1, "mdat", F.col("head"), F.col("data") + 8))
    boxes = tracks.select("file", F.explode(inner).alias("x")).unionByName(totals.select("file", F.explode(outer).alias("x"))).select("file", "x.*")
    gone = F.filter(F.array(F.when(F.col("o") % 11 == 5, o + 1), F.when(F.col("o") % 3 == 0, o + 3)), lambda x: x.isNotNull())
    removed = tracks.select("file", F.explode(gone).alias("box"))
    base = F.col("head") + 8 + F.col("data_at")
    chunks = tracks.select("file", (o + 2).alias("box"), "sizes", base.alias("base"), F.posexplode("sizes").alias("k", "_s"))
    chunks = chunks.select("file", "box", F.col("k").cast("bigint").alias("k"), (F.col("base") + F.aggregate(F.slice("sizes", F.lit(1), F.col("k")), F.lit(0).cast("bigint"), lambda a, b: a + b)).alias("chunk_offset"))
    return boxes, removed, chunks


def box_removal(spark: SparkSession, sf: str) -> DataFrame:
    """The files without some tracks and notes: new boxes, and count and sum of the offsets of each table, where numbers from 20,000 take the wide forms."""
    boxes, removed, chunks = _files(spark, sf)
    new, moved, _ = rewrite.without_boxes(boxes, removed, chunks, ("file",), _LIMIT)
    sums = moved.groupBy("file", "box").agg(F.count("new_chunk_offset").alias("n_chunks"), F.sum("new_chunk_offset").alias("offsets"))
    return new.join(sums, ["file", "box"], "left").select("file", "box", "kind", "new_offset", "new_size", "new_header", F.coalesce("n_chunks", F.lit(0)).alias("n_chunks"), F.coalesce("offsets", F.lit(0)).alias("offsets"))


# -- locators -----------------------------------------------------------------

_ORDER = {"cvs": ("c_custkey",), "au": ("c_custkey", "o_orderkey"), "nu": ("c_custkey", "o_orderkey", "l_linenumber")}
_SPLIT_ROWS = 2_000


def _index(spark: SparkSession, sf: str) -> str:
    at = shared_folder(spark)
    locator_index.write_index(tree_queries._elements(spark, sf), "nal", _ORDER, at, tree_queries._FLAGS, _SPLIT_ROWS)
    return at


def locator_by_index(spark: SparkSession, sf: str) -> DataFrame:
    """What each of the locators finds in the indexed elements."""
    at, out = _index(spark, sf), None
    for name, uri in tree_queries._LOCATORS.items():
        line = F.col("l_linenumber") if compile_locator(uri, "nal")[-1].level == "nu" else F.lit(None).cast("int")
        found = locator_index.locate_by_index(spark, at, uri, "nal").select(F.lit(name).alias("locator"), "c_custkey", "o_orderkey", line.alias("l_linenumber"), "uri").distinct()
        out = found if out is None else out.unionByName(found)
    return out


def locator_splits(spark: SparkSession, sf: str) -> DataFrame:
    """Of how many splits and rows each locator reads how many."""
    at, out = _index(spark, sf), None
    whole = spark.read.parquet(f"{at}/splits").agg(F.count(F.lit(1)).alias("n_splits"), F.sum("n_rows").alias("n_rows"))
    for name, uri in tree_queries._LOCATORS.items():
        read = locator_index.needed_splits(spark, at, uri, "nal").agg(F.lit(name).alias("locator"), F.count(F.lit(1)).alias("n_read"), F.coalesce(F.sum("n_rows"), F.lit(0)).alias("rows_read"))
        out = read if out is None else out.unionByName(read)
    return out.join(whole)  # one row


QUERIES = {"box_removal": box_removal, "locator_by_index": locator_by_index, "locator_splits": locator_splits}

_AU_IN_STREAM = f"WITH {tree_queries._ITEMS}, a AS (SELECT c_custkey, o_orderkey, row_number() OVER (ORDER BY c_custkey, o_orderkey) - 1 AS k FROM (SELECT DISTINCT c_custkey, o_orderkey FROM items)) SELECT c_custkey, o_orderkey, 'au' || k AS uri FROM a WHERE k BETWEEN 50 AND 120"


def _all_located() -> str:
    out = []
    for name in tree_queries._LOCATORS:
        sql = _AU_IN_STREAM if name == "locator_au_in_stream" else tree_queries.ORACLES[name]
        line = "NULL" if name in ("locator_au_in_stream", "locator_au_in_cvs") else "l_linenumber"
        out.append(f"SELECT '{name}' AS locator, c_custkey, o_orderkey, {line} AS l_linenumber, uri FROM ({sql})")
    return " UNION ALL ".join(out)


#: Each locator as a test of a split's least and greatest ordinals.
_READS = {
    "locator_nu_in_au_in_cvs": "nu1 >= 1 AND nu0 <= 1 AND au0 <= 3 AND c1 >= 10 AND c0 <= 40",
    "locator_au_in_stream": "g1 >= 50 AND g0 <= 120",
    "locator_au_in_cvs": "au1 >= 1 AND au0 <= 1 AND c0 <= 30",
    "locator_open_end": "nu1 >= 3 AND c0 <= 5",
    "locator_complement": "(nu0 < 1 OR nu1 > 2) AND au0 <= 1 AND c1 >= 7 AND c0 <= 7",
    "locator_double_complement": "n0 <= 0 AND c0 < 10",
    "locator_subset_vcl": "v0 <= 1 AND au1 >= 2 AND au0 <= 2 AND c1 >= 3 AND c0 <= 60",
    "locator_subset_idr": "i1 >= 0 AND c1 >= 20 AND c0 <= 20",
}
ORACLES = {
    "locator_by_index": _all_located(),
    "locator_splits": f"""WITH {tree_queries._ITEMS}, x AS (SELECT *, (row_number() OVER (ORDER BY c_custkey, o_orderkey, l_linenumber) - 1) // {_SPLIT_ROWS} AS split, dense_rank() OVER (ORDER BY c_custkey) - 1 AS c, dense_rank() OVER (ORDER BY c_custkey, o_orderkey) - 1 AS g,
          dense_rank() OVER (PARTITION BY c_custkey ORDER BY o_orderkey) - 1 AS au, row_number() OVER (PARTITION BY c_custkey ORDER BY o_orderkey, l_linenumber) - 1 AS n, row_number() OVER (PARTITION BY o_orderkey ORDER BY l_linenumber) - 1 AS nu,
          CASE WHEN vcl THEN count(*) FILTER (vcl) OVER w - 1 END AS v, CASE WHEN idr THEN count(*) FILTER (idr) OVER w - 1 END AS i FROM items WINDOW w AS (PARTITION BY o_orderkey ORDER BY l_linenumber)),
        s AS (SELECT split, count(*) AS rows, {", ".join(f"min({k}) AS {k}0, max({k}) AS {k}1" for k in ("c", "g", "au", "n", "nu", "v", "i"))} FROM x GROUP BY split)
        """
    + " UNION ALL ".join(f"SELECT '{name}' AS locator, count(*) FILTER ({test}) AS n_read, CAST(coalesce(sum(rows) FILTER ({test}), 0) AS BIGINT) AS rows_read, count(*) AS n_splits, CAST(sum(rows) AS BIGINT) AS n_rows FROM s" for name, test in _READS.items()),
    "box_removal": f"""WITH RECURSIVE l AS (SELECT l_orderkey AS o, l_partkey + 1 AS z, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS i FROM lineitem),
        t AS (SELECT o_custkey AS f, o_orderkey AS o, length(o_orderpriority) AS note, o_orderkey % 11 = 5 AS gone, o_orderkey % 3 = 0 AS bare, coalesce((SELECT count(*) FROM l WHERE l.o = o_orderkey), 0) AS n, coalesce((SELECT sum(z) FROM l WHERE l.o = o_orderkey), 0) AS bytes FROM orders),
        d AS (SELECT *, sum(bytes) OVER (PARTITION BY f ORDER BY o) - bytes AS place FROM t),
        m AS (SELECT f, 8 + sum(bytes) AS mdat, 8 + sum(CASE WHEN gone THEN 0 ELSE 8 + 16 + 4 * n + CASE WHEN bare THEN 0 ELSE 8 + note END END) AS moov FROM d GROUP BY f),
        c AS (SELECT d.f, d.o, d.gone, d.n, d.place + sum(z) OVER (PARTITION BY d.o ORDER BY i) - z AS pos FROM d JOIN l USING (o)),
        p AS (SELECT f, o, any_value(gone) AS gone, any_value(n) AS n, max(pos) AS top, sum(pos) AS poss FROM c GROUP BY f, o),
        g AS (SELECT f, CAST(0 AS HUGEINT) AS grown, CASE WHEN mdat >= {_LIMIT} THEN 16 ELSE 8 END AS head FROM m
          UNION ALL SELECT x.f, y.more, x.head FROM g x JOIN LATERAL (SELECT CAST(coalesce(sum(4 * p.n), 0) AS HUGEINT) AS more FROM p, m WHERE p.f = x.f AND m.f = x.f AND NOT p.gone AND p.top + m.moov + x.grown + x.head >= {_LIMIT}) y ON true WHERE y.more > x.grown),
        s AS (SELECT f, max(grown) AS grown, any_value(head) AS head FROM g GROUP BY f),
        k AS (SELECT d.f, d.o, d.n, note, bare, coalesce(top + moov + grown + head >= {_LIMIT}, false) AS wide, coalesce(poss + d.n * (moov + grown + head), 0) AS offsets FROM d JOIN m ON m.f = d.f JOIN s ON s.f = d.f LEFT JOIN p ON p.o = d.o WHERE NOT d.gone),
        w AS (SELECT *, 16 + n * CASE WHEN wide THEN 8 ELSE 4 END AS stco, CASE WHEN bare THEN 0 ELSE 8 + note END AS udta FROM k),
        q AS (SELECT *, 8 + stco + udta AS trak, 8 + sum(8 + stco + udta) OVER (PARTITION BY f ORDER BY o) - (8 + stco + udta) AS place FROM w),
        b AS (SELECT f, o * 4 + 1 AS box, 'trak' AS kind, place, trak AS size, 8 AS header, 0 AS n, 0 AS offsets FROM q
          UNION ALL SELECT f, o * 4 + 2, CASE WHEN wide THEN 'co64' ELSE 'stco' END, place + 8, stco, 8, n, offsets FROM q
          UNION ALL SELECT f, o * 4 + 3, 'udta', place + 8 + stco, udta, 8, 0, 0 FROM q WHERE NOT bare
          UNION ALL SELECT m.f, 0, 'moov', 0, moov + grown, 8, 0, 0 FROM m JOIN s ON s.f = m.f
          UNION ALL SELECT m.f, -1, 'mdat', moov + grown, mdat - 8 + head, head, 0, 0 FROM m JOIN s ON s.f = m.f)
        SELECT f AS file, CAST(box AS BIGINT) AS box, kind, CAST(place AS BIGINT) AS new_offset, CAST(size AS BIGINT) AS new_size, CAST(header AS INTEGER) AS new_header, CAST(n AS BIGINT) AS n_chunks, CAST(offsets AS BIGINT) AS offsets FROM b""",
}
