"""Conversation prefix trie by preorder intervals.

A node is a distinct sequence of first turns.  It is named by a 128-bit sum over
its turns of a hash of (place, turn), which running sums over (conversation,
place) give for every prefix at once, however long a conversation is.

Whole copies of a conversation become one weighted conversation first.  The
distinct ones are ranked lexicographically.  Only the turns that follow a node
with several children can tell two of them apart, so the sort key of a
conversation is the list of those turns, then its length; a conversation with m
such turns shares them with m others of at least 1, 2, .. m turns, so a key has at
most the square root of twice the table's turns.  A node is ranked by (first
conversation through it, depth): this is preorder.  Its subtree ends at the end
of the last conversation through it, so leaves and savings of a subtree are
differences of running sums over the preorder.

Conversation ids that end at a node are hashed in order, from sorted pieces of
at most ``PIECE`` ids that are made before the shuffle: SHA-256 is a chain, so one
task reads the pieces of a node, one after the other, and holds none of them.

Defined results: rows of a null conversation take no part; null role or text is
empty; turns go by ``turn`` (null first), equal ones by the digest of role and
text; repeated rows are turns of their own; a conversation without turns (after a
rebuild) is a member of the root only; an empty table has no root; other columns
are ignored, whatever they are called.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._blocks import bounded_batches, heavy_keys, spread_join, stored
from ._running import running

PIECE = 500
ROOT = "0" * 32
_LOW = (1 << 32) - 1


def turns_in_order(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """(conv_id, place from 1, said: digest of role and text, n_bytes of the text, and role and text if asked for) of each turn."""
    role, text = (F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in (role_col, text_col))
    said = F.unhex(F.substring(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256), 1, 32))
    rows = conversations.where(F.col(f"`{id_col}`").isNotNull()).select(F.col(f"`{id_col}`").cast("bigint").alias("conv_id"), F.col(f"`{turn_col}`").alias("_turn"), said.alias("said"), F.octet_length(text).cast("bigint").alias("n_bytes"), *([role.alias("role"), text.alias("text")] if with_text else []))
    rows = rows.withColumn("_row", F.monotonically_increasing_id()).withColumn("_one", F.lit(1).cast("bigint"))
    return running(rows, ["conv_id", "_turn", "said", "_row"], {"place": "_one"}, "conv_id").drop("_turn", "_row", "_one")


def _named(turns: DataFrame) -> DataFrame:
    """Adds ``node``, the name of the sequence up to and with each turn, and ``parent``, that of the sequence before it."""
    mark = F.sha2(F.concat(F.col("place").cast("string"), F.lit(":"), F.hex("said")).cast("binary"), 256)
    rows = turns.select("*", *(F.conv(F.substring(mark, 8 * k + 1, 8), 16, 10).cast("bigint").alias(f"_m{k}") for k in range(4)))
    rows = running(rows, ["conv_id", "place"], {f"_s{k}": f"_m{k}" for k in range(4)}, "conv_id")

    def name(sums: list[Column]) -> Column:
        return F.lower(F.concat(*(F.lpad(F.hex(s.bitwiseAND(F.lit(_LOW))), 8, "0") for s in sums)))

    node, parent = name([F.col(f"_s{k}") for k in range(4)]), name([F.col(f"_s{k}") - F.col(f"_m{k}") for k in range(4)])
    return rows.select(*turns.columns, node.alias("node"), parent.alias("parent"))


_PIECES = pa.schema([("node", pa.string()), ("first", pa.int64()), ("ids", pa.string())])
_HASHED = pa.schema([("node", pa.string()), ("ends_sha256", pa.string())])


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ends: dict[str, list[int]] = {}
        for node, conv in zip(batch.column("node").to_pylist(), batch.column("conv_id").to_pylist(), strict=True):
            ends.setdefault(node, []).append(conv)
        cut = [(node, ids[at : at + PIECE]) for node, ids in ends.items() for at in range(0, len(ids), PIECE)]
        yield pa.record_batch([pa.array([x[0] for x in cut], pa.string()), pa.array([x[1][0] for x in cut], pa.int64()), pa.array([",".join(map(str, x[1])) for x in cut], pa.string())], schema=_PIECES)


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    last, state = None, None
    for batch in batches:
        done: list[tuple[str, str]] = []
        for node, ids in zip(batch.column("node").to_pylist(), batch.column("ids").to_pylist(), strict=True):
            if node == last:
                state.update(b"," + ids.encode())
                continue
            if state:
                done.append((last, state.hexdigest()))
            last, state = node, hashlib.sha256(ids.encode())
        yield pa.record_batch([pa.array([x[0] for x in done], pa.string()), pa.array([x[1] for x in done], pa.string())], schema=_HASHED)
    if state:
        yield pa.record_batch([pa.array([last]), pa.array([state.hexdigest()])], schema=_HASHED)


def _end_digests(ends: DataFrame) -> DataFrame:
    """ends (conv_id, node): the SHA-256 of the comma-joined ascending ids of each node."""
    ordered = ends.repartitionByRange("conv_id").sortWithinPartitions("conv_id")
    pieces = ordered.mapInArrow(_pieces, "node string, first long, ids string")
    return pieces.repartition("node").sortWithinPartitions("node", "first").mapInArrow(_hashed, "node string, ends_sha256 string")


def prefix_trie(turns: DataFrame, conversations: DataFrame) -> DataFrame:
    """turns (conv_id, place from 1 without gaps, said, n_bytes, n_turns of the conversation); conversations (conv_id, n_turns), a row each.

    Returns a row per node: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256, and its interval: preorder (from 1) to subtree_end.
    """
    bounded_batches(turns.sparkSession)
    rows = _named(turns)
    long = heavy_keys(conversations, "conv_id", "n_turns")
    ends = rows.where("place = n_turns").select("conv_id", "node", "n_turns").unionByName(conversations.where("n_turns = 0").select("conv_id", F.lit(ROOT).alias("node"), F.lit(0).cast("bigint").alias("n_turns")))
    kinds = stored(ends.groupBy("node").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("weight"), F.min("n_turns").alias("n_turns")))

    salt = F.col("place")
    mine = stored(spread_join(rows.select("conv_id", "place", "said", "n_bytes", "node", "parent"), kinds.select("conv_id", "weight"), "conv_id", salt, long))
    children = stored(mine.select("parent", "node").distinct().groupBy("parent").agg(F.count(F.lit(1)).alias("n_children")))
    crowded = heavy_keys(mine.groupBy("parent").agg(F.count(F.lit(1)).alias("n")), "parent", "n")
    telling = spread_join(mine.select("conv_id", "place", "said", "parent"), children.where("n_children > 1").select("parent"), "parent", F.col("conv_id"), crowded)
    keys = telling.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("place", F.hex("said").alias("said")))).alias("_told"))
    keys = keys.select("conv_id", F.array_join(F.col("_told.said"), "").alias("_key"))
    keyed = kinds.select("conv_id", "n_turns").join(keys, "conv_id", "left").select("conv_id", "n_turns", F.coalesce("_key", F.lit("")).alias("_key"), F.lit(1).cast("bigint").alias("_one"))
    ranks = running(keyed, ["_key", "n_turns"], {"rank": "_one"}).select("conv_id", "rank")

    ranked = spread_join(mine.select("conv_id", "place", "n_bytes", "node", "parent", "weight"), ranks, "conv_id", salt, long)
    nodes = ranked.groupBy("node").agg(F.min("conv_id").alias("conv_id"), F.min("place").alias("depth"), F.min("parent").alias("parent"), F.min("n_bytes").alias("n_bytes"), F.sum("weight").alias("n_convs"), F.min("rank").alias("_lo"), F.max("rank").alias("_hi"))
    root = ranks.agg(F.max("rank").alias("_hi")).crossJoin(kinds.agg(F.min("conv_id").alias("conv_id"), F.sum("weight").alias("n_convs"))).where("n_convs > 0")  # one row each
    root = root.select(F.lit(ROOT).alias("node"), "conv_id", F.lit(0).cast("bigint").alias("depth"), F.lit(None).cast("string").alias("parent"), F.lit(0).cast("bigint").alias("n_bytes"), "n_convs", F.lit(1).cast("bigint").alias("_lo"), "_hi")
    nodes = nodes.unionByName(root).join(children.withColumnRenamed("parent", "node"), "node", "left")
    leaf, saved = F.when(F.col("n_children").isNull(), 1).otherwise(0).cast("bigint"), ((F.col("n_convs") - 1) * F.col("n_bytes")).cast("bigint")
    nodes = nodes.withColumns({"_leaf": leaf, "_saved": saved, "_one": F.lit(1).cast("bigint")})
    placed = stored(running(nodes, ["_lo", "depth"], {"preorder": "_one", "_leaves": "_leaf", "_savings": "_saved"}))

    # the deepest node of a rank is where that conversation ends; so does the subtree of each node whose last conversation it is
    stops = placed.groupBy("_lo").agg(F.max_by(F.struct("preorder", "_leaves", "_savings"), "depth").alias("_stop")).withColumnRenamed("_lo", "_hi")
    last = heavy_keys(placed.groupBy("_hi").agg(F.count(F.lit(1)).alias("n")), "_hi", "n")
    whole = spread_join(placed, stops, "_hi", F.col("preorder"), last)
    above = placed.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    whole = spread_join(whole, above, "parent", F.col("preorder"), heavy_keys(children, "parent", "n_children"), "left")
    whole = whole.join(_end_digests(ends.select("conv_id", "node")), "node", "left")
    return whole.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).cast("bigint").alias("n_children"),
        (F.col("_stop._leaves") - F.col("_leaves") + F.col("_leaf")).alias("n_leaves"), (F.col("_stop._savings") - F.col("_savings") + F.col("_saved")).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"), "preorder", F.col("_stop.preorder").alias("subtree_end"),
    )


def conversation_trie(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """The trie of a table of turns as it stands, with ``role`` and ``text`` of each node's last turn (null for the root)."""
    turns = turns_in_order(conversations, id_col, turn_col, role_col, text_col, with_text=True)
    sizes = stored(turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_turns")))
    sized = spread_join(turns.drop("role", "text"), sizes, "conv_id", F.col("place"), heavy_keys(sizes, "conv_id", "n_turns"))
    nodes = prefix_trie(sized, sizes)
    return nodes.join(turns.select("conv_id", F.col("place").alias("depth"), "role", "text"), ["conv_id", "depth"], "left")


def rebuilt(turns: DataFrame, every: int = 5, most: int = 9) -> tuple[DataFrame, DataFrame]:
    """Conversation c starts with the first h turns of conversation c - c % every, h = crc32(c) % most; its own turns after its first h follow."""
    c = F.col("conv_id")
    head = F.crc32(c.cast("string").cast("binary")) % most
    sizes = stored(turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_own")))
    convs = sizes.select("conv_id", "n_own", (c - c % every).alias("_from"), head.alias("_h"))
    convs = convs.join(sizes.select(F.col("conv_id").alias("_from"), F.col("n_own").alias("_n_from")), "_from", "left")
    taken = F.least("_h", F.coalesce("_n_from", F.lit(0)))
    convs = stored(convs.select("conv_id", "_from", "_h", taken.alias("_taken"), (taken + F.greatest(F.lit(0), F.col("n_own") - F.col("_h"))).alias("n_turns")))
    heads = turns.where((F.col("place") < most) & (c % every == 0)).withColumnRenamed("conv_id", "_from").join(convs, "_from").where("place <= _h")
    tails = spread_join(turns.where(F.col("place") > head), convs, "conv_id", F.col("place"), heavy_keys(sizes, "conv_id", "n_own"))
    tails = tails.withColumn("place", F.col("place") - F.col("_h") + F.col("_taken"))
    columns = ["conv_id", "place", "said", "n_bytes", "n_turns"]
    return heads.select(*columns).unionByName(tails.select(*columns)), convs.select("conv_id", "n_turns")


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns, convs = rebuilt(turns_in_order(spark.read.parquet(f"{sf_dir}/conversations.parquet")))
    return prefix_trie(turns, convs).drop("preorder", "subtree_end")


ORACLE_SQL = """
WITH crc AS (SELECT list(list_reduce(list_prepend(CAST(i AS UBIGINT), CAST(range(8) AS UBIGINT[])), lambda r, k: CASE WHEN r & 1 = 1 THEN xor(r >> 1, CAST(3988292384 AS UBIGINT)) ELSE r >> 1 END) ORDER BY i) AS t FROM range(256) r(i)),
o AS (SELECT CAST(conv_id AS BIGINT) AS conv_id, sha256(concat(strlen(coalesce(role, '')), ':', coalesce(role, ''), coalesce(text, ''))) AS said, CAST(strlen(coalesce(text, '')) AS BIGINT) AS n, turn FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, list(said ORDER BY turn NULLS FIRST, said) AS said, list(n ORDER BY turn NULLS FIRST, said) AS n FROM o GROUP BY conv_id),
h AS (SELECT c.*, conv_id - conv_id % 5 AS source, CAST(xor(list_reduce(list_prepend(CAST(4294967295 AS UBIGINT), CAST(list_transform(regexp_extract_all(hex(encode(CAST(conv_id AS VARCHAR))), '..'), lambda x: CAST('0x' || x AS INT)) AS UBIGINT[])), lambda r, b: xor(t[CAST(xor(r, b) & 255 AS INT) + 1], r >> 8)), CAST(4294967295 AS UBIGINT)) AS BIGINT) % 9 AS h FROM c, crc),
r AS (SELECT h.conv_id, list_concat(coalesce(f.said, [])[1:CAST(h AS INT)], h.said[CAST(h AS INT) + 1:]) AS said, list_concat(coalesce(f.n, [])[1:CAST(h AS INT)], h.n[CAST(h AS INT) + 1:]) AS n FROM h LEFT JOIN c f ON f.conv_id = h.source),
m AS (SELECT conv_id, d AS depth, len(said) AS size, array_to_string(said[1:d], '') AS path, CASE WHEN d > 0 THEN n[d] ELSE 0 END AS n FROM (SELECT *, unnest(range(0, len(said) + 1)) AS d FROM r)),
v AS (SELECT path, min(conv_id) AS conv_id, CAST(any_value(depth) AS BIGINT) AS depth, count(*) AS n_convs, any_value(n) AS n, sha256(coalesce(string_agg(CASE WHEN size = depth THEN CAST(conv_id AS VARCHAR) END, ',' ORDER BY conv_id), '')) AS ends_sha256 FROM m GROUP BY path),
k AS (SELECT v.*, p.conv_id AS parent_conv_id, (SELECT count(*) FROM v x WHERE x.depth = v.depth + 1 AND starts_with(x.path, v.path)) AS n_children FROM v LEFT JOIN v p ON p.depth = v.depth - 1 AND starts_with(v.path, p.path))
SELECT a.conv_id, a.depth, any_value(a.parent_conv_id) AS parent_conv_id, any_value(a.n_convs) AS n_convs, any_value(a.n_children) AS n_children, count(*) FILTER (b.n_children = 0) AS n_leaves, CAST(sum((b.n_convs - 1) * b.n) AS BIGINT) AS saved_tokens, any_value(a.ends_sha256) AS ends_sha256
FROM k a JOIN k b ON starts_with(b.path, a.path) GROUP BY a.conv_id, a.depth
"""
