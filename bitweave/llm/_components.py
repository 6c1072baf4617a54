"""Connected components by min-label hooking and pointer jumping, all as joins and aggregates.

Each round every edge offers the other end's label to a node and to that node's
own label (hooking), then labels jump to their label's label.  Labels only fall,
a round costs a constant number of shuffles, and the number of rounds is
logarithmic in practice.  Labels are written to the shared folder each round, so
nothing is recomputed and no task sees all edges of a frequent node: the joins
have a shuffle on either side, which adaptive execution may split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._blocks import forget, stored


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b): undirected. Returns (node, root): each node that has an edge, and the smallest node it reaches."""
    one_way = edges.where("a <> b").select(F.col("a").cast("bigint"), F.col("b").cast("bigint"))
    links = stored(one_way.select("a", "b").union(one_way.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = stored(links.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("root"), F.lit(True).alias("moved")))
    while labels.where("moved").limit(1).count():  # a round lowers a label or is the last, so this ends
        other = links.join(labels.select(F.col("node").alias("b"), F.col("root").alias("there")), "b")
        both = other.join(labels.select(F.col("node").alias("a"), F.col("root").alias("here")), "a").where("here <> there")
        offers = both.select(F.explode(F.array("a", "here")).alias("node"), "there").groupBy("node").agg(F.min("there").alias("offer"))
        hooked = stored(labels.join(offers, "node", "left").select("node", F.least("root", F.coalesce("offer", "root")).alias("root"), F.col("root").alias("before")))
        jump = hooked.select(F.col("node").alias("root"), F.col("root").alias("up"))
        before, labels = labels, stored(hooked.join(jump, "root", "left").select("node", F.coalesce("up", "root").alias("root"), (F.coalesce("up", "root") != F.col("before")).alias("moved")))
        forget(before, hooked)
    return labels.select("node", "root")
