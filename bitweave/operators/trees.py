"""Trees as adjacency rows (node_id, parent_id, kind, ordinal, pos): layout and path search."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import written


def with_ordinals(nodes: DataFrame) -> DataFrame:
    """ordinal: rank among the siblings of its kind; place: rank among all siblings."""
    w = lambda *keys: Window.partitionBy("parent_id", *keys).orderBy("pos", "node_id")
    return nodes.withColumn("ordinal", F.row_number().over(w("kind")) - 1).withColumn("place", F.row_number().over(w()) - 1)


def find_path(nodes: DataFrame, path: str) -> DataFrame:
    """Nodes at ``a/b[2]/c``: one equi-join a step; without an index the first of its kind is taken."""
    steps = [re.fullmatch(r"([^\[\]]+)(?:\[(\d+)\])?", x) for x in path.strip("/").split("/")]
    if not all(steps):
        raise ValueError(f"no path: {path}")
    numbered = with_ordinals(nodes)
    found = None
    for m in steps:
        here = numbered.where((F.col("kind") == m[1]) & (F.col("ordinal") == int(m[2] or 0)))
        if found is None:
            found = here.where("parent_id is null")
        else:
            found = here.join(found.select(F.col("node_id").alias("parent_id")), "parent_id", "left_semi")
    return found


def layout(nodes: DataFrame) -> DataFrame:
    """Every node below a root with level and path of kind[ordinal] steps, one join a level, down to the last."""
    numbered = written(with_ordinals(nodes))
    name = F.concat("kind", F.lit("["), F.col("ordinal").cast("string"), F.lit("]"))
    front = written(numbered.where("parent_id is null").select("node_id", "kind", F.lit(0).alias("level"), name.alias("path")))
    out, level = front, 0
    while not front.isEmpty():
        level += 1
        up = front.select(F.col("node_id").alias("parent_id"), F.col("path").alias("_up"))
        front = written(numbered.join(up, "parent_id").select("node_id", "kind", F.lit(level).alias("level"), F.concat("_up", F.lit("/"), name).alias("path")))
        out = out.unionByName(front)
    return out


def descendants_by_kind(nodes: DataFrame, ancestor_id, kind: str) -> DataFrame:
    """Nodes of a kind anywhere below an ancestor, one join a level, down to the last."""
    front, out = nodes.where(F.col("parent_id") == ancestor_id), None
    while True:
        # plans stay short however deep the tree is; only a circle leads back to the ancestor
        front = written(front.where(F.col("node_id") != ancestor_id))
        out = front if out is None else out.unionByName(front)
        if front.isEmpty():
            return out.where(F.col("kind") == kind)
        front = nodes.join(front.select(F.col("node_id").alias("parent_id")), "parent_id", "left_semi")
