"""Locator and tree queries on customers, orders and line items, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import trees
from ..operators.locator import locate

_ORDER = {"cvs": ("c_custkey",), "au": ("o_orderkey",), "nu": ("o_orderkey", "l_linenumber")}
_FLAGS = {"vcl": "is_vcl", "idr": "is_idr"}


def _elements(spark: SparkSession, sf: str) -> DataFrame:
    """Line items as NAL units: customer, order and line are CVS, access unit and unit."""
    orders = spark.read.parquet(f"{sf}/orders.parquet").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey")
    items = spark.read.parquet(f"{sf}/lineitem.parquet").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", (F.col("l_returnflag") != "N").alias("is_vcl"), (F.col("l_returnflag") == "R").alias("is_idr"))
    return items.groupBy("o_orderkey", "l_linenumber").agg(F.max("is_vcl").alias("is_vcl"), F.max("is_idr").alias("is_idr")).join(orders.dropDuplicates(["o_orderkey"]), "o_orderkey")


_LOCATORS = {
    "locator_nu_in_au_in_cvs": "nu1.au0-3.cvs10-40",
    "locator_au_in_stream": "au50-120",
    "locator_au_in_cvs": "AU1.CVS0-30",
    "locator_open_end": "MSE://nu3-.au.cvs-5",
    "locator_complement": "~nu1-2.au-1.cvs7",
    "locator_double_complement": "~~nu0.~~~cvs10-",
    "locator_subset_vcl": "vcl0-1.au2.cvs3-60",
    "locator_subset_idr": "idr.cvs20",
}


def _located(uri: str) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf: str) -> DataFrame:
        from ..operators.locator import compile_locator

        deepest = compile_locator(uri, "nal")[-1].level
        columns = ["c_custkey", "o_orderkey", "l_linenumber"][: ["cvs", "au", "nu"].index(deepest) + 1]
        return locate(_elements(spark, sf), uri, "nal", _ORDER, _FLAGS).select(*columns, "uri").distinct()

    return query


def _nodes(spark: SparkSession, sf: str) -> DataFrame:
    read = lambda name: spark.read.parquet(f"{sf}/{name}.parquet")
    text = lambda kind, key: F.concat(F.lit(f"{kind}:"), F.col(key).cast("string"))
    region = read("region").select(text("region", "r_regionkey").alias("node_id"), F.lit(None).cast("string").alias("parent_id"), F.lit("region").alias("kind"), F.col("r_regionkey").cast("bigint").alias("pos"))
    nation = read("nation").select(text("nation", "n_nationkey"), text("region", "n_regionkey"), F.lit("nation"), F.col("n_nationkey").cast("bigint"))
    customer = read("customer").select(text("customer", "c_custkey"), text("nation", "c_nationkey"), F.lit("customer"), F.col("c_custkey"))
    supplier = read("supplier").select(text("supplier", "s_suppkey"), text("nation", "s_nationkey"), F.lit("supplier"), F.col("s_suppkey"))
    return region.union(nation).union(customer).union(supplier)


def tree_layout(spark: SparkSession, sf: str) -> DataFrame:
    return trees.layout(_nodes(spark, sf))


def tree_find_path(spark: SparkSession, sf: str) -> DataFrame:
    return trees.find_path(_nodes(spark, sf), "region[2]/nation[3]/supplier[1]").select("node_id", "kind")


def tree_descendants(spark: SparkSession, sf: str) -> DataFrame:
    return trees.descendants_by_kind(_nodes(spark, sf), "region:1", "customer").select("node_id")


_ITEMS = """items AS (SELECT o_custkey AS c_custkey, o_orderkey, l_linenumber, max(l_returnflag <> 'N') AS vcl, max(l_returnflag = 'R') AS idr
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL)"""
_TREE = """nodes AS (SELECT 'region:' || r_regionkey AS node_id, NULL AS parent_id, 'region' AS kind, CAST(r_regionkey AS BIGINT) AS pos FROM region
    UNION ALL SELECT 'nation:' || n_nationkey, 'region:' || n_regionkey, 'nation', n_nationkey FROM nation
    UNION ALL SELECT 'customer:' || c_custkey, 'nation:' || c_nationkey, 'customer', c_custkey FROM customer
    UNION ALL SELECT 'supplier:' || s_suppkey, 'nation:' || s_nationkey, 'supplier', s_suppkey FROM supplier),
  n AS (SELECT *, row_number() OVER (PARTITION BY parent_id, kind ORDER BY pos, node_id) - 1 AS ordinal FROM nodes)"""

QUERIES = {name: _located(uri) for name, uri in _LOCATORS.items()} | {"tree_layout": tree_layout, "tree_find_path": tree_find_path, "tree_descendants": tree_descendants}

_CVS = "(SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) - 1 AS k FROM (SELECT DISTINCT c_custkey FROM items))"
_AU_IN_CVS = "(SELECT c_custkey, o_orderkey, row_number() OVER (PARTITION BY c_custkey ORDER BY o_orderkey) - 1 AS k FROM (SELECT DISTINCT c_custkey, o_orderkey FROM items))"
_NU_IN_AU = "(SELECT *, row_number() OVER (PARTITION BY o_orderkey ORDER BY l_linenumber) - 1 AS k FROM items)"

ORACLES = {
    "locator_nu_in_au_in_cvs": f"WITH {_ITEMS} SELECT n.c_custkey, n.o_orderkey, n.l_linenumber, 'nu' || n.k || '.au' || a.k || '.cvs' || c.k AS uri FROM {_NU_IN_AU} n JOIN {_AU_IN_CVS} a USING (o_orderkey) JOIN {_CVS} c ON c.c_custkey = n.c_custkey WHERE n.k = 1 AND a.k <= 3 AND c.k BETWEEN 10 AND 40",
    "locator_au_in_stream": f"WITH {_ITEMS}, a AS (SELECT c_custkey, o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS k FROM (SELECT DISTINCT c_custkey, o_orderkey FROM items)) SELECT c_custkey, o_orderkey, 'au' || k AS uri FROM a WHERE k BETWEEN 50 AND 120",
    "locator_au_in_cvs": f"WITH {_ITEMS} SELECT a.c_custkey, o_orderkey, 'au' || a.k || '.cvs' || c.k AS uri FROM {_AU_IN_CVS} a JOIN {_CVS} c USING (c_custkey) WHERE a.k = 1 AND c.k <= 30",
    "locator_open_end": f"WITH {_ITEMS} SELECT n.c_custkey, n.o_orderkey, n.l_linenumber, 'nu' || n.k || '.au' || a.k || '.cvs' || c.k AS uri FROM {_NU_IN_AU} n JOIN {_AU_IN_CVS} a USING (o_orderkey) JOIN {_CVS} c ON c.c_custkey = n.c_custkey WHERE n.k >= 3 AND c.k <= 5",
    "locator_complement": f"WITH {_ITEMS} SELECT n.c_custkey, n.o_orderkey, n.l_linenumber, 'nu' || n.k || '.au' || a.k || '.cvs' || c.k AS uri FROM {_NU_IN_AU} n JOIN {_AU_IN_CVS} a USING (o_orderkey) JOIN {_CVS} c ON c.c_custkey = n.c_custkey WHERE n.k NOT IN (1, 2) AND a.k <= 1 AND c.k = 7",
    "locator_double_complement": f"WITH {_ITEMS} SELECT n.c_custkey, n.o_orderkey, n.l_linenumber, 'nu' || n.k || '.cvs' || c.k AS uri FROM (SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY o_orderkey, l_linenumber) - 1 AS k FROM items) n JOIN {_CVS} c USING (c_custkey) WHERE n.k = 0 AND c.k < 10",
    "locator_subset_vcl": f"WITH {_ITEMS} SELECT v.c_custkey, v.o_orderkey, v.l_linenumber, 'vcl' || v.k || '.au' || a.k || '.cvs' || c.k AS uri FROM (SELECT *, row_number() OVER (PARTITION BY o_orderkey ORDER BY l_linenumber) - 1 AS k FROM items WHERE vcl) v JOIN {_AU_IN_CVS} a USING (o_orderkey) JOIN {_CVS} c ON c.c_custkey = v.c_custkey WHERE v.k <= 1 AND a.k = 2 AND c.k BETWEEN 3 AND 60",
    "locator_subset_idr": f"WITH {_ITEMS} SELECT v.c_custkey, v.o_orderkey, v.l_linenumber, 'idr' || v.k || '.cvs' || c.k AS uri FROM (SELECT *, row_number() OVER (PARTITION BY o_orderkey ORDER BY l_linenumber) - 1 AS k FROM items WHERE idr) v JOIN {_CVS} c USING (c_custkey) WHERE c.k = 20",
    "tree_layout": f"""WITH RECURSIVE {_TREE}, t AS (SELECT node_id, kind, 0 AS level, kind || '[' || ordinal || ']' AS path FROM n WHERE parent_id IS NULL
        UNION ALL SELECT n.node_id, n.kind, t.level + 1, t.path || '/' || n.kind || '[' || n.ordinal || ']' FROM n JOIN t ON n.parent_id = t.node_id) SELECT * FROM t""",
    "tree_find_path": f"WITH {_TREE} SELECT s.node_id, s.kind FROM n s JOIN n a ON s.parent_id = a.node_id JOIN n r ON a.parent_id = r.node_id WHERE s.kind = 'supplier' AND s.ordinal = 1 AND a.kind = 'nation' AND a.ordinal = 3 AND r.kind = 'region' AND r.ordinal = 2",
    "tree_descendants": f"WITH {_TREE} SELECT c.node_id FROM n c JOIN n a ON c.parent_id = a.node_id WHERE c.kind = 'customer' AND a.parent_id = 'region:1'",
}
