"""Every query of the library by name, and the SQL that each must equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .plans import blob_queries, lookup_queries, memory_queries, parser_queries, rewrite_queries, split_queries, state_queries, stream_queries, syntax_queries, table_queries, tree_queries

_PLANS = [stream_queries, tree_queries, table_queries, blob_queries, parser_queries, lookup_queries, syntax_queries, state_queries, split_queries, memory_queries, rewrite_queries]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: v for plan in _PLANS for k, v in plan.QUERIES.items()}
ORACLES: dict[str, str] = {k: v for plan in _PLANS for k, v in plan.ORACLES.items()}
