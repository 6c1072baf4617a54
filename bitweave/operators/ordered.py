"""Order-dependent operators that need no single task: lag, running sum and maximum, last known value, rank.

Rows are cut into spans of 65,536 positions.  Inside a span an ordinary window
does the work; across spans only one summary row each is ordered (a stream of
500 billion packets has 8 million of them), and what comes of it leads its span.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from .shared import written

SPAN = 1 << 16


def _spans(df: DataFrame, order: str, span: int, by: list[str], large: DataFrame | None) -> DataFrame:
    """Adds _span: by position, or 0 for all rows of a group that isn't among the large ones."""
    if large is None or not by:
        return df.withColumn("_span", F.floor(F.col(order) / span))
    marks = large.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(by)), F.lit(True).alias("_large"))
    same = F.lit(True)
    for i, k in enumerate(by):
        same &= F.col(k).eqNullSafe(F.col(f"_k{i}"))
    rows = df.join(F.broadcast(marks), same, "left").drop(*(f"_k{i}" for i in range(len(by))))
    return rows.withColumn("_span", F.when(F.col("_large"), F.floor(F.col(order) / span)).otherwise(F.lit(0).cast("bigint"))).drop("_large")


def _led(rows: DataFrame, carried: DataFrame, by: list[str]) -> tuple[DataFrame, WindowSpec]:
    """The rows, each span led by the row that is carried into it (not _own), and the window that reads them in order.

    Spans with none before them get no such row.  The rows are shuffled once, for the window, and joined with nothing.
    """
    both = rows.withColumn("_own", F.lit(True)).unionByName(carried.withColumn("_own", F.lit(False)), allowMissingColumns=True)
    return both, Window.partitionBy(*by, "_span")


def with_lag(df: DataFrame, columns: dict[str, str], order: str, by: tuple[str, ...] = (), span: int = SPAN) -> DataFrame:
    """Adds, for {new: old}, the old column's value on the row before."""
    by = list(by)
    pack = F.struct(*(F.col(old).alias(new) for new, old in columns.items()))
    rows = _spans(df, order, span, by, None).withColumn("_pack", pack)
    ends = rows.groupBy(*by, "_span").agg(F.max_by("_pack", F.col(order)).alias("_end"))
    carried = ends.select(*by, "_span", F.lag("_end").over(Window.partitionBy(*by).orderBy("_span")).alias("_pack")).where("_pack is not null")
    both, w = _led(rows, carried, by)
    out = both.withColumn("_value", F.lag("_pack").over(w.orderBy("_own", order))).where("_own")
    return out.select(*df.columns, *(F.col(f"_value.{new}").alias(new) for new in columns))


def _running(df: DataFrame, columns: dict[str, Column], order: str, by: tuple[str, ...], span: int, large: DataFrame | None, total, upto) -> DataFrame:
    """Adds, for {new: expression}, ``upto`` of it up to and with each row; ``total`` sums up a span in the same way."""
    by = list(by)
    rows = _spans(df, order, span, by, large).select("*", *(x.alias(f"_x_{new}") for new, x in columns.items()))
    ends = rows.groupBy(*by, "_span").agg(*(total(f"_x_{new}").alias(f"_t_{new}") for new in columns))
    spans = Window.partitionBy(*by).orderBy("_span")
    before = spans.rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(*by, "_span", F.lag(F.lit(True)).over(spans).alias("_follows"), *(upto(f"_t_{new}").over(before).alias(f"_x_{new}") for new in columns)).where("_follows").drop("_follows")
    both, w = _led(rows, carried, by)
    w = w.orderBy("_own", order).rowsBetween(Window.unboundedPreceding, 0)
    return both.select("*", *(upto(f"_x_{new}").over(w).alias(f"_w_{new}") for new in columns)).where("_own")


def with_running_sum(df: DataFrame, columns: dict[str, Column], order: str, by: tuple[str, ...] = (), span: int = SPAN, large: DataFrame | None = None) -> DataFrame:
    """Adds, for {new: expression}, the sum of the expression up to and with each row.

    large: the groups of ``by`` that are cut into spans, where they are known; others are ordered whole, wherever their positions lie.
    """
    out = _running(df, columns, order, by, span, large, F.sum, F.sum)
    return out.select(*df.columns, *(F.coalesce(F.col(f"_w_{new}"), F.lit(0)).alias(new) for new in columns))


def with_running_max(df: DataFrame, columns: dict[str, Column], order: str, by: tuple[str, ...] = (), span: int = SPAN) -> DataFrame:
    """Adds, for {new: expression}, the largest value of the expression up to and with each row; nulls count for nothing."""
    out = _running(df, columns, order, by, span, None, F.max, F.max)
    return out.select(*df.columns, *(F.col(f"_w_{new}").alias(new) for new in columns))


def with_rank(df: DataFrame, new: str, order: list[str]) -> DataFrame:
    """Adds the rank from 0 among all rows: sorted parts are written, and only one count of each is ordered."""
    parts = written(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    counts = parts.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select("_part", F.coalesce(before, F.lit(0)).alias("_before"))
    rank = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    return parts.withColumn("_rank", rank).join(F.broadcast(counts), "_part").select(*df.columns, (F.col("_before") + F.col("_rank")).alias(new))


def with_last_known(df: DataFrame, columns: dict[str, Column], order: str, by: tuple[str, ...] = (), span: int = SPAN) -> DataFrame:
    """Adds, for {new: expression}, the latest non-null value up to and with each row: a backward as-of lookup."""
    latest = lambda x: F.max_by(x, F.when(F.col(x).isNotNull(), F.col(order)))
    out = _running(df, columns, order, by, span, None, latest, lambda x: F.last(x, ignorenulls=True))
    return out.select(*df.columns, *(F.col(f"_w_{new}").alias(new) for new in columns))
