"""An index for locators: what of a stream must be read to find the elements that a locator names.

The elements are stored in stream order, cut into splits, each row with its ordinal
inside every level above; a small table has the least and greatest ordinal of each
split.  A locator becomes one range test a level.  On the small table the tests
name the splits that can hold such elements; Spark reads only their folders (of one
split, or of neighbours where there are more than ``FOLDERS``), by partition pruning while the query runs, and on the rows the same tests select.
Nothing is ranked again, so a lookup shuffles nothing but that small table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .locator import LEVELS, SUBSETS, LocatorError, Selector, compile_locator
from .ordered import SPAN, with_lag, with_last_known, with_rank, with_running_sum
from .shared import written


def _name(inside: str | None, name: str) -> str:
    return f"_in_{inside or 'stream'}_{name}"


#: Folders of an index at most; each has equally many splits, next to one another.
FOLDERS = 1024


def _stored(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(spark.read.parquet(f"{path}/columns").schema).parquet(f"{path}/elements")


def write_index(elements: DataFrame, scheme: str, order: dict[str, tuple[str, ...]], path: str, subset_flags: dict[str, str] | None = None, split_rows: int = 1 << 20, span: int = SPAN) -> None:
    """Stores elements (a row for each of the deepest level) and their ordinals under ``path``, ``split_rows`` to a split.

    order: for each level in use the columns that name its elements in stream order; those of a level begin with those
    of the level above it.  Rows with equal columns are one element and stay together.  subset_flags as for ``locate``.
    """
    levels = [x for x in LEVELS[scheme] if x in order]
    for up, low in zip(levels, levels[1:], strict=False):
        if order[low][: len(order[up])] != order[up]:
            raise ValueError(f"the columns of {low} must begin with those of {up}")
    columns = list(order[levels[-1]])
    flags = subset_flags or {}
    rows = written(with_rank(elements, "_row", columns).withColumn("_row", F.col("_row").cast("bigint")))
    each = -(-rows.count() // (split_rows * FOLDERS)) or 1  # splits of a folder
    rows = with_lag(rows.withColumn("_key", F.struct(*columns)), {"_before": "_key"}, "_row", (), span)
    starts = {}
    for level in levels:
        same = F.col("_before").isNotNull()
        for c in order[level]:
            same &= F.col(f"_key.{c}").eqNullSafe(F.col(f"_before.{c}"))
        starts[level] = ~same
    for name, flag in flags.items():
        starts[name] = starts[SUBSETS[scheme][name]] & F.coalesce(F.col(flag), F.lit(False))
    rows = rows.withColumns({f"_s_{name}": x for name, x in starts.items()}).drop("_key", "_before")
    rows = written(with_running_sum(rows, {f"_g_{name}": F.col(f"_s_{name}").cast("int") for name in starts}, "_row", (), span))
    pairs = [(None, x) for x in levels] + [(a, b) for k, a in enumerate(levels) for b in levels[k + 1 :]]
    for name in flags:
        unit = LEVELS[scheme][LEVELS[scheme].index(SUBSETS[scheme][name]) - 1]  # a subset counts inside its access unit
        pairs.append((unit if unit in levels else None, name))
    # how many there were before the element above began
    base = {_name(a, b): F.when(F.col(f"_s_{a}"), F.col(f"_g_{b}") - F.col(f"_s_{b}").cast("int")) for a, b in pairs if a}
    rows = with_last_known(rows, base, "_row", (), span) if base else rows
    rows = rows.withColumns({_name(a, b): F.col(f"_g_{b}") - 1 - (F.col(_name(a, b)) if a else F.lit(0)) for a, b in pairs})
    rows = rows.withColumns({_name(a, b): F.when(F.coalesce(F.col(flags[b]), F.lit(False)), F.col(_name(a, b))) for a, b in pairs if b in flags})
    rows = rows.select(*elements.columns, *(_name(a, b) for a, b in pairs), "_row", F.expr(f"_row div {split_rows}").alias("_split"))
    rows = rows.withColumn("_part", F.expr(f"_split div {each}"))
    rows.repartitionByRange("_split").sortWithinPartitions("_part", "_split", "_row").write.partitionBy("_part").parquet(f"{path}/elements")
    rows.limit(0).write.parquet(f"{path}/columns")  # what the rows are, also where there are none
    stored = _stored(elements.sparkSession, path)
    ends = [x for a, b in pairs for x in (F.min(_name(a, b)).alias(f"{_name(a, b)}_min"), F.max(_name(a, b)).alias(f"{_name(a, b)}_max"))]
    stored.groupBy("_split", "_part").agg(F.count(F.lit(1)).alias("n_rows"), *ends).write.parquet(f"{path}/splits")


def _tests(uri: str, scheme: str, columns: list[str]) -> list[tuple[Selector, str]]:
    """Each selector and the column that holds its ordinal."""
    out, above = [], None
    for s in compile_locator(uri, scheme):
        inside = above
        if s.name != s.level:
            unit = LEVELS[scheme][LEVELS[scheme].index(s.level) - 1]
            inside = unit if _name(unit, s.name) in columns else None
        if _name(inside, s.name) not in columns:
            raise LocatorError(f"the index has no {s.name}")
        out.append((s, _name(inside, s.name)))
        above = s.level
    return out


def _can_hold(s: Selector, low: Column, high: Column) -> Column:
    """Whether some ordinal between two is accepted; null, so never, where a split has none.

    Plain comparisons: inside another function Spark doesn't take them for a filter worth pruning by.
    """
    if s.inverted:
        found = low < s.first
        return found if s.last is None else found | (high > s.last)
    found = high >= s.first
    return found if s.last is None else found & (low <= s.last)


def needed_splits(spark: SparkSession, path: str, uri: str, scheme: str) -> DataFrame:
    """_split, _part (its folder), n_rows of the splits that can hold what a locator names: no other split has any."""
    splits = spark.read.parquet(f"{path}/splits")
    for s, c in _tests(uri, scheme, [x[:-4] for x in splits.columns if x.endswith("_min")]):
        splits = splits.where(_can_hold(s, F.col(f"{c}_min"), F.col(f"{c}_max")))
    return splits.select("_split", "_part", "n_rows")


def locate_by_index(spark: SparkSession, path: str, uri: str, scheme: str) -> DataFrame:
    """``locate`` on the stored elements: the same rows with the same ``uri``."""
    rows = _stored(spark, path)
    tests = _tests(uri, scheme, rows.columns)
    for s, c in tests:
        rows = rows.where(s.accepts(F.col(c)))
    rows = rows.join(needed_splits(spark, path, uri, scheme).select("_part", "_split"), ["_part", "_split"], "left_semi")
    shown = F.concat_ws(".", *(F.concat(F.lit(s.name), F.col(c).cast("string")) for s, c in reversed(tests)))
    return rows.withColumn("uri", shown).drop("_part", "_split", "_row", *(c for c in rows.columns if c.startswith("_in_")))
