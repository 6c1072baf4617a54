"""Slot memory: which row wrote a slot last, for rows that write several slots at once under a bit mask and read others by index.

This is the state of a decoder's reference frames, without a state machine: a
slot's content before a row is the last value among earlier rows whose mask has
its bit, so all slots are carried values of one ordered pass, and a read is an
array lookup.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import SPAN, with_lag, with_last_known

SLOTS = 8


def with_slots(rows: DataFrame, mask: Column, value: Column, order: str, by: tuple[str, ...] = (), slots: int = SLOTS, span: int = SPAN) -> DataFrame:
    """Adds ``before`` and ``after``, arrays of what each slot holds around a row (null: never written).

    order: an integer column without ties in a stream; values must not be null.
    """
    names = [f"_s{k}" for k in range(slots)]
    bit = lambda k: F.coalesce(mask, F.lit(0)).cast("bigint").bitwiseAND(F.lit(1 << k)) != 0
    written = with_last_known(rows, {n: F.when(bit(k), value) for k, n in enumerate(names)}, order, by, span)
    both = with_lag(written.withColumn("after", F.array(*names)), {"before": "after"}, order, by, span)
    nothing = F.array(*(F.when(F.lit(False), F.col(n)) for n in names))
    return both.select(*rows.columns, F.coalesce("before", nothing).alias("before"), "after")


def read_slots(slots: Column, indices: Column) -> Column:
    """What the slots of several indices hold; null for an index that is none."""
    return F.transform(indices, lambda k: F.get(slots, k.cast("int")))
