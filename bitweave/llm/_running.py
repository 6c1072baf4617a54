"""Running sums over a global order, without one task that sees all rows.

Rows are range-partitioned by the order and sorted inside each part; every part
sums its own rows as they pass, and the parts are written to the shared folder.
One row a part, its first and last group and the last group's sum, is then put
in order, and what earlier parts hold of a part's first group is added to it.
Neither a long group nor a long table meets in one task; equal rows are told
apart by an order column that the caller gives.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._blocks import stored


def _sums(columns: list[str], group: str | None, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, last, carry = TaskContext.get().partitionId(), 0, None, np.zeros((len(columns), 1), np.int64)
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            sums = np.cumsum([batch.column(c).to_numpy() for c in columns], axis=1)
            keys = batch.column(group).to_numpy() if group else np.zeros(n, np.int64)
            fresh = np.ones(n, bool)
            fresh[0] = keys[0] != last
            fresh[1:] = keys[1:] != keys[:-1]
            starts = np.flatnonzero(fresh)
            before = np.concatenate([np.zeros((len(columns), 1), np.int64), sums], axis=1)[:, starts]
            sums -= np.concatenate([-carry, before], axis=1)[:, np.cumsum(fresh)]
            carry, last = sums[:, -1:], keys[-1]
            own = [pa.array(np.full(n, part), pa.int32()), pa.array(np.arange(number, number + n)), *(pa.array(x) for x in sums)]
            number += n
            yield pa.record_batch([*batch.columns, *own], schema=schema)

    return run


def running(df: DataFrame, order: list[str], sums: dict[str, str], group: str | None = None) -> DataFrame:
    """Adds, for {new: column of bigint}, its sum over the rows of the group (a bigint column that the order starts with) up to and with each row."""
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = T.StructType([*df.schema.fields, T.StructField("_part", T.IntegerType()), T.StructField("_no", T.LongType()), *(T.StructField(new, T.LongType()) for new in sums)])
    ordered = df.repartitionByRange(*order).sortWithinPartitions(*order)
    parts = stored(ordered.mapInArrow(_sums(list(sums.values()), group, to_arrow_schema(schema)), schema))
    key = F.col(group) if group else F.lit(0).cast("bigint")
    ends = parts.groupBy("_part").agg(F.min_by(key, "_no").alias("_first"), F.max_by(key, "_no").alias("_last"), *(F.max_by(new, "_no").alias(f"_t_{new}") for new in sums))
    seen = ends.select("_part", F.col("_first").alias("_carry_of"), F.lit(0).alias("_turn"), *(F.lit(0).cast("bigint").alias(f"_t_{new}") for new in sums))
    seen = seen.unionByName(ends.select("_part", F.col("_last").alias("_carry_of"), F.lit(1).alias("_turn"), *(f"_t_{new}" for new in sums)))
    before = Window.partitionBy("_carry_of").orderBy("_part", "_turn").rowsBetween(Window.unboundedPreceding, -1)
    carried = seen.select("_part", "_carry_of", "_turn", *(F.coalesce(F.sum(f"_t_{new}").over(before), F.lit(0)).alias(f"_b_{new}") for new in sums)).where("_turn = 0").drop("_turn")
    # one row for each part of the range exchange: their number is a setting of the session, whatever the table holds
    out = parts.join(F.broadcast(carried.withColumnRenamed("_part", "_of")), (F.col("_part") == F.col("_of")) & (key == F.col("_carry_of")), "left")
    return out.select(*df.columns, *((F.col(new) + F.coalesce(F.col(f"_b_{new}"), F.lit(0))).alias(new) for new in sums))
