"""Whole binary objects to rows: one generator of rows per format, run over Arrow batches."""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

Parser = Callable[[bytes], Iterator[tuple]]


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """path, data of each file. A file is one row (2 GB at most); fixed-length packets have their own source."""
    return spark.read.format("binaryFile").load(path).selectExpr("path", "content AS data")


#: What a parser may meet in bytes that aren't what they claim to be.
BROKEN = (EOFError, IndexError, KeyError, ValueError, OverflowError, struct.error)


def parse_blobs(blobs: DataFrame, parser: Parser, ddl: str, keys: tuple[str, ...] = ("path",), data_col: str = "data", error_col: str | None = None) -> DataFrame:
    """Rows of ``parser`` for each blob, led by the blob's keys.

    A blob that breaks off yields what it held until there.  With ``error_col``
    it yields one row more, with nothing but its keys and what went wrong.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    own = T.StructType.fromDDL(ddl)
    extra = [T.StructField(error_col, T.StringType())] if error_col else []
    schema = T.StructType([blobs.schema[k] for k in keys] + own.fields + extra)
    arrow = to_arrow_schema(schema)
    nothing, fine = (None,) * len(own.fields), (None,) * len(extra)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            heads = list(zip(*(batch.column(k).to_pylist() for k in keys), strict=True))
            rows: list[tuple] = []
            for head, data in zip(heads, batch.column("_data").to_pylist(), strict=True):
                try:
                    for row in parser(data or b""):
                        rows.append((*head, *row, *fine))
                        if len(rows) >= 20_000:
                            yield _batch(rows, arrow)
                            rows = []
                except BROKEN as error:
                    if error_col:
                        rows.append((*head, *nothing, f"{type(error).__name__}: {error}"))
            if rows:
                yield _batch(rows, arrow)

    return blobs.selectExpr(*(f"`{k}`" for k in keys), f"`{data_col}` AS _data").mapInArrow(run, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.record_batch([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
