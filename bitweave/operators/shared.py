"""Tables in the folder that the driver and all executors share (``spark.checkpoint.dir``)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """A new folder there. A temporary one is set only where the setting is missing and Spark is local."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        import tempfile

        root = f"file://{tempfile.mkdtemp(prefix='shared-')}"
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """A table written there and read back: lineage ends, and a lost executor loses nothing."""
    at = shared_folder(df.sparkSession)
    schema = df.schema
    df.write.option("compression", "zstd").parquet(at)
    return df.sparkSession.read.schema(schema).parquet(at)
