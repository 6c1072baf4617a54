"""Code dictionaries as one dimension table: what a format calls its codes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def dictionaries() -> dict[str, dict[int, str]]:
    from ..operators.packets import PID_NAMES
    from ..sources import containers, syntax, video

    tags = {k: v.partition(" ")[0] for k, v in syntax.DESCRIPTORS.items()}
    elements = dict(containers._MASTERS) | {k: name for k, (name, _) in containers._LEAVES.items()}
    boxes = {int.from_bytes(k.encode("latin-1"), "big"): k for k in containers._BOX_PARENTS}
    return {"pid": PID_NAMES, "h264": video.AVC, "h265": video.HEVC, "h266": video.VVC, "av1": video.OBU, "sei": video.SEI, "tlv": containers.TLV_TYPES, "descriptor": tags, "ebml": elements, "box": boxes}


def names(spark: SparkSession) -> DataFrame:
    """dictionary, code, name: some hundreds of rows."""
    rows = [(d, code, name) for d, codes in dictionaries().items() for code, name in codes.items()]
    return spark.createDataFrame(rows, "dictionary string, code long, name string")


def with_name(rows: DataFrame, dictionary: str, code_col: str, new: str = "name") -> DataFrame:
    """Adds the name of a code, or null."""
    own = names(rows.sparkSession).where(F.col("dictionary") == dictionary).select(F.col("code").alias("_code"), F.col("name").alias(new))
    return rows.join(F.broadcast(own), F.col(code_col) == F.col("_code"), "left").drop("_code")
