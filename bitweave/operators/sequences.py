"""Video sequence boundaries over a table of access units: flags by lag, ordinals by running sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import with_lag, with_running_sum


def _changed(a: Column, b: Column) -> Column:
    """Compared only where both sides have a value."""
    return F.coalesce(a != b, F.lit(False))


def _ratio_changed(n1: Column, d1: Column, n2: Column, d2: Column) -> Column:
    """n1/d1 against n2/d2 by cross-multiplication, where all are present."""
    return F.coalesce(n1.cast("decimal(20,0)") * d2.cast("decimal(20,0)") != n2.cast("decimal(20,0)") * d1.cast("decimal(20,0)"), F.lit(False))


#: What an access unit's active parameter set says; all but the size may be null.
FORMAT = ("width", "height", "aspect_ratio_idc", "sar_width", "sar_height", "primaries", "transfer", "matrix", "num_units_in_tick", "time_scale")


def number_sequences(units: DataFrame, by: tuple[str, ...] = (), order: str = "au_no") -> DataFrame:
    """Adds vseq and cvs (from 0, cvs within vseq) to access units with FORMAT columns, is_idr, all_intra and has_sps.

    A video sequence starts at the first unit, or where the picture size changes, or
    the aspect ratio, the colours or the tick, each compared only when known on both
    sides.  A coded sequence starts at an IDR picture, or at an all-intra one that
    brings a parameter set.
    """
    rows = with_lag(units, {f"_{c}": c for c in FORMAT} | {"_seen": order}, order, by)
    c = F.col
    shape = _changed(c("width"), c("_width")) | _changed(c("height"), c("_height"))
    free = (c("aspect_ratio_idc") == 255) & (c("_aspect_ratio_idc") == 255)
    aspect = _changed(c("aspect_ratio_idc"), c("_aspect_ratio_idc")) | F.coalesce(free & _ratio_changed(c("sar_width"), c("sar_height"), c("_sar_width"), c("_sar_height")), F.lit(False))
    colour = _changed(c("primaries"), c("_primaries")) | _changed(c("transfer"), c("_transfer")) | _changed(c("matrix"), c("_matrix"))
    tick = _ratio_changed(c("num_units_in_tick"), c("time_scale"), c("_num_units_in_tick"), c("_time_scale"))
    rows = rows.withColumn("_new_vseq", c("_seen").isNull() | shape | aspect | colour | tick)
    rows = rows.withColumn("_new_cvs", c("_new_vseq") | c("is_idr") | (c("all_intra") & c("has_sps")))
    rows = with_running_sum(rows, {"vseq": c("_new_vseq").cast("int"), "_cvs": c("_new_cvs").cast("int")}, order, by)
    first = rows.where("_new_vseq").select(*(c(k).alias(f"_k{i}") for i, k in enumerate(by)), c("vseq").alias("_v"), c("_cvs").alias("_first"))
    same = c("vseq") == c("_v")
    for i, k in enumerate(by):
        same = same & c(k).eqNullSafe(c(f"_k{i}"))
    out = rows.join(first, same)
    return out.select(*units.columns, (c("vseq") - 1).alias("vseq"), (c("_cvs") - c("_first")).alias("cvs"))
