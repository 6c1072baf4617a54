"""Functions that SQL can call on a table of packets: sections and payload units.

    SELECT * FROM psi_sections(TABLE(p) PARTITION BY pid ORDER BY pkt_idx)
    SELECT * FROM payload_unit_spans(TABLE(p) PARTITION BY pid ORDER BY pkt_idx)

Each holds one unit of one PID at a time.  A PID is one partition, sorted on disk
where it is large; ``psi.sections`` also cuts a PID's units into stretches.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from .psi import _sections

_L, _I, _B = T.LongType, T.IntegerType, T.BooleanType
_SECTION = [("pkt_idx", _L), ("pid", _I), ("table_id", _I), ("extension", _I), ("version", _I), ("current", _B), ("section_number", _I), ("last_section", _I), ("crc_ok", _B), ("body", T.BinaryType)]
_SPAN = [("pid", _I), ("unit", _L), ("first_pkt", _L), ("last_pkt", _L), ("n_packets", _L)]


def _result(table: AnalyzeArgument, needs: tuple[str, ...], columns: list) -> AnalyzeResult:
    if not table.isTable:
        raise ValueError("the argument must be a table: TABLE(p) PARTITION BY pid ORDER BY pkt_idx")
    lacking = [c for c in needs if c not in table.dataType.fieldNames()]
    if lacking:
        raise ValueError(f"the table lacks {', '.join(lacking)}; it must have {', '.join(needs)}")
    return AnalyzeResult(T.StructType([T.StructField(n, t()) for n, t in columns]))


class PsiSections:
    """The sections of a PID, each at the packet that ends it. A unit's last section may end in the next unit's first packet."""

    def __init__(self):
        self.held: list[tuple] = []
        self.pid = None

    @staticmethod
    def analyze(table: AnalyzeArgument) -> AnalyzeResult:
        return _result(table, ("pkt_idx", "pid", "pusi", "payload"), _SECTION)

    def eval(self, row: Row) -> Iterator[tuple]:
        own = row["pkt_idx"], row["pusi"], bytes(row["payload"] or b"")
        if row["pusi"] and self.held:
            yield from _sections([*self.held, (*own, True)], self.pid)
            self.held = []
        if row["pusi"] or self.held:
            self.pid = row["pid"]
            self.held.append((*own, False))

    def terminate(self) -> Iterator[tuple]:
        yield from _sections(self.held, self.pid)


class PayloadUnitSpans:
    """The payload units of a PID: number (from 1), first and last packet, packets. The last unit ends with the table."""

    def __init__(self):
        self.pid, self.unit, self.first, self.last, self.n = None, 0, 0, 0, 0

    @staticmethod
    def analyze(table: AnalyzeArgument) -> AnalyzeResult:
        return _result(table, ("pkt_idx", "pid", "pusi"), _SPAN)

    def _closed(self) -> Iterator[tuple]:
        if self.unit:
            yield self.pid, self.unit, self.first, self.last, self.n

    def eval(self, row: Row) -> Iterator[tuple]:
        if row["pusi"]:
            yield from self._closed()
            self.pid, self.unit, self.first, self.n = row["pid"], self.unit + 1, row["pkt_idx"], 0
        self.last, self.n = row["pkt_idx"], self.n + 1

    def terminate(self) -> Iterator[tuple]:
        yield from self._closed()


def register(spark: SparkSession) -> None:
    """Makes psi_sections and payload_unit_spans known to the session's SQL."""
    spark.udtf.register("psi_sections", F.udtf(PsiSections))
    spark.udtf.register("payload_unit_spans", F.udtf(PayloadUnitSpans))


def payloads(packets: DataFrame) -> DataFrame:
    """pkt_idx, pid, pusi, payload of packets that have one: what the functions take."""
    return packets.where(F.col("afc").bitwiseAND(F.lit(1)) > 0).select("pkt_idx", "pid", "pusi", F.expr("substring(raw, payload_at + 1)").alias("payload"))
