"""Table functions called from SQL against the DataFrame calls."""

import random

import pytest
from pyspark.sql import functions as F

from bitweave.operators import psi, table_functions
from bitweave.operators.packets import parse_packets


@pytest.fixture(scope="module")
def packets(spark):
    r = random.Random(3)
    rows = [(k, r.choice([0, 256, 257]), r.choice([0, 2, 0x42]), k % 5, k % 3, bytes(r.randrange(256) for _ in range(r.choice([1, 40, 183, 600, 1000])))) for k in range(60)]
    sections = spark.createDataFrame(rows, "place long, pid int, table_id int, extension int, version int, body binary")
    whole = psi.pack_sections(sections).collect()
    raw = []
    for x in whole:
        data = bytearray(x.raw)
        if r.random() < 0.05:
            data[-1] ^= 1  # a check that fails, or stuffing that isn't
        if r.random() > 0.03:  # packets that are lost
            raw.append((x.pkt_idx, bytes(data)))
    return parse_packets(spark.createDataFrame(raw, "pkt_idx long, raw binary"))


def test_sections_by_sql_equal_the_call(spark, packets):
    table_functions.register(spark)
    got = spark.sql("SELECT * FROM psi_sections(TABLE({p}) PARTITION BY pid ORDER BY pkt_idx)", p=table_functions.payloads(packets).repartition(5))
    want = psi.sections(packets, [0, 256, 257])
    assert got.schema.names == want.schema.names
    rows = sorted(map(tuple, got.collect()))
    assert rows == sorted(map(tuple, want.collect())) and len(rows) > 30 and {x[8] for x in rows} == {True, False}


def test_unit_spans_end_with_the_table(spark):
    table_functions.register(spark)
    rows = [(0, 1, False), (1, 1, True), (2, 2, True), (3, 1, False), (4, 1, True), (5, 2, False)]
    packets = spark.createDataFrame(rows, "pkt_idx long, pid int, pusi boolean")
    got = spark.sql("SELECT * FROM payload_unit_spans(TABLE({p}) PARTITION BY pid ORDER BY pkt_idx)", p=packets.repartition(3)).collect()
    assert sorted(map(tuple, got)) == [(1, 1, 1, 3, 2), (1, 2, 4, 4, 1), (2, 1, 2, 5, 2)]
    assert spark.sql("SELECT * FROM payload_unit_spans(TABLE({p}) PARTITION BY pid ORDER BY pkt_idx)", p=packets.limit(0)).collect() == []


def test_tables_that_lack_columns_are_refused(spark):
    table_functions.register(spark)
    with pytest.raises(Exception, match="the table lacks payload"):
        spark.sql("SELECT * FROM psi_sections(TABLE({p}) PARTITION BY pid ORDER BY pkt_idx)", p=spark.range(3).select(F.col("id").alias("pkt_idx"), F.lit(1).alias("pid"), F.lit(True).alias("pusi"))).collect()
