"""Streams cut into batches anywhere: what was closed and what is still open are together the batch result."""

import pytest

from bitweave.operators import clock_reports as reports
from bitweave.streaming import units


def _packets(spark):
    rows = [(k, 10 + k % 3, k % 7 == 0 and k > 5, (k * 90_000_000) % (1 << 30), bytes([k]) * (k % 4)) for k in range(80)]
    return spark.createDataFrame(rows, "pkt_idx long, pid int, pusi boolean, atc long, payload binary")


def _feed(query, source, sink, state, schema, spark):
    stream = query(spark.readStream.schema(schema).parquet(source))
    stream.writeStream.format("parquet").option("path", sink).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()


@pytest.mark.parametrize("cuts", [(80,), (1, 2, 80), (9, 33, 34, 80)])
def test_closed_and_open_units_are_the_batch_after_every_cut(spark, tmp_path, cuts):
    df, at = _packets(spark), str(tmp_path)
    before = 0
    for cut in cuts:
        df.where(f"pkt_idx >= {before} and pkt_idx < {cut}").coalesce(1).write.mode("append").parquet(f"{at}/in")
        before = cut
        _feed(units.payload_units, f"{at}/in", f"{at}/out", f"{at}/state", df.schema, spark)
        got = spark.read.schema(units.UNITS).parquet(f"{at}/out").unionByName(units.open_units(spark, f"{at}/state"))
        want = reports.payload_units(df.where(f"pkt_idx < {cut}"))
        key = lambda r: (r["pid"], r["unit"], r["first_pkt"], r["last_pkt"], r["n_packets"])
        assert sorted(map(key, got.collect())) == sorted(map(key, want.collect()))
        assert got.where("elapsed27 is null").count() == want.where("duration is null").count()


def test_an_earlier_batch_can_be_read_and_reading_changes_nothing(spark, tmp_path):
    df, at = _packets(spark), str(tmp_path)
    for lo, hi in ((0, 30), (30, 80)):
        df.where(f"pkt_idx >= {lo} and pkt_idx < {hi}").coalesce(1).write.mode("append").parquet(f"{at}/in")
        _feed(units.payload_units, f"{at}/in", f"{at}/out", f"{at}/state", df.schema, spark)
    first = units.open_units(spark, f"{at}/state", 0)
    key = lambda r: (r["pid"], r["unit"], r["last_pkt"])
    want = reports.payload_units(df.where("pkt_idx < 30")).where("duration is null")
    assert sorted(map(key, first.collect())) == sorted(map(key, want.collect())) == sorted(map(key, first.collect()))


def test_short_headers_come_out_at_the_end(spark, tmp_path):
    df, at = _packets(spark), str(tmp_path)
    df.coalesce(1).write.parquet(f"{at}/in")
    _feed(lambda s: units.header_windows(s, 5), f"{at}/in", f"{at}/out", f"{at}/state", df.schema, spark)
    rows = spark.read.schema(units.HEADERS).parquet(f"{at}/out").unionByName(units.open_headers(spark, f"{at}/state")).collect()
    want, opened = {}, {}
    for r in sorted(df.collect(), key=lambda r: r["pkt_idx"]):
        if r["pusi"]:
            opened[r["pid"]] = opened.get(r["pid"], 0) + 1
        if unit := opened.get(r["pid"]):
            want[r["pid"], unit] = (want.get((r["pid"], unit), b"") + bytes(r["payload"]))[:5]
    assert {(r["pid"], r["unit"]): bytes(r["head"]) for r in rows} == want and len(rows) == len(want)


def test_a_stream_without_starts_holds_no_unit(spark, tmp_path):
    df, at = _packets(spark).where("not pusi"), str(tmp_path)
    df.coalesce(1).write.parquet(f"{at}/in")
    _feed(units.payload_units, f"{at}/in", f"{at}/out", f"{at}/state", df.schema, spark)
    assert units.open_units(spark, f"{at}/state").count() == 0
