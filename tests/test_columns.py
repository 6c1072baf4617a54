"""Parsers of text as Column expressions against the plan-time ones, codebooks of many texts, and the catalogue of checks."""

from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from bitweave.functions import clocks, crc, huffman, literals, scalars

# Published checks of "123456789", and those that the parameter rows give themselves where they differ.
_CHECKS = "F4 15 7E A1 A1 D0 25 BB3D FEE8 9ECF 007E EA82 C2B7 D64E 44C2 6F91 63D0 D0DB 0FB3 B4C8 906E 31C3 4B37 2189 29B1 E5CC 21CF02 7979BD 1F23B8 CBF43926 FC891918 E3069283 87315576 0376E6E7 765E7680 3010BF7F 340BC6D9 BD0BE338 46A5A9388A5BEFFE 62EC59E3F1A4F00A CAA717168609F281".split()
_OWN = "F4 15 7E A4 A1 D0 25 BB3D FEE8 9ECF 1ED5 95E3 4449 CE3C B4C8 6F91 DB52 D0DB 0FB3 44C2 DE76 31C3 4B37 2189 29B1 E5CC 21CF02 7979BD 1F23B8 CBF43926 0376E6E7 A71C05DF 69EA3735 0376E6E7 FC891918 3010BF7F 340BC6D9 BD0BE338 46A5A9388A5BEFFE 93BF20A0F4B68CB8 CAA717168609F281".split()

TEXTS = ["10", "010", "0x1F", "1Fh", "0b101", "101b", "17o", "ff", "-12", "+7", "zz", "", " 5 ", "0", "00", "08", "1b", "0b", "b", "0x", "-", "--1", "1-2", "0B11", "1FH", "-0x10", "0o17", "9223372036854775807", "12 3", "\t42\n", "bee", "0bee"]


@pytest.mark.parametrize("radix", [None, 2, 8, 10, 16])
def test_int_column_equals_plan_time_parser(spark, radix):
    rows = spark.createDataFrame([(x,) for x in TEXTS] + [(None,)], "text string").select("text", literals.int_value(F.col("text"), radix).alias("value")).collect()
    want = [literals.parse_int(x, radix) for x in TEXTS]  # Python's numbers have no end
    assert [r["value"] for r in rows] == [x if x is None or abs(x) < 1 << 63 else None for x in want] + [None]


def test_numbers_beyond_64_bits_are_null(spark):
    texts = ["9223372036854775808", "-9223372036854775808", "0x" + "f" * 17, "0x8000000000000000", "0b" + "1" * 65, "0" + "7" * 30, "0x00000000000000000001", "1" * 60 + "o"]
    rows = spark.createDataFrame([(x,) for x in texts], "text string").select(literals.int_value(F.col("text")).alias("value")).collect()
    assert [r["value"] for r in rows] == [None] * 6 + [1, None]


def test_fractions_and_sets_equal_plan_time_parsers(spark):
    texts = ["30000/1001", "25", "29.97", "60:1", "x", "1/0", "0/5", "0", "-6/4", "+0.50", " 7 / 21 ", "1.5/3", "", "/2", "1/", "0/0", "999999999999999999/3"]
    rows = spark.createDataFrame([(x,) for x in texts] + [(None,)], "text string").select(literals.rational_value(F.col("text")).alias("v")).collect()
    want = [literals.parse_rational(x) for x in texts]
    assert [r["v"] and Fraction(r["v"]["n"], r["v"]["d"]) for r in rows] == [*want, None]
    assert all(r["v"] is None or (r["v"]["n"], r["v"]["d"]) == (x.numerator, x.denominator) for r, x in zip(rows, want, strict=False))
    texts = ["a,b;c", "a,,b", "a,", "", ".x:y.", "no delimiter", ",", ",,"]
    rows = spark.createDataFrame([(x,) for x in texts], "text string").select(literals.split_parts(F.col("text")).alias("v")).collect()
    assert [r["v"] for r in rows] == [literals.split_set(x) for x in texts]


def test_many_codebooks(spark):
    texts = [("a", "{0, 1; 0x0}\n(1|2|2) 2,3,6 3 3 7"), ("b", "5 1 0 6 1 0 7"), ("c", ""), ("d", None), ("e", "-4 2 3")]
    book = huffman.codebook_rows(spark.createDataFrame(texts, "name string, text string"), "text", ("name",))
    assert sorted(map(tuple, book.collect())) == [("a", 0, 1, 0), ("a", 1, 2, 2), ("a", 2, 3, 6), ("a", 3, 3, 7), ("b", 5, 1, 0), ("b", 6, 1, 0), ("e", -4, 2, 3)]
    stats = {r["name"]: tuple(r)[1:] for r in huffman.codebook_stats(book.unionByName(spark.createDataFrame([("b", 8, 2, 1)], book.schema)), ("name",)).collect()}
    assert stats == {"a": (4, 4, 1, 3, 1 << 60, 0, 7), "b": (3, 2, 1, 2, (1 << 60) + (1 << 58), 2, 4), "e": (1, 1, 2, 2, 1 << 58, 0, 3)}


def test_catalogue(spark):
    rows = {r["name"]: (r["check"], r["check_standard"]) for r in crc.catalogue(spark).collect()}
    assert rows == {name: (own, check) for name, own, check in zip(crc.parameters(), _OWN, _CHECKS, strict=True)}


def test_whole_quotients_just_below_a_number(spark):
    fractions = [2298237, 4596474, 5778449, 2**32 - 1, 0]  # the first three stand less than half a millionth below a whole number of 100 ns
    s = 3_900_000_000
    rows = spark.createDataFrame([(s, f) for f in fractions], "s long, f long")
    got = rows.select("f", clocks.ntp_to_hns(F.col("s"), F.col("f")).alias("hns"), clocks.ntp_to_90k(F.col("s"), F.col("f")).alias("t90k")).collect()
    assert [(x.hns, x.t90k) for x in got] == [(s * 10**7 + f * 10**7 // 2**32, (s * 90_000 + f * 90_000 // 2**32) % 2**33) for f in fractions]
    rates = [(10**9, 72_000_000_000_000_007), (10**6, 216 * 10**12 + 1), (188, 1)]
    got = spark.createDataFrame(rates, "n long, t long").select(clocks.rate_bps(F.col("n"), F.col("t")).alias("r")).collect()
    assert [x.r for x in got] == [n * 216_000_000 // t for n, t in rates]


@pytest.mark.parametrize("name", ["ntp_packets", "ntp_times", "scalar_text", "structure_fields"])
def test_queries_of_large_keys_equal_their_sql(spark, tmp_path, name):
    import duckdb

    from bitweave.catalog import ORACLES, QUERIES

    con = duckdb.connect()
    keys = "SELECT unnest([1, 10737, 10738, 262143, 262144, 1430224, 1430225, 3000000, 7200000, 36000000])"
    con.sql(f"COPY (SELECT k AS event_id, k % 3 AS user_id FROM ({keys}) x(k) UNION ALL SELECT 2 * k, 1 FROM range(21000, 22000) x(k)) TO '{tmp_path}/events.parquet'")
    con.sql(f"COPY (SELECT CAST(k AS BIGINT) AS p_partkey, 'part ' || k AS p_name, CAST(k % 50 AS INT) AS p_size FROM ({keys}) x(k) WHERE k < 9000000) TO '{tmp_path}/part.parquet'")
    for table in ("events", "part"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{tmp_path}/{table}.parquet'")
    want = con.sql(ORACLES[name])
    assert sorted(map(tuple, QUERIES[name](spark, str(tmp_path)).select(want.columns).collect())) == sorted(want.fetchall())


def test_seconds_that_a_double_cannot_hold_in_microseconds(spark, tmp_path):
    import duckdb

    from bitweave.catalog import ORACLES, QUERIES

    con = duckdb.connect()
    con.sql(f"COPY (SELECT CAST(k AS BIGINT) AS p_partkey, 'part ' || k AS p_name, CAST(k % 50 AS INT) AS p_size FROM (SELECT unnest([574463, 574467, 1199999, 2400001, 7199998]) + i AS k FROM range(-9, 10) r(i))) TO '{tmp_path}/part.parquet'")
    con.sql(f"CREATE VIEW part AS SELECT * FROM '{tmp_path}/part.parquet'")
    want = con.sql(ORACLES["scalar_text"])
    assert sorted(map(tuple, QUERIES["scalar_text"](spark, str(tmp_path)).select(want.columns).collect())) == sorted(want.fetchall())
    # whole numbers stay exact
    s = 574463 * 1_000_003 + 2_000_000_000
    whole = spark.createDataFrame([(s,)], "s long").select(scalars.seconds_since(1904, F.col("s")), scalars.seconds_since(1904, F.col("s").cast("double"))).first()
    assert tuple(whole) == ("20171-06-09 09:49:49", "20171-06-09 09:49:48")
