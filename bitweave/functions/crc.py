"""Cyclic redundancy checks by name: 41 parameter rows, and the published parameters where those differ."""

from __future__ import annotations

from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Name, width, polynomial, initial register, final xor, reflected.
ROWS = """
crc-8 8 07 00 00 0
crc-8-darc 8 39 00 00 1
crc-8-i-code 8 1D FD 00 0
crc-8-itu 8 07 55 55 0
crc-8-maxim 8 31 00 00 1
crc-8-rohc 8 07 FF 00 1
crc-8-wcdma 8 9B 00 00 1
crc-16 16 8005 0000 0000 1
crc-16-buypass 16 8005 0000 0000 0
crc-16-dds-110 16 8005 800D 0000 0
crc-16-dect 16 0589 0001 0001 0
crc-16-dnp 16 3D65 FFFF FFFF 1
crc-16-en-13757 16 3D65 FFFF FFFF 0
crc-16-genibus 16 1021 0000 FFFF 0
crc-16-maxim 16 8005 FFFF FFFF 1
crc-16-mcrf4xx 16 1021 FFFF 0000 1
crc-16-riello 16 1021 554D 0000 1
crc-16-t10-dif 16 8BB7 0000 0000 0
crc-16-teledisk 16 A097 0000 0000 0
crc-16-usb 16 8005 0000 FFFF 1
x-25 16 1021 0000 FFFF 1
xmodem 16 1021 0000 0000 0
modbus 16 8005 FFFF 0000 1
kermit 16 1021 0000 0000 1
crc-ccitt-false 16 1021 FFFF 0000 0
crc-aug-ccitt 16 1021 1D0F 0000 0
crc-24 24 864CFB B704CE 000000 0
crc-24-flexray-a 24 5D6DCB FEDCBA 000000 0
crc-24-flexray-b 24 5D6DCB ABCDEF 000000 0
crc-32 32 04C11DB7 FFFFFFFF FFFFFFFF 1
crc-32-bzip2 32 04C11DB7 FFFFFFFF 00000000 0
crc-32c 32 1EDC6F41 00000000 FFFFFFFF 1
crc-32d 32 A833982B 00000000 FFFFFFFF 1
crc-32-mpeg 32 04C11DB7 FFFFFFFF 00000000 0
posix 32 04C11DB7 FFFFFFFF FFFFFFFF 0
crc-32q 32 814141AB 00000000 00000000 0
jamcrc 32 04C11DB7 FFFFFFFF 00000000 1
xfer 32 000000AF 00000000 00000000 0
crc-64 64 000000000000001B 0000000000000000 0000000000000000 1
crc-64-we 64 42F0E1EBA9EA3693 0000000000000000 FFFFFFFFFFFFFFFF 0
crc-64-jones 64 AD93D23594C935A9 FFFFFFFFFFFFFFFF 0000000000000000 1
"""
# Published (initial register, final xor) where the rows above differ.
PUBLISHED = {
    "crc-8-itu": (0x00, 0x55), "crc-16-dect": (0x0000, 0x0001), "crc-16-dnp": (0x0000, 0xFFFF), "crc-16-en-13757": (0x0000, 0xFFFF), "crc-16-genibus": (0xFFFF, 0xFFFF), "crc-16-maxim": (0x0000, 0xFFFF), "crc-16-riello": (0xB2AA, 0x0000),
    "crc-16-usb": (0xFFFF, 0xFFFF), "x-25": (0xFFFF, 0xFFFF), "crc-32-bzip2": (0xFFFFFFFF, 0xFFFFFFFF), "crc-32c": (0xFFFFFFFF, 0xFFFFFFFF), "crc-32d": (0xFFFFFFFF, 0xFFFFFFFF), "posix": (0x00000000, 0xFFFFFFFF), "crc-64-we": (0xFFFFFFFFFFFFFFFF, 0xFFFFFFFFFFFFFFFF),
}


@cache
def parameters() -> dict[str, tuple[int, int, int, int, bool]]:
    """name: (width, polynomial, initial register, final xor, reflected)."""
    out = {}
    for line in ROWS.split("\n"):
        if line:
            name, width, poly, init, last, reflected = line.split()
            out[name] = int(width), int(poly, 16), int(init, 16), int(last, 16), reflected == "1"
    return out


def _mirror(x: int, width: int) -> int:
    return int(format(x, f"0{width}b")[::-1], 2)


@cache
def _table(width: int, poly: int) -> list[int]:
    """The register after each top byte, for a register of at least 8 bits that shifts left."""
    top, mask, out = 1 << (width - 1), (1 << width) - 1, []
    for byte in range(256):
        r = byte << (width - 8)
        for _ in range(8):
            r = ((r << 1) ^ poly) & mask if r & top else (r << 1) & mask
        out.append(r)
    return out


LANE = 1 << 14
_MIRRORED = bytes(_mirror(x, 8) for x in range(256))


def crc(data: bytes, name: str, standard: bool = False) -> int:
    width, poly, init, last, reflected = parameters()[name]
    if standard:
        init, last = PUBLISHED.get(name, (init, last))
    table, mask, r = _table(width, poly), (1 << width) - 1, init
    for byte in data.translate(_MIRRORED) if reflected else data:
        r = ((r << 8) & mask) ^ table[(r >> (width - 8)) ^ byte]
    return _mirror(r, width) ^ last if reflected else r ^ last


def _start(name: str, standard: bool) -> tuple[int, int]:
    """(initial register, final xor)."""
    _, _, init, last, _ = parameters()[name]
    return PUBLISHED.get(name, (init, last)) if standard else (init, last)


def registers(rows: list[bytes], name: str, init: int = 0) -> np.ndarray:
    """The register after each of many byte strings, side by side: one step a byte position over all that reach it."""
    width, poly, _, _, reflected = parameters()[name]
    lengths = np.array([len(x) for x in rows], np.int64)
    long = np.flatnonzero(lengths > 2 * LANE)
    if len(long):
        out = np.empty(len(rows), np.uint64)
        short = np.flatnonzero(lengths <= 2 * LANE)
        out[short] = registers([rows[k] for k in short.tolist()], name, init)
        for k in long.tolist():
            out[k] = _long_register(rows[k], name, init)
        return out
    order = np.argsort(-lengths, kind="stable")
    starts, ordered = (np.cumsum(lengths) - lengths)[order], lengths[order]
    data = b"".join(rows)
    flat = np.frombuffer(data.translate(_MIRRORED) if reflected else data, np.uint8)
    table, u = np.array(_table(width, poly), np.uint64), np.uint64
    mask, shift = u((1 << width) - 1), u(width - 8)
    register = np.full(len(rows), init, np.uint64)
    for k in range(int(ordered[0]) if len(rows) else 0):
        n = int(np.searchsorted(-ordered, -k, side="left"))  # so many are longer than k bytes
        r = register[:n]
        register[:n] = ((r << u(8)) & mask) ^ table[((r >> shift) ^ flat[starts[:n] + k]).astype(np.int64)]
    out = np.empty(len(rows), np.uint64)
    out[order] = register
    return out


def _long_register(data: bytes, name: str, init: int) -> int:
    """One long byte string, cut into lanes that run side by side; their registers are shifted to its end and added."""
    lanes = [data[k : k + LANE] for k in range(0, len(data), LANE)]
    after = len(data) - np.minimum(np.arange(1, len(lanes) + 1) * LANE, len(data))
    whole = np.bitwise_xor.reduce(shifted(registers(lanes, name), after, name))
    return int(whole ^ shifted(np.array([init], np.uint64), np.array([len(data)]), name)[0])


@cache
def shifts(width: int, poly: int) -> list[list[int]]:
    """Matrices over GF(2) that move a register past 2**k zero bytes, for k up to 62; a matrix is what becomes of each bit."""
    table, mask = _table(width, poly), (1 << width) - 1
    one = [((1 << b << 8) & mask) ^ table[1 << b >> (width - 8)] for b in range(width)]
    out = [one]
    for _ in range(62):
        m = out[-1]
        square = []
        for column in m:
            total = 0
            for b in range(width):
                if column >> b & 1:
                    total ^= m[b]
            square.append(total)
        out.append(square)
    return out


def shifted(register: np.ndarray, n_bytes: np.ndarray, name: str) -> np.ndarray:
    """Each register after as many zero bytes as ``n_bytes`` says: what a chunk adds to the check of a stream that goes on so far after it."""
    width, poly = parameters()[name][:2]
    r, left, u = register.astype(np.uint64), np.asarray(n_bytes, np.int64), np.uint64
    for k in range(int(left.max(initial=0)).bit_length()):
        moving = np.flatnonzero(left >> k & 1)
        if len(moving):
            old, new = r[moving], np.zeros(len(moving), np.uint64)
            for b, column in enumerate(shifts(width, poly)[k]):
                new ^= ((old >> u(b)) & u(1)) * u(column)
            r[moving] = new
    return r


def _mirror_many(register: np.ndarray, width: int) -> np.ndarray:
    out = np.zeros(len(register), np.uint64)
    for k in range(width):
        out |= ((register >> np.uint64(k)) & np.uint64(1)) << np.uint64(width - 1 - k)
    return out


def crc_many(rows: list[bytes], name: str, standard: bool = False) -> np.ndarray:
    """The checks of many byte strings."""
    init, last = _start(name, standard)
    register = registers(rows, name, init)
    return (_mirror_many(register, parameters()[name][0]) if parameters()[name][4] else register) ^ np.uint64(last)


def crc_aggregate(rows: DataFrame, data: str, after: str, by: tuple[str, ...] = (), names: tuple[str, ...] | None = None, standard: bool = False) -> DataFrame:
    """The checks of streams whose chunks are rows: by, name, n_bytes, check (upper-case hex).

    ``after``: how many bytes of the stream follow a chunk.  The register of a
    stream is the sum (xor) of what each chunk adds, so this is an ordinary
    aggregate: chunks may stand in any order and partition, partial sums are made
    before the shuffle, and a group never meets in one place.  A null chunk is empty.
    """
    names = tuple(names or parameters())

    @F.pandas_udf("array<bigint>")
    def adds(chunk: pd.Series, n: pd.Series) -> pd.Series:
        values = [x or b"" for x in chunk]
        columns = [shifted(registers(values, name), n.to_numpy(), name).view(np.int64) for name in names]
        return pd.Series(list(np.stack(columns, 1)))

    parts = rows.select(*by, F.coalesce(F.octet_length(data), F.lit(0)).cast("bigint").alias("_n"), adds(F.col(data), F.col(after)).alias("_add"))
    sums = parts.groupBy(*by).agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("n_bytes"), *(F.coalesce(F.bit_xor(F.col("_add")[k]), F.lit(0).cast("bigint")).alias(f"_r{k}") for k in range(len(names))))

    @F.pandas_udf("array<string>")
    def checks(n: pd.Series, added: pd.Series) -> pd.Series:
        out = []
        for k, name in enumerate(names):
            (width, _, _, _, reflected), (init, last) = parameters()[name], _start(name, standard)
            r = np.array([x[k] for x in added], np.int64).view(np.uint64) ^ shifted(np.full(len(n), init, np.uint64), n.to_numpy(), name)
            r = (_mirror_many(r, width) if reflected else r) ^ np.uint64(last)
            out.append([format(int(x), f"0{width // 4}X") for x in r])
        return pd.Series([list(x) for x in zip(*out, strict=True)])

    found = F.explode(F.arrays_zip(F.lit(list(names)).alias("name"), checks("n_bytes", F.array(*(f"_r{k}" for k in range(len(names))))).alias("check")))
    return sums.select(*by, "n_bytes", found.alias("_x")).select(*by, "_x.name", "n_bytes", "_x.check")


def crc_in_order(rows: DataFrame, data: str, order: str, by: tuple[str, ...] = (), names: tuple[str, ...] | None = None, standard: bool = False) -> DataFrame:
    """``crc_aggregate`` of the rows' bytes one after the other by an integer column, that has no two equal values in a stream."""
    from ..operators.ordered import with_running_sum

    size = F.coalesce(F.octet_length(data), F.lit(0)).cast("bigint")
    upto = with_running_sum(rows.select(*by, order, data), {"_upto": size}, order, by)
    totals = rows.groupBy(*by).agg(F.sum(size).alias("_total"))
    both = upto.join(totals, list(by)) if by else upto.crossJoin(F.broadcast(totals))  # a row a stream
    return crc_aggregate(both.withColumn("_after", F.col("_total") - F.col("_upto")), data, "_after", by, names, standard)


def file_crc(spark: SparkSession, path: str, names: tuple[str, ...] | None = None, split_bytes: int = 64 << 20, standard: bool = False) -> DataFrame:
    """name, n_bytes, check of a stream of any size, each byte range by itself."""
    from ..sources.byte_streams import read_ranges

    chunks = read_ranges(spark, path, split_bytes).select("data", (F.col("total") - F.col("start") - F.col("own")).alias("_after"))
    return crc_aggregate(chunks, "data", "_after", (), names, standard)


def crc_hex(data: Column, name: str, standard: bool = False) -> Column:
    """Upper-case hex of a check over a binary column; crc-32 runs in the JVM, others over Arrow batches."""
    digits = parameters()[name][0] // 4
    if name == "crc-32":
        return F.lpad(F.hex(F.crc32(data)), digits, "0")

    @F.pandas_udf("string")
    def run(column: pd.Series) -> pd.Series:
        known = column.notna().to_numpy()
        found = iter(crc_many([bytes(x) for x in column[known]], name, standard))
        return pd.Series([format(int(next(found)), f"0{digits}X") if k else None for k in known], dtype=object)

    return run(data)


def catalogue(spark: SparkSession) -> DataFrame:
    """The parameter rows with the check of "123456789", by the rows themselves and as published."""
    rows = [(n, w, format(p, "X"), format(i, "X"), format(x, "X"), r, format(crc(b"123456789", n), f"0{w // 4}X"), format(crc(b"123456789", n, True), f"0{w // 4}X")) for n, (w, p, i, x, r) in parameters().items()]
    return spark.createDataFrame(rows, "name string, width int, poly string, init string, xorout string, reflected boolean, check string, check_standard string")
