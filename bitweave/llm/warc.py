"""WARC: archives written by Spark's own text writer, read back by boundary-chain verification.

Writing: one record per page.  Of the pages with equal payloads the one with the
smallest id is a ``response``, the others are ``revisit`` records that refer to
it and hold no payload.  A record's bytes are built as an expression and written
as text with CR LF CR LF as the separator, so archives go to any file system
that Spark writes to, and no executor touches a local file.

Reading: each task lists every place in its archives that looks like a record
(the magic, a header, a length, the closing CR LF CR LF) with the offset of its
successor.  Payloads may hold the magic, so looking like a record proves
nothing: pointer jumping from the start of each archive doubles the chain's
reach in every round, and only records that the chain reaches are returned.

Defined results: a null payload is empty; payloads shorter than ``least_bytes``
are always responses; rows that share the smallest id of a group are all
responses; a null id is written as an empty field, read back as null, and never
referred to; white space and controls in a URL are percent-encoded; an empty
table writes an archive without records; other columns are ignored.  An archive
is read by one task and may hold at most 2 GB; the writer starts a new one about
every 16 MB.  Records of up to 64 KB, of up to 4 MB and larger ones go to archives
of their own, with so few records in each that however sizes are distributed none
passes 256 MB, but for a single record that does.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._blocks import forget, heavy_keys, shared_dir, spread_join, stored

ARCHIVE_BYTES = 16 << 20
MOST_BYTES = 256 << 20
CLASSES = (64 << 10, 4 << 20, 1 << 31)  # records up to these sizes share archives
MOST_BROADCAST = 200_000  # groups of copies, of about 100 bytes each
_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_MAGIC = re.compile(rb"WARC/1\.[01]\r\n")
_BREAK = "\r\n\r\n"


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base32 of the SHA-1 of a binary column: each 5 bytes are 8 letters."""
    digest = F.sha1(payload)
    letters = []
    for k in range(4):
        bits = F.conv(F.substring(digest, 10 * k + 1, 10), 16, 10).cast("bigint")
        for shift in range(35, -1, -5):
            at = F.shiftright(bits, shift).bitwiseAND(F.lit(31)).cast("int") + 1
            letters.append(F.substring(F.lit(_ALPHABET), at, F.lit(1)))
    return F.concat(*letters)


def write_warc(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least_bytes: int = 0, date: str = "2000-01-01T00:00:00Z") -> None:
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit(bytearray()))
    rows = pages.select(F.col(id_col).cast("bigint").alias("id"), F.coalesce(F.col(url_col), F.lit("")).alias("url"), payload.alias("payload"))
    rows = rows.withColumn("bytes", F.octet_length("payload")).withColumn("digest", base32_sha1(F.col("payload")))
    known = rows.where(F.col("bytes") >= least_bytes).groupBy("digest").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("sum"))
    groups = stored(known.where("n > 1 and first is not null").select("digest", "first", "n"))
    if groups.count() <= MOST_BROADCAST:
        rows = rows.join(F.broadcast(groups.drop("n")), "digest", "left")
    else:
        rows = spread_join(rows, groups.drop("n"), "digest", F.col("id"), heavy_keys(groups, "digest", "n"), "left")
    revisit = F.col("first").isNotNull() & (F.col("bytes") >= least_bytes) & ~F.col("id").eqNullSafe(F.col("first"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes").cast("string"), F.lit(_BREAK))
    block_bytes = F.octet_length(http) + F.when(revisit, F.lit(0)).otherwise(F.col("bytes"))
    url = F.regexp_replace(F.col("url"), r"[\x00-\x20\x7f]", "%20")
    lines = [
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        F.concat(F.lit("WARC-Record-ID: "), _record_id("id")),
        F.lit(f"WARC-Date: {date}"),
        F.concat(F.lit("WARC-Target-URI: "), url),
        F.concat(F.lit("WARC-Page-ID: "), F.coalesce(F.col("id").cast("string"), F.lit(""))),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("digest")),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: "), _record_id("first"), F.lit("\r\nWARC-Refers-To-Page-ID: "), F.col("first").cast("string"), F.lit("\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), block_bytes.cast("string")),
    ]
    head = F.concat(F.concat_ws("\r\n", *lines), F.lit(_BREAK), http).cast("binary")
    record = F.concat(head, F.when(revisit, F.lit(bytearray())).otherwise(F.col("payload"))).cast("string")
    records = rows.select(record.alias("value"))
    size = F.octet_length("value")
    kind = sum((size > x).cast("int") for x in CLASSES[:-1])
    sizes = {r["kind"]: (r["n"], r["bytes"]) for r in stored(records.select(size.alias("bytes"), kind.alias("kind"))).groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes")).collect()}
    mode = "overwrite"
    for k in sorted(sizes) or [0]:
        n, n_bytes = sizes.get(k, (1, 1))
        each = max(1, min(MOST_BYTES // CLASSES[k], int(ARCHIVE_BYTES * n / n_bytes)))
        own = records.where(kind == k) if len(sizes) > 1 else records
        own.write.option("lineSep", _BREAK).option("maxRecordsPerFile", each).mode(mode).text(path)
        mode = "append"


def _record_id(column: str) -> Column:
    digest = F.md5(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary"))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *(F.substring(digest, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))), F.lit(">"))


# -- reading ------------------------------------------------------------------

_FIELDS = [("archive", pa.string()), ("offset", pa.int64()), ("next", pa.int64()), ("record_type", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())]


def _number(text: bytes | None) -> int | None:
    return int(text) if text and re.fullmatch(rb"-?\d+", text) else None


def _header(lines: bytes) -> dict[bytes, bytes]:
    pairs = (x.partition(b":") for x in lines.split(b"\r\n")[1:])
    return {k.strip().lower(): v.strip() for k, _, v in pairs}


def candidates(archive: str, data: bytes, keep_payload: bool) -> Iterator[tuple]:
    """Everything in an archive that looks like a record. A header ends at the first blank line, and holds no second magic."""
    places, end = [m.start() for m in _MAGIC.finditer(data)], -1
    for at, following in zip(places, [*places[1:], len(data)], strict=False):
        if end < at and (end := data.find(b"\r\n\r\n", at)) < 0:
            return
        if following < end:
            continue
        field = _header(data[at:end])
        length = _number(field.get(b"content-length"))
        start = end + 4
        if length is None or length < 0 or data[start + length : start + length + 4] != b"\r\n\r\n":
            continue
        block = data[start : start + length]
        head, _, payload = block.partition(b"\r\n\r\n") if field.get(b"content-type", b"").startswith(b"application/http") else (b"", b"", block)
        kind = field.get(b"warc-type", b"").decode("ascii", "replace")
        if kind == "revisit":
            size, digest = _number(_header(head).get(b"content-length")), field.get(b"warc-payload-digest", b"").decode("ascii", "replace").removeprefix("sha1:")
        else:
            size, digest = len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode()
        yield archive, at, start + length + 4, kind, _number(field.get(b"warc-page-id")), field.get(b"warc-target-uri", b"").decode("utf-8", "replace"), _number(field.get(b"warc-refers-to-page-id")), size, digest, payload if keep_payload else None


def _scan(keep_payload: bool):
    schema = pa.schema(_FIELDS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                rows = list(candidates(batch.column("path")[i].as_py(), batch.column("content")[i].as_py(), keep_payload))
                for at in range(0, len(rows), 5000):
                    columns = zip(*rows[at : at + 5000], strict=True)
                    yield pa.record_batch([pa.array(x, t) for x, (_, t) in zip(columns, _FIELDS, strict=True)], schema=schema)

    return run


def reachable(links: DataFrame) -> DataFrame:
    """links (archive, offset, next): the rows (archive, offset) that the chain from offset 0 reaches, by pointer jumping."""
    state = stored(links.select("archive", "offset", F.col("next").alias("to"), (F.col("offset") == 0).alias("reached")))
    while state.where("to is not null").limit(1).count():
        there = state.select("archive", F.col("offset").alias("to"), F.col("to").alias("further"))
        newly = state.where("reached and to is not null").select("archive", F.col("to").alias("offset"), F.lit(True).alias("new"))
        jumped = state.join(there.hint("merge"), ["archive", "to"], "left").select("archive", "offset", F.col("further").alias("to"), "reached")
        before, state = state, stored(jumped.join(newly.distinct().hint("merge"), ["archive", "offset"], "left").select("archive", "offset", "to", (F.col("reached") | F.coalesce("new", F.lit(False))).alias("reached")))
        forget(before)
    return state.where("reached").select("archive", "offset")


def read_warc(spark: SparkSession, path: str, keep_payload: bool = False) -> DataFrame:
    """Returns the verified records: archive, offset, next, record_type, page_id, url, refers_to, payload_bytes, payload_digest, payload."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    ddl = "archive string, offset long, next long, record_type string, page_id long, url string, refers_to long, payload_bytes long, payload_digest string, payload binary"
    found = files.mapInArrow(_scan(keep_payload), ddl)
    found = stored(found)
    return found.join(reachable(found).hint("merge"), ["archive", "offset"])


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = shared_dir(spark)
    write_warc(spark.read.parquet(f"{sf_dir}/pages.parquet"), at)
    return read_warc(spark, at).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
