"""Samples of fragmented files: defaults that are inherited, runs that follow one another, and times that go on across fragments.

A run of samples may leave out nearly all that it says.  What a sample lacks comes
from its track's fragment header, and what that lacks from the track's defaults
in the file's head.  Where a run's bytes start may be said relative to its
fragment, or it follows the run before it; where a fragment's bytes are counted
from may be said, may be the fragment's own first byte, or the end of the track
before it.  Headers, runs and samples are therefore shuffled once, as one table in
the order of the file, in ranges of whole fragments, and each range is read through
batch by batch.  Bytes are known inside a fragment.  Of the ranges before it a range
needs but each track's clock and number of samples: a row a range and track.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import written

_READ = "_part long, _ends boolean, _known boolean, track_id long, sample_no long, dts long, cto long, byte_off long, size long, flags long, description long"


def _filled(marks: np.ndarray, values: np.ndarray, before) -> np.ndarray:
    """The value at the last mark up to each place, or what was before."""
    at = np.maximum.accumulate(np.where(marks, np.arange(len(marks)), -1))
    return np.where(at < 0, before, values[at])


class _Reader:
    """Reads headers, runs and samples in order; batches follow one another."""

    def __init__(self):
        self.last: dict[str, int] = {}  # what holds at the end of the batch before
        self.tracks: dict[int, tuple[int, int, bool]] = {}  # samples, clock, whether that counts from a time that was said

    def filled(self, name: str, marks: np.ndarray, values: np.ndarray) -> np.ndarray:
        out = _filled(marks, values, self.last.get(name, 0))
        self.last[name] = out[-1]
        return out

    def summed(self, name: str, marks: np.ndarray, values: np.ndarray, steps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(before, after) each step: sums that start at ``values`` where marked."""
        upto = np.cumsum(steps)
        origin = _filled(marks, values - (upto - steps), self.last.get(name, 0))
        self.last[name] = origin[-1] + upto[-1]
        return origin + upto - steps, origin + upto

    def read(self, batch: pa.RecordBatch) -> dict[str, np.ndarray]:
        has = {c: batch.column(c).is_valid().to_numpy(zero_copy_only=False) for c in batch.schema.names}
        v = {c: batch.column(c).cast(pa.int64()).fill_null(0).to_numpy(zero_copy_only=False) for c in batch.schema.names}
        heads, runs = ~has["run"], has["run"] & ~has["k"]
        of_head = {c: self.filled(f"head {c}", heads, v[c]) for c in ("fragment", "traf", "track_id", "duration", "size", "flags", "description")}
        of_head |= {f"has {c}": self.filled(f"head has {c}", heads, has[c]) for c in ("flags", "description")}
        of_run = {c: self.filled(f"run {c}", runs, v[c]) for c in ("fragment", "traf", "run", "offset", "flags")}
        of_run |= {f"has {c}": self.filled(f"run has {c}", runs, has[c]) for c in ("offset", "flags")}
        # samples without a header or a run are none
        own = has["k"] & self.filled("any head", heads, heads).astype(bool) & self.filled("any run", runs, runs).astype(bool)
        for c in ("fragment", "traf"):
            own &= (of_head[c] == v[c]) & (of_run[c] == v[c])
        own &= of_run["run"] == v["run"]

        size = np.where(own, np.where(has["size"], v["size"], of_head["size"]), 0)
        opens = own & (v["k"] == 0) & of_run["has offset"].astype(bool)
        at_first = self.last.get("place", 0)
        place, upto = self.summed("place", heads | opens, np.where(opens, of_run["offset"], 0), size)
        # a header without a place of its own follows the bytes before it
        ended = np.append(at_first, upto[:-1])
        following = np.append(self.last.get("fragment", -1), of_head["fragment"][:-1])
        leads = heads & ((v["fragment"] != following) | ~np.append(self.last.get("seen", False), np.logical_or.accumulate(heads)[:-1] | self.last.get("seen", False)))
        self.last |= {"fragment": of_head["fragment"][-1], "seen": bool(self.last.get("seen", False) or heads.any())}
        said = heads & (has["start"] | leads)
        steps = np.where(heads & ~said, ended, 0)
        _, base = self.summed("base", said, np.where(has["start"], v["start"], v["fragment_at"]), steps)

        first = own & (v["k"] == 0) & of_run["has flags"].astype(bool)
        flags = np.where(first, of_run["flags"], np.where(has["flags"], v["flags"], of_head["flags"]))
        has_flags = first | has["flags"] | of_head["has flags"].astype(bool)
        lasts = np.where(own, np.where(has["duration"], v["duration"], of_head["duration"]), 0)
        number, time, known = self.clocks(own, heads & has["decode_time"], of_head["track_id"], lasts, v["decode_time"])
        return {
            "_known": pa.array(known[own]), "track_id": pa.array(of_head["track_id"][own]), "sample_no": pa.array(number[own]), "dts": pa.array(time[own]), "cto": pa.array(v["offset"][own]),
            "byte_off": pa.array((base + place)[own]), "size": pa.array(size[own]), "flags": pa.array(flags[own], mask=~has_flags[own]), "description": pa.array(of_head["description"][own], mask=~of_head["has description"].astype(bool)[own]),
        }

    def clocks(self, own: np.ndarray, said: np.ndarray, track: np.ndarray, lasts: np.ndarray, to: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(number in its track, time, whether that is known) of each sample, inside this range."""
        number, time, known = np.zeros(len(own), np.int64), np.zeros(len(own), np.int64), np.zeros(len(own), bool)
        rows = np.flatnonzero(own | said)
        rows = rows[np.argsort(track[rows], kind="stable")]
        if not len(rows):
            return number, time, known
        ids, starts = np.unique(track[rows], return_index=True)
        before = [self.tracks.get(t, (0, 0, False)) for t in ids.tolist()]
        new = np.zeros(len(rows), bool)
        new[starts] = True
        group = np.cumsum(new) - 1
        n0, clock0, known0 = (np.array(x)[group] for x in zip(*before, strict=True))
        resets, n, steps = said[rows], np.cumsum(own[rows]), lasts[rows]
        passed = np.cumsum(steps) - steps
        number[rows] = n0 + n - (n - own[rows])[starts][group]
        time[rows] = _filled(new | resets, np.where(resets, to[rows], clock0) - passed, 0) + passed
        known[rows] = _filled(new | resets, resets | known0, False)
        for t, last in zip(ids.tolist(), rows[np.append(starts[1:], len(rows)) - 1].tolist(), strict=True):
            self.tracks[t] = (int(number[last]), int(time[last] + lasts[last]), bool(known[last]))
        return number, time, known


def _read(schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        reader, part = _Reader(), TaskContext.get().partitionId()
        row = lambda n, ends, columns: pa.record_batch([pa.array(np.full(n, part)), pa.array(np.full(n, ends)), *(columns.get(c, pa.nulls(n)) for c in schema.names[2:])], names=schema.names).cast(schema)
        for batch in batches:
            if batch.num_rows:
                found = reader.read(batch)
                yield row(len(found["size"]), False, found)
        n, clock, known = zip(*reader.tracks.values(), strict=True) if reader.tracks else ((), (), ())
        yield row(len(n), True, {"_known": pa.array(known, pa.bool_()), "track_id": pa.array(reader.tracks, pa.int64()), "sample_no": pa.array(n, pa.int64()), "dts": pa.array(clock, pa.int64())})

    return run


def fragment_samples(defaults: DataFrame, tracks: DataFrame, runs: DataFrame, samples: DataFrame, span: int | None = None) -> DataFrame:
    """Samples in file order: track_id, sample_no (from 1 in its track), dts, cts, byte_off, size, flags, description.

    defaults: track_id, duration, size, flags, description (of the file's head).
    tracks: fragment, traf (its place there), track_id, fragment_at (first byte), base_offset, from_fragment (counted from
    the fragment's first byte if there is no base_offset), duration, size, flags, description, decode_time; null where absent.
    runs: fragment, traf, run, data_offset, first_flags; null where absent.
    samples: fragment, traf, run, k (from 0), duration, size, flags, offset (composition); null where absent.
    Rows without their keys (fragment, traf, run, k) belong nowhere; track_id and fragment_at are never null.
    span: no longer used; there are as many ranges as shuffle partitions.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    head = defaults.select("track_id", *(F.col(c).alias(f"_d_{c}") for c in ("duration", "size", "flags", "description")))
    own = {c: F.coalesce(c, f"_d_{c}") for c in ("duration", "size", "flags", "description")}
    start = F.coalesce("base_offset", F.when(F.col("from_fragment"), F.col("fragment_at")))
    heads = tracks.join(F.broadcast(head), "track_id", "left")  # defaults: one row a track of the file's head
    heads = heads.dropna(subset=["fragment", "traf"]).select("fragment", "traf", "track_id", "fragment_at", start.alias("start"), "decode_time", *(x.alias(c) for c, x in own.items()))
    runs = runs.dropna(subset=["fragment", "traf", "run"]).select("fragment", "traf", "run", F.col("data_offset").alias("offset"), F.col("first_flags").alias("flags"))
    samples = samples.dropna(subset=["fragment", "traf", "run", "k"]).select("fragment", "traf", "run", "k", "duration", "size", "flags", "offset")
    # a header has no run and a run's own row no k: they come before what they hold for
    rows = heads.unionByName(runs, allowMissingColumns=True).unionByName(samples, allowMissingColumns=True)
    kind = dict(rows.dtypes)
    rows = rows.repartitionByRange("fragment").sortWithinPartitions("fragment", "traf", "run", "k")
    schema = rows.sparkSession.createDataFrame([], _READ).schema
    read = written(rows.mapInArrow(_read(to_arrow_schema(schema)), schema))

    order = Window.partitionBy("track_id").orderBy("_part")  # a row a range
    ends = read.where("_ends").select("_part", "track_id", "sample_no", "dts", "_known", F.sum("dts").over(order).alias("_sum"), F.sum("sample_no").over(order).alias("_n"))
    said = F.last(F.when(F.col("_known"), F.col("dts") - F.col("_sum")), ignorenulls=True).over(order)
    ends = ends.withColumn("_clock", F.coalesce(said, F.lit(0)) + F.col("_sum"))
    before = ends.select("_part", "track_id", (F.col("_n") - F.col("sample_no")).alias("_n"), F.coalesce(F.lag("_clock").over(order), F.lit(0)).alias("_clock"))
    rows = read.where("not _ends").join(F.broadcast(before), ["_part", "track_id"])
    dts = F.col("dts") + F.when(F.col("_known"), 0).otherwise(F.col("_clock"))
    return rows.select(
        F.col("track_id").cast(kind["track_id"]), (F.col("sample_no") + F.col("_n")).alias("sample_no"), dts.alias("dts"), (dts + F.col("cto")).alias("cts"), "byte_off", "size",
        F.col("flags").cast(kind["flags"]), F.col("description").cast(kind["description"]),
    )
