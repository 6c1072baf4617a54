"""Bitmap sets, slot memory and fragments against plain loops."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from bitweave.operators import bitmaps, fragments, slots


def test_bitmaps_merge_and_find_what_is_new(spark):
    r = random.Random(1)
    rows = [(k, r.choice([0, 1, 7, 8, 8191, r.randrange(8192)]), r.randrange(16)) for k in range(900) if not 300 <= k < 400]
    packets = spark.createDataFrame(rows, "pkt_idx long, pid int, cc int").repartition(5)
    sets = bitmaps.pid_sets(packets, 20)
    got = {x.window: (x.n_packets, x.n_pids, x.n_new, x.n_seen) for x in bitmaps.with_seen(sets, 4).collect()}
    seen, want, own = set(), {}, defaultdict(list)
    for k, pid, _ in rows:
        own[k // 20].append(pid)
    for w in sorted(own):
        want[w] = (len(own[w]), len(set(own[w])), len(set(own[w]) - seen), len(seen | set(own[w])))
        seen |= set(own[w])
    assert got == want
    merged = bitmaps.members(bitmaps.merged(sets, F.expr("window div 10"))).select("window", "pid").collect()
    assert sorted(map(tuple, merged)) == sorted({(k // 200, pid) for k, pid, _ in rows})
    counters = {(x.window, x.pid): (x.n_packets, x.counters, x.n_repeated, x.first_missing, x.last_missing) for x in bitmaps.counter_sets(packets, 100).collect()}
    for (w, pid), found in counters.items():
        cc = [c for k, p, c in rows if k // 100 == w and p == pid]
        lacking = sorted(set(range(16)) - set(cc))
        assert found == (len(cc), sum(1 << c for c in set(cc)), len(cc) - len(set(cc)), lacking[0], lacking[-1])
    assert bitmaps.with_seen(sets.limit(0)).collect() == []


@pytest.mark.parametrize("span", [3, 1 << 16])
def test_slots_hold_the_last_writer(spark, span):
    r = random.Random(2)
    rows = [(k, k % 3, r.choice([0, None, 255, r.randrange(256)])) for k in range(200)]
    df = spark.createDataFrame(rows, "k long, s int, mask int").repartition(4)
    got = {x.k: (list(x.before), list(x.after), x.read) for x in slots.with_slots(df, F.col("mask"), F.col("k"), "k", ("s",), span=span).withColumn("read", slots.read_slots(F.col("before"), F.array(F.lit(7), F.lit(9)))).collect()}
    held = defaultdict(lambda: [None] * 8)
    for k, s, mask in rows:
        before = list(held[s])
        held[s] = [k if (mask or 0) >> b & 1 else x for b, x in enumerate(before)]
        assert got[k] == (before, held[s], [before[7], None])


def plain_samples(defaults, tracks, runs, samples):
    """One fragment after the other, as a reader of the file goes."""
    head, out, clock, number = {d[0]: d[1:] for d in defaults}, [], defaultdict(int), defaultdict(int)
    last_fragment, end = None, 0
    for fragment, traf, track, at, base, from_fragment, *own, time in sorted(tracks, key=lambda t: t[:2]):
        inherited = [a if a is not None else b for a, b in zip(own, head.get(track, (None,) * 4), strict=True)]
        start = base if base is not None else at if from_fragment or fragment != last_fragment else end
        last_fragment, place = fragment, None
        clock[track] = time if time is not None else clock[track]
        for _, _, run, data_offset, first_flags in sorted(x for x in runs if x[:2] == (fragment, traf)):
            if data_offset is not None or place is None:
                place = data_offset or 0
            for _, _, _, k, duration, size, flags, offset in sorted((x for x in samples if x[:3] == (fragment, traf, run)), key=lambda x: x[3]):
                duration, size = (x if x is not None else y or 0 for x, y in ((duration, inherited[0]), (size, inherited[1])))
                flags = first_flags if k == 0 and first_flags is not None else flags if flags is not None else inherited[2]
                number[track] += 1
                out.append((track, number[track], clock[track], clock[track] + (offset or 0), start + place, size, flags, inherited[3]))
                clock[track] += duration
                place += size
        end = start + (place or 0)
    return sorted(out)


@pytest.fixture
def small_batches(spark):
    conf = {"spark.sql.execution.arrow.maxRecordsPerBatch": "7", "spark.sql.adaptive.enabled": "false"}
    before = {k: spark.conf.get(k) for k in conf}
    for k, x in conf.items():
        spark.conf.set(k, x)
    yield
    for k, x in before.items():
        spark.conf.set(k, x)


def test_fragments_by_ranges_and_batches(spark, small_batches):
    """Four ranges of several batches each, samples without a header or run, headers without samples; everything is shuffled once."""
    r = random.Random(4)
    some = lambda *x: r.choice([None, *x])
    defaults = [(1, 10, 5, 1, 1), (2, None, None, None, 2)]
    tracks, runs, samples = [], [], []
    for fragment in range(0, 80, 2):
        for traf in range(r.randint(1, 3)):
            time = some(fragment * 500) if r.random() < 0.1 else None
            tracks.append((fragment, traf, r.choice([1, 2, 3]), fragment * 10_000, some(fragment * 10_000 + 77), some(True, False), some(30), some(8), some(9), some(4), time))
            for run in range(r.randint(0, 4)):
                runs.append((fragment, traf, run, some(0, 300 + run, 40), some(99)))
                samples += [(fragment, traf, run, k, some(3, 4), some(11, 12), some(0, 2), some(1, -1)) for k in range(r.randint(1, 9))]
    lost = [(1, 0, 0, 0, 5, 5, 5, 5), (4, 7, 0, 0, 5, 5, 5, 5), (4, 0, 9, 0, 5, 5, 5, 5), (None, 0, 0, 0, 5, 5, 5, 5), (1, 0, 1, 0, 5, 5, 5, 5)]
    frame = lambda rows, ddl: spark.createDataFrame(rows, ddl).repartition(3)
    stages = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("fragments", "")
    got = fragments.fragment_samples(
        frame(defaults, "track_id long, duration long, size long, flags int, description int"),
        frame(tracks, "fragment long, traf int, track_id long, fragment_at long, base_offset long, from_fragment boolean, duration long, size long, flags int, description int, decode_time long"),
        frame([*runs, (1, 0, 1, 7, 7)], "fragment long, traf int, run int, data_offset long, first_flags int"),
        frame(samples + lost, "fragment long, traf int, run int, k int, duration long, size long, flags int, offset long"),
    )
    assert sorted(map(tuple, got.collect())) == plain_samples(defaults, tracks, runs, samples)
    assert len(stages.getJobIdsForGroup("fragments")) <= 8  # each ordered pass of its own took some of them


@pytest.mark.parametrize("seed, span", [(1, 7), (2, 1 << 16), (3, 40)])
def test_fragments_equal_a_sequential_reader(spark, seed, span):
    r = random.Random(seed)
    some = lambda *x: r.choice([None, *x])
    defaults = [(1, 10, 5, 1, 1), (2, None, None, None, 2)]
    tracks, runs, samples = [], [], []
    for fragment in range(12):
        for traf in range(r.randint(1, 3)):
            tracks.append((fragment, traf, r.choice([1, 2, 3]), fragment * 10_000, some(fragment * 10_000 + 77), some(True, False), some(30), some(8), some(9), some(4), some(fragment * 500)))
            for run in range(r.randint(1, 4)):
                runs.append((fragment, traf, run, some(0, 300 + run, 40), some(99)))
                samples += [(fragment, traf, run, k, some(3, 4), some(11, 12), some(0, 2), some(1, -1)) for k in range(r.randint(1, 4))]
    frame = lambda rows, ddl: spark.createDataFrame(rows, ddl).repartition(3)
    got = fragments.fragment_samples(
        frame(defaults, "track_id long, duration long, size long, flags int, description int"),
        frame(tracks, "fragment long, traf int, track_id long, fragment_at long, base_offset long, from_fragment boolean, duration long, size long, flags int, description int, decode_time long"),
        frame(runs, "fragment long, traf int, run int, data_offset long, first_flags int"),
        frame(samples, "fragment long, traf int, run int, k int, duration long, size long, flags int, offset long"), span,
    )
    assert sorted(map(tuple, got.collect())) == plain_samples(defaults, tracks, runs, samples)
