"""Streams with state over several slices, table functions, code words, tiles and direct motion against plain replays."""

import random

import pandas as pd
import pytest

from framelake.operators import codes as K
from framelake.operators import relations as N
from framelake.operators import table_functions
from framelake.plans import catalogue, media
from framelake.streaming import decoding, reorder


def test_reorder_over_shuffled_slices(spark, sf):
    n = spark.read.parquet(f"{sf}/events.parquet").count()
    out = media.reorder_rows(spark, sf, slice_rows=max(1, n // 4))
    rows = out.collect()
    assert len(rows) == n and len({(r.track, r.idx) for r in rows}) == n
    tracks = {}
    for r in rows:
        tracks.setdefault(r.track, []).append(r)
    for of_track in tracks.values():
        of_track.sort(key=lambda r: r.pos)
        assert [r.pos for r in of_track] == list(range(len(of_track)))
        assert [(r.pts, r.idx) for r in of_track] == sorted((r.pts, r.idx) for r in of_track)


def test_reorder_with_lost_samples(spark):
    """Samples behind a lost one wait for the watermark and then leave in order; nothing waits for ever."""
    rows = [("t", i, f"2024-01-{1 + i // 4:02d} 0{i % 4}:00:00", 10 * i, 10, 10 * i + (20 if i % 3 == 1 else 0)) for i in range(40) if i not in (7, 8, 21)]
    rows.append(("", 0, "2024-06-01 00:00:00", 0, 10, 0))
    df = spark.createDataFrame(rows, "track string, idx bigint, ts string, dts bigint, delta bigint, pts bigint").selectExpr("track", "idx", "CAST(ts AS TIMESTAMP) AS ts", "dts", "delta", "pts")
    out = decoding.streamed(df, ["ts"], lambda s: reorder.reordered(s, 0, "1 day", 86_400_000), reorder.OUT, 6, decoding.ROCKS).where("track = 't'").collect()
    assert sorted(r.idx for r in out) == [r[1] for r in rows[:-1]]
    by_pos = sorted(out, key=lambda r: r.pos)
    assert [r.pos for r in by_pos] == list(range(len(out)))
    assert [(r.pts, r.idx) for r in by_pos] == sorted((r.pts, r.idx) for r in by_pos)


def test_sets_over_slices(spark, sf):
    n = spark.read.parquet(f"{sf}/events.parquet").count()
    one = sorted(map(tuple, media.set_rows(spark, sf).collect()), key=str)
    many = sorted(map(tuple, media.set_rows(spark, sf, slice_rows=max(1, n // 3)).collect()), key=str)
    assert one == many and len(one) == n


def test_decoder_state_over_slices(spark, sf):
    n = spark.read.parquet(f"{sf}/events.parquet").count()
    one, many = (sorted(map(tuple, decoding.decoder_rows(spark, sf, k).collect()), key=str) for k in (10**6, max(1, n // 3)))
    assert one == many and len(one) == n


def test_buffers_equal_the_stream(spark, sf):
    n = spark.read.parquet(f"{sf}/events.parquet").count()
    batch = sorted(map(tuple, catalogue.queries()["dpb_marking"](spark, sf).collect()), key=str)
    assert batch == sorted(map(tuple, decoding.marking_rows(spark, sf, max(1, n // 3)).collect()), key=str)


def test_table_functions(spark):
    table_functions.register(spark)
    rows = [(1, "a", b"\0\0\1\x65abc\0\0\1\x41d"), (2, None, None), (3, "c", b"junk")]
    spark.createDataFrame(rows, "k int, other string, stream binary").createOrReplaceTempView("some_streams")
    out = spark.sql("SELECT * FROM split_annexb(TABLE(some_streams), 'stream')")
    assert out.columns == ["k", "other", "unit_idx", "unit", "error"]
    assert sorted(((r.k, r.other, r.unit_idx, r.unit and bytes(r.unit), r.error is None) for r in out.collect()), key=str) == [(1, "a", 0, b"\x65abc", True), (1, "a", 1, b"\x41d", True), (2, None, None, None, False), (3, "c", None, None, False)]
    assert spark.sql("SELECT s.k, u.unit_idx FROM some_streams s, LATERAL annexb_units_of(s.stream) u WHERE u.error IS NULL").count() == 2
    spark.createDataFrame([(1, b"\0\2\x65a\0\1\x41", 2), (2, b"\3\x65ab", 1), (3, b"\0\0\0\1\x65", 3)], "k int, data binary, n int").createOrReplaceTempView("some_samples")
    got = spark.sql("SELECT k, unit, error FROM split_lengths(TABLE(some_samples), 'data', 'n')").collect()
    assert sorted((r.k, r.unit and bytes(r.unit), r.error) for r in got if r.unit) == [(1, b"\x41", None), (1, b"\x65a", None), (2, b"\x65ab", None)] and [r.error for r in got if r.k == 3] == ["length of 3 bytes"]
    assert spark.sql("SELECT u.unit FROM some_samples s, LATERAL length_units_of(s.data, s.n) u WHERE u.error IS NULL").count() == 3
    for bad in ("'nothing'", "'k'"):
        with pytest.raises(Exception, match="names no column|not binary"):
            spark.sql(f"SELECT * FROM split_annexb(TABLE(some_streams), {bad})")


def test_codes(spark):
    codes = spark.createDataFrame([(1, "1", 5), (1, "01", 6), (1, "001", 7), (2, "0", 8), (2, "01", 9), (2, "", 1), (2, None, 1), (3, "1", 1), (3, "1", 1)], "t int, code string, value int")
    rows = spark.createDataFrame([(1, "1000"), (1, "0011"), (1, "000"), (1, "0"), (2, "011"), (2, "00"), (2, "1"), (9, "1"), (None, "1"), (1, None), (3, "10"), (1, "")], "t int, bits string")
    got = [(r.t, r.bits, r.value, r.code_bits, r.code_error) for r in K.with_code(rows, codes, "t", "bits", "code", "value").collect()]
    none, several, null = "no code begins the bits", "several codes begin the bits", "row has a null"
    want = [(1, "1000", 5, 1, None), (1, "0011", 7, 3, None), (1, "000", None, None, none), (1, "0", None, None, none), (2, "011", None, None, several), (2, "00", 8, 1, None), (2, "1", None, None, none), (9, "1", None, None, none), (None, "1", None, None, null), (1, None, None, None, null), (3, "10", None, None, several), (1, "", None, None, none)]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert [tuple(r) for r in K.prefix_violations(codes.where("t < 3"), "t", "code").collect()] == [(2, "0", "01")]
    assert K.with_code(rows, codes.limit(0), "t", "bits", "code", "value").where("code_error IS NULL").count() == 0
    with pytest.raises(ValueError, match="bits"):
        K.with_code(rows, spark.createDataFrame([(1, "1" * 65, 1)], "t int, code string, value int"), "t", "bits", "code", "value")


@pytest.mark.parametrize("tile", [1, 3, 16])
def test_tiles_equal_plain_neighbours(spark, tile):
    r = random.Random(tile)
    width, rows = 7, []
    for p in ("a", "b", None):
        rows += [(p, a, r.randint(0, 99) if r.random() < 0.9 else None, a // 9) for a in range(45) if r.random() < 0.85]
    rows += [("a", -1, 5, 0), ("a", None, 5, 0), ("b", 3, 5, None)]
    out = N.tiled_neighbours(spark.createDataFrame(rows, "p string, a int, v int, s int"), "p", "a", "v", "s", width, tile)
    plan = out._jdf.queryExecution().executedPlan().toString()  # before it runs
    there = {(p, a): (v, s) for p, a, v, s in rows if p is not None and a is not None and a >= 0 and s is not None}

    def look(p, a, s, step, fine):
        v, other = there.get((p, a - step), (None, None))
        return v if fine and other == s else None

    want = {(p, a, v, s, look(p, a, s, 1, a % width > 0), look(p, a, s, width, True), look(p, a, s, width - 1, a % width < width - 1), look(p, a, s, width + 1, a % width > 0)) for (p, a), (v, s) in there.items()}
    got = [tuple(x) for x in out.collect()]
    assert len(got) == len(want) and set(got) == want
    assert plan.count("Exchange hashpartitioning") == 1


def test_batches_by_the_rows_of_a_track(spark):
    """Slices meet in a batch as long as no track has more rows there than a slice may have: short tracks do not come again in each slice."""
    every = [(s, f"t{k}") for s in range(40) for k in range(10)]
    frame = lambda rows: spark.createDataFrame(rows, "slice int, track string")
    assert decoding.slices_a_batch(frame(every), ["track"], 100) == decoding.SLICES_A_BATCH
    assert decoding.slices_a_batch(frame(every), ["track"], 3) == 3
    assert decoding.slices_a_batch(frame(every + [(7, "t1")] * 9), ["track"], 12) == 3
    assert decoding.slices_a_batch(frame([(0, "a")] * 5), ["track"], 1) == 1


def test_one_read_and_one_write_of_the_state(spark):
    """Calls of the state do not grow with the slices of a batch; sets of later batches are in force."""
    from framelake.streaming import sets

    class Held:
        def __init__(self):
            self.value, self.calls = None, 0

        def get(self):
            self.calls += 1
            return self.value

        def update(self, value):
            self.calls += 1
            self.value = value

    processor = sets.SetsInForce()
    processor.held = Held()
    sps, pps = bytes.fromhex("6742000ADA79"), bytes.fromhex("68CE3C80")
    rows = [(0, 0, sps), (0, 1, pps)] + [(k, 2, bytes.fromhex("6588842F")) for k in range(500)]
    frame = pd.DataFrame(rows, columns=["sample_idx", "unit_idx", "unit"])
    out = list(processor.handleInputRows(("t", 1), iter([frame[:100], frame[100:]]), None))
    assert sum(map(len, out)) == 500 and processor.held.calls == 2
    later = pd.concat(processor.handleInputRows(("t", 1), iter([frame[2:10]]), None))
    assert len(later) == 8 and set(later["set_sample"]) == {0} and later["error"].isna().all() and processor.held.calls == 3


def test_decoders_share_keys(spark):
    """Decoders of a bucket have one read and one write of the state together, and stay apart."""
    from framelake.streaming import sets

    class Held:
        def __init__(self):
            self.value, self.calls = None, 0

        def get(self):
            self.calls += 1
            return self.value

        def update(self, value):
            self.calls += 1
            self.value = value

    processor = sets.SetsInForce(shared=True)
    processor.held = Held()
    sps, pps, piece = bytes.fromhex("6742000ADA79"), bytes.fromhex("68CE3C80"), bytes.fromhex("6588842F")
    seeds = pd.DataFrame([(f"t{i}", d, u) for i in range(50) for d in (1, 2) for u in (sps, pps)], columns=["track", "description", "unit"])
    processor.handleInitialState((7,), seeds, None)
    assert processor.held.calls == 2
    units = [("t1", 1, 0, 1, sps), ("t1", 1, 0, 2, pps), ("t2", 2, 3, 0, pps)] + [(f"t{i}", d, k, 9, piece) for i in range(51) for d in (1, 2) for k in range(5)]
    random.Random(3).shuffle(units)
    frame = pd.DataFrame(units, columns=["track", "description", "sample_idx", "unit_idx", "unit"])
    out = pd.concat(processor.handleInputRows((7,), iter([frame[:200], frame[200:]]), None))
    assert processor.held.calls == 4
    got = {(r.track, r.description, r.sample_idx): (r.set_sample, r.sps_sample, r.error) for r in out.itertuples()}

    def want(i, d, k):
        if i == 50:
            return None, None, "picture set is missing"
        return 0 if (i, d) == (1, 1) else 3 if (i, d) == (2, 2) and k >= 3 else -1, 0 if (i, d) == (1, 1) else -1, None

    clean = {k: tuple(None if pd.isna(x) else x for x in v) for k, v in got.items()}
    assert len(out) == 510 and clean == {(f"t{i}", d, k): want(i, d, k) for i in range(51) for d in (1, 2) for k in range(5)}


def test_buckets_equal_decoders(spark):
    """A stream by buckets, in chunks of few rows, gives what one by decoders and a plain replay give."""
    from framelake.streaming import sets

    r = random.Random(5)
    sps, pps, piece, bad = bytes.fromhex("6742000ADA79"), bytes.fromhex("68CE3C80"), bytes.fromhex("6588842F"), b"\x68\0\0\3\xff"
    tracks = [(f"t{i}", d) for i in range(12) for d in (1, 2)]
    units = [(t, d, k, n, r.choice([sps, pps, piece, piece, bad, b"\x09\x10", b""]), k) for t, d in tracks for k in range(9) for n in range(4)]
    units += [(None, 1, 0, 0, piece, 0), ("t1", None, 0, 0, piece, 1), ("t1", 1, 0, 9, None, 1)]
    rows = spark.createDataFrame(units, "track string, description bigint, sample_idx bigint, unit_idx bigint, unit binary, ts int")
    seeds = spark.createDataFrame([(t, d, u) for t, d in tracks[::2] for u in (sps, bad, pps)] + [("nobody", 1, sps), (None, 1, sps), ("t3", 1, b"")], "track string, description bigint, unit binary")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    try:
        one, many = ([tuple(x) for x in decoding.streamed(rows, ["ts"], lambda s, n=n: sets.sets_in_force(s, seeds, n), sets.OUT, 300, decoding.ROCKS).collect()] for n in (None, 3))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    held, want = {(t, d): [None, None] for t, d in tracks}, []
    for t, d, u in seeds.where("track LIKE 't%' AND length(unit) > 0").collect():
        if bytes(u) != bad:
            held[t, d][bytes(u) == pps] = -1
    for t, d, k, n, u, _ in sorted((u for u in units if None not in u), key=lambda u: (u[2], u[4] == piece, u[3])):
        if u in (sps, pps):
            held[t, d][u == pps] = k
        elif u == piece:
            s, p = held[t, d]
            want.append((t, d, k, n, p, None if p is None else s, "picture set is missing" if p is None else "sequence set is missing" if s is None else None))
    brief = lambda found: sorted(((*x[:4], x[6], x[8], x[11]) for x in found), key=str)
    assert sorted(one, key=str) == sorted(many, key=str) and brief(one) == sorted(want, key=str)


def test_state_keys_do_not_grow_with_decoders(spark, sf, monkeypatch):
    """stream_sets deals its decoders to buckets, of which batches count the rows; more decoders share one the more there are."""
    from framelake.streaming import sets

    assert [sets.buckets_for(n) for n in (0, 1, 1 << 16, (1 << 16) + 1, 1 << 20)] == [256, 256, 256, 257, 4096]
    seen, plain = [], sets.sets_in_force
    monkeypatch.setattr(sets, "LEAST_BUCKETS", 5)
    monkeypatch.setattr(sets, "sets_in_force", lambda stream, seeds, buckets: seen.append(buckets) or plain(stream, seeds, buckets))
    out = media.set_rows(spark, sf)
    assert seen == [5] and out.select("track", "description").distinct().count() > 5
    assert out.select(sets.bucket(5)).distinct().count() == 5


def test_units_carry_columns(spark, sf):
    """Units with the times of their samples are the units, each with its event's time, from one scan of the events."""
    from framelake.sources.tables import samples

    plain, timed = catalogue._slice_units(spark, sf), catalogue._slice_units(spark, sf, "ts")
    when = samples(spark, sf).selectExpr("user_id", "idx AS sample_idx", "ts")
    want = sorted(map(tuple, plain.join(when, ["user_id", "sample_idx"], "left").select(*plain.columns, "ts").collect()), key=str)
    assert timed.columns == [*plain.columns, "ts"] and sorted(map(tuple, timed.collect()), key=str) == want


def test_sets_are_made_where_they_stand(spark, sf, monkeypatch):
    """No filter of the plan makes the sets of each sample to see whether they are there."""
    plans, plain = [], catalogue.stored
    monkeypatch.setattr(catalogue, "stored", lambda df, name: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or plain(df, name))
    catalogue._slice_units(spark, sf)
    assert len(plans) == 2 and "Generate" in plans[1] and not [line for line in plans[1].split("\n") if "Filter" in line and "unhex" in line]
