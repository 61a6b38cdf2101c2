"""Containers: known sample tables, malformed boxes, written files read back; parameter sets."""

import pytest
from pyspark.sql import functions as F

from framelake.operators import parameter_sets as P
from framelake.operators import units as U
from framelake.sources import container as C


def box(kind, *parts):
    body = b"".join(parts)
    return (8 + len(body)).to_bytes(4, "big") + kind.encode() + body


def u32(*xs):
    return b"".join((x & 0xFFFFFFFF).to_bytes(4, "big") for x in xs)


def movie(stts, ctts, stsc, sizes, chunks, sync, version=1):
    tables = [box("stsd", u32(0, 1), box("avc1", bytes(24), (640).to_bytes(2, "big"), (360).to_bytes(2, "big"), bytes(50)))]
    tables.append(box("stts", u32(0, len(stts)), *[u32(*x) for x in stts]))
    if ctts is not None:
        tables.append(box("ctts", bytes([version, 0, 0, 0]), u32(len(ctts)), *[u32(*x) for x in ctts]))
    tables += [box("stsc", u32(0, len(stsc)), *[u32(*x) for x in stsc]), box("stsz", u32(0, 0, len(sizes)), u32(*sizes)), box("stco", u32(0, len(chunks)), u32(*chunks))]
    if sync is not None:
        tables.append(box("stss", u32(0, len(sync)), u32(*sync)))
    mdia = box("mdia", box("mdhd", bytes(12), u32(90000, 225000, 0)), box("hdlr", bytes(8), b"vide", bytes(13)), box("minf", box("stbl", *tables)))
    return box("moov", box("mvhd", bytes(12), u32(1000, 2500), bytes(80)), box("trak", box("tkhd", bytes(12), u32(7), bytes(60), u32(640 << 16, 360 << 16)), mdia))


def files(spark, *contents):
    return spark.createDataFrame([(f"f{i}", c) for i, c in enumerate(contents)], "path string, content binary")


def test_sample_table(spark):
    f = files(spark, movie([(3, 100)], [(1, -10), (2, 5)], [(1, 2, 1), (2, 1, 1)], [3, 2, 4], [300, 350], [1, 3]))
    t = C.tracks(C.boxes(f))
    r = t.first()
    assert (r.track_id, r.handler, r.timescale, r.duration, r.movie_timescale, r.movie_duration, r.width, r.height, r.format) == (7, "vide", 90000, 225000, 1000, 2500, 640, 360, "avc1")
    rows = [tuple(r)[1:] for r in C.samples(t).orderBy("sample_idx").collect()]
    assert rows == [(0, 300, 3, 0, -10, 100, 1, True), (1, 303, 2, 100, 105, 100, 1, False), (2, 350, 4, 200, 205, 100, 1, True)]


def test_absent_and_empty_tables_differ(spark):
    make = lambda ctts, sync: movie([(2, 10)], ctts, [(1, 2, 1)], [1, 1], [100], sync)
    out = C.samples(C.tracks(C.boxes(files(spark, make(None, None), make(None, []))))).orderBy("track", "sample_idx").collect()
    assert [(r.track[:2], r.pts, r.is_sync) for r in out] == [("f0", 0, True), ("f0", 10, True), ("f1", 0, False), ("f1", 10, False)]


@pytest.mark.parametrize("bad", [([(1, 10)], None, [1, 1]), ([(2, 10)], [(1, 0)], [1, 1]), ([(2, 10)], None, [1])])
def test_lengths_must_agree(spark, bad):
    stts, ctts, sizes = bad
    good = movie([(2, 10)], None, [(1, 2, 1)], [1, 1], [100], None)
    t = C.tracks(C.boxes(files(spark, movie(stts, ctts, [(1, 2, 1)], sizes, [100], None), good)))
    assert [(r.path, r.error) for r in C.bad_tracks(t).collect()] == [("f0", "sample tables differ in length")]
    assert {r.track for r in C.samples(t).collect()} == {"f1#0"}  # one bad track takes no other with it


def test_missing_and_odd_tables(spark):
    good = movie([(2, 10)], [(2, 0)], [(1, 2, 1)], [1, 1], [100], None)

    def without(kind):
        at = good.index(kind.encode()) - 4
        size = int.from_bytes(good[at : at + 4], "big")
        out = bytearray(good[:at] + good[at + size :])
        for outer in ("moov", "trak", "mdia", "minf", "stbl"):
            if (start := out.find(outer.encode()) - 4) >= 0 and start < at:
                out[start : start + 4] = (int.from_bytes(out[start : start + 4], "big") - size).to_bytes(4, "big")
        return bytes(out)

    fixed = movie([(2, 10)], None, [(1, 2, 1)], [1, 1], [100], None).replace(box("stsz", u32(0, 0, 2), u32(1, 1)), box("stsz", u32(0, 5, 2), u32(1, 1)))
    made = [without("stts"), without("stsc"), without("stsz"), without("stco"), without("stbl"), good.replace(b"ctts\1", b"ctts\2"), good.replace(u32(1000, 2500), u32(0, 2500)), movie([(2, 10)], None, [], [1, 1], [100], None), fixed, without("stsd"), good]
    t = C.tracks(C.boxes(files(spark, *made)))
    errors = {r.path: r.error for r in C.bad_tracks(t).collect()}
    assert errors == {
        "f0": "stts box is missing", "f1": "stsc box is missing", "f2": "stsz box is missing", "f3": "not exactly one of stco and co64", "f4": "media has no sample tables",
        "f5": "ctts box has an unknown version", "f6": "movie timescale is zero", "f7": "stsc box is empty",
    }
    rows = C.samples(t).orderBy("track", "sample_idx").collect()
    assert [(r.track, r.size) for r in rows if r.track == "f8#0"] == [("f8#0", 5), ("f8#0", 5)]  # bytes behind a fixed size are let be
    assert {r.track for r in rows} == {"f8#0", "f10#0"}


def test_units_of_bad_samples(spark):
    stts, sizes = [(4, 10)], [7, 3, 4, 9]
    head = movie(stts, None, [(1, 4, 1)], sizes, [0], None)
    media = bytes([0, 0, 0, 3, 0x65, 1, 2]) + bytes([0, 0, 9]) + bytes([0, 0, 0, 0])
    f = files(spark, movie(stts, None, [(1, 4, 1)], sizes, [len(head)], None) + media)
    out = C.units(f, C.samples(C.tracks(C.boxes(f).where("offset < 100000 AND box_path LIKE '/moov%'")))).orderBy("sample_idx").collect()
    assert [(r.sample_idx, r.nal_type, r.bytes, r.error is None) for r in out] == [(0, 5, 3, True), (1, None, None, False), (2, None, None, False), (3, None, None, False)]
    two = spark.createDataFrame([("f0#0", 1, 2)], "track string, description_index bigint, length_size int")
    s = spark.createDataFrame([("f0#0", 0, 0, 5, 1)], "track string, sample_idx bigint, offset bigint, size bigint, description_index bigint")
    assert [(r.nal_type, r.bytes) for r in C.units(files(spark, bytes([0, 3, 0x65, 1, 2])), s, two).collect()] == [(5, 3)]


def test_boxes(spark):
    large = u32(1) + b"free" + (20).to_bytes(8, "big") + bytes(4)
    to_end = u32(0) + b"mdat" + bytes(7)
    f = files(spark, box("ftyp", b"isom", u32(512), b"isommp42") + large + to_end, u32(4) + b"free", u32(16) + b"free", b"abc", b"")
    rows = C.boxes(f).orderBy("path", "ord").collect()
    assert [(r.type, r.offset, r.size, r.header_size, r.error) for r in rows if r.path == "f0"] == [("ftyp", 0, 24, 8, None), ("free", 24, 20, 16, None), ("mdat", 44, 15, 8, None)]
    assert [(r.path, r.error is not None) for r in rows if r.path != "f0"] == [("f1", True), ("f2", True), ("f3", True)]


def test_written_files_read_back(spark):
    rows = [("v", i, 10 + i, (-1) ** i * i, i % 3 == 0, bytes([0, 0, 0, 2, 0x65, i])) for i in range(8)]
    made = C.mux(spark.createDataFrame(rows, "f string, idx bigint, delta bigint, shift bigint, sync boolean, data binary"), "f", 1000, 64, 48)
    s = C.samples(C.tracks(C.boxes(made)))
    got = s.orderBy("sample_idx").select("sample_idx", "duration", (F.col("pts") - F.col("dts")).alias("shift"), "is_sync", "size").collect()
    assert [tuple(r) for r in got] == [(i, d, s_, k, 6) for _, i, d, s_, k, _ in rows]
    assert [(r.sample_idx, r.nal_type, r.ref_idc, r.bytes) for r in C.units(made, s).orderBy("sample_idx").collect()] == [(i, 5, 3, 2) for i in range(8)]


def test_malformed_sets_have_errors(spark):
    d = spark.createDataFrame([(1, bytes([0x67])), (2, bytes([0x67, 66, 0]))], "k int, u binary")
    assert all(r.error and r.width is None for r in P.parsed(d, "k", "u", "sps").collect())
    assert P.Bits(bytes([0x67, 0, 0, 3, 1, 0x80])).u(24) == 1


def test_null_and_odd_files(spark):
    f = spark.createDataFrame([("a", None), ("b", b""), ("c", movie([(1, 10)], None, [(1, 1, 1)], [1], [100], None))], "path string, content binary")
    rows = C.boxes(f).collect()
    assert [(r.path, r.error) for r in rows if r.error] == [("a", "content is null")]
    assert [r.path for r in C.tracks(C.boxes(f)).collect()] == ["c"]


def test_track_errors(spark):
    good = ([(3, 100)], None, [(1, 2, 1), (2, 1, 1)], [3, 2, 4], [300, 350], [1, 3])
    with_ = lambda **k: movie(*[k.get(n, v) for n, v in zip(("stts", "ctts", "stsc", "sizes", "chunks", "sync"), good, strict=True)])
    made = [with_(), with_(stts=[(0, 5), (3, 100)]), with_(stsc=[(2, 1, 1)]), with_(stsc=[(1, 1, 1), (1, 2, 1)]), with_(stsc=[(1, 0, 1)]), with_(stsc=[(1, 2, 2)]), with_(sync=[4]), with_(sync=[0]), with_(ctts=[(0, 1)]), with_().replace(b"vide", bytes(4)), with_().replace(u32(90000, 225000), u32(0, 225000))]
    out = {r.path: r.e for r in C.tracks(C.boxes(files(spark, *made))).select("path", C.track_error().alias("e")).collect()}
    assert out["f0"] is None and all(out[f"f{i}"] for i in range(1, len(made)))
    assert len(set(out.values())) >= 8


def test_descriptions_and_first_video(spark):
    entry = lambda kind, *parts: box(kind, bytes(24), (640).to_bytes(2, "big"), (360).to_bytes(2, "big"), bytes(50), *parts)
    stsd = box("stsd", u32(0, 3), box("mp4a", bytes(28)), entry("avc1", box("pasp", bytes(8)), box("avcC", b"one"), box("hvcC", b"two")), entry("hvc1"))
    t = spark.createDataFrame([("p", 0, stsd[8:]), ("q", 0, stsd[8:12] + u32(2) + stsd[16:]), ("r", 0, None)], "path string, trak int, stsd binary")
    rows = sorted(((r.path, r.description_index, r.format, r.visual, r.width, r.config_type, r.config, r.error is None) for r in C.descriptions(t).collect()), key=str)
    assert rows == [("p", 1, "mp4a", False, None, None, None, True), ("p", 2, "avc1", True, 640, "avcC", b"one", True), ("p", 3, "hvc1", True, 640, None, None, True), ("q", None, None, None, None, None, None, False)]
    one = movie([(1, 10)], None, [(1, 1, 1)], [1], [100], None)
    none = movie([(1, 10)], None, [(1, 1, 1)], [], [100], None)
    trak = lambda m: m[m.index(b"trak") - 4 :]
    both = box("moov", one[8 : one.index(b"trak") - 4], trak(none), trak(one), trak(one))
    first = C.first_video(C.tracks(C.boxes(files(spark, both, none)))).collect()
    assert [(r.path, r.trak) for r in first] == [("f0", 1)]
    assert [(r.path, r.trak, r.description_index, r.format, r.error) for r in C.decoders(C.tracks(C.boxes(files(spark, both)))).collect()] == [("f0", 1, 1, "avc1", None)]


def test_files_are_read_from_a_path(spark, tmp_path):
    (tmp_path / "a.mp4").write_bytes(movie([(1, 10)], None, [(1, 1, 1)], [1], [100], None))
    t = C.tracks(C.boxes(C.read_files(spark, f"{tmp_path}/*.mp4"))).collect()
    assert len(t) == 1 and t[0].track_id == 7


def test_batches_of_bytes(spark):
    """What a worker holds is bounded by bytes, not by rows: batches go in by 2 MB and units and boxes leave a part at a time, all of them."""
    n = U.BATCH_UNITS + 5
    many = b"".join(b"\0\0\1\x65" + k.to_bytes(3, "big").replace(b"\0", b"\1") for k in range(n))
    big = b"\0\0\1\x65" + b"a" * (2 * U.BATCH_BYTES)
    streams = spark.createDataFrame([(1, many), (2, None), (3, big), (4, b"junk"), (None, b"\0\0\1\x41b")], "k bigint, s binary")
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    out = U.split_bytes(streams, ["k"], "s")
    assert "MapInArrow" in out._jdf.queryExecution().executedPlan().toString() and spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == "2m"
    rows = out.collect()
    assert sorted(r.unit_idx for r in rows if r.k == 1) == list(range(n)) and all(bytes(r.unit) == b"\x65" + r.unit_idx.to_bytes(3, "big").replace(b"\0", b"\1") for r in rows if r.k == 1)
    assert sorted((str(r.k), r.unit_idx, r.unit and len(r.unit), r.error) for r in rows if r.k != 1) == sorted([("2", None, None, "stream is null"), ("3", 0, 1 + 2 * U.BATCH_BYTES, None), ("4", None, None, "stream has no start code"), ("None", 0, 2, None)], key=str)
    free = b"".join(box("ftyp", bytes(C.BATCH_BYTES // 2)) for _ in range(5))
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    found = C.boxes(spark.createDataFrame([("a", free), ("b", None), ("c", b"")], "path string, content binary"))
    assert "MapInArrow" in found._jdf.queryExecution().executedPlan().toString() and spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == "2m"
    assert sorted((r.path, r.ord, r.payload and len(r.payload), r.error) for r in found.collect()) == [("a", k, C.BATCH_BYTES // 2, None) for k in range(5)] + [("b", 0, None, "content is null")]
