"""Files by ranges and the sink of whole files: nothing but metadata and the asked samples is read, half-written tasks leave nothing."""

import os

import pyarrow as pa
import pytest
from test_container import box, movie, u32

from framelake.sources import container as C
from framelake.sources import file_sink as W
from framelake.sources import ranges as R


class Counted:
    """An open file that counts what is read."""

    def __init__(self, path):
        self.f, self.read_bytes = open(path, "rb"), 0

    def seek(self, at):
        self.f.seek(at)

    def read(self, n):
        self.read_bytes += n
        return self.f.read(n)


def sparse(path, media):
    """A file of a movie behind media bytes of mdat, which take no room on disk; its samples lie at the start, beyond 2 GB and at the end."""
    places = [16 + 3, media // 2, media + 16 - 4]
    with open(path, "wb") as f:
        f.write(u32(1) + b"mdat" + (16 + media).to_bytes(8, "big"))
        for k, at in enumerate(places):
            f.seek(at)
            f.write(bytes([k + 1] * 4))
        f.seek(16 + media)

        f.write(long_offsets(places))
    return places


def long_offsets(places):
    """movie() with 64-bit chunk offsets, built anew so that outer sizes hold."""
    stbl = [box("stsd", u32(0, 1), box("avc1", bytes(78))), box("stts", u32(0, 1), u32(3, 10)), box("stsc", u32(0, 1), u32(1, 1, 1)), box("stsz", u32(0, 0, 3), u32(4, 4, 4)), box("co64", u32(0, 3), *[x.to_bytes(8, "big") for x in places])]
    mdia = box("mdia", box("mdhd", bytes(12), u32(90000, 30, 0)), box("hdlr", bytes(8), b"vide", bytes(13)), box("minf", box("stbl", *stbl)))
    return box("moov", box("mvhd", bytes(12), u32(1000, 30), bytes(80)), box("trak", box("tkhd", bytes(12), u32(7), bytes(60), u32(640 << 16, 360 << 16)), mdia))


def test_a_file_over_two_gigabytes(spark, tmp_path):
    size = 5 << 30
    places = sparse(tmp_path / "a.mp4", size)
    counted = Counted(tmp_path / "a.mp4")
    rows = list(R.seek_boxes(counted, os.path.getsize(tmp_path / "a.mp4")))
    assert [r[4] for r in rows if r[2] == 0] == ["mdat", "moov"] and counted.read_bytes < 2000
    t = C.tracks(R.boxes(spark, str(tmp_path)))
    assert C.bad_tracks(t).count() == 0 and [r.track_id for r in t.collect()] == [7]
    out = R.samples(spark, f"{tmp_path}/*.mp4").orderBy("sample_idx").collect()
    assert [(r.offset, r.data, r.dts, r.is_sync, r.error) for r in out] == [(p, bytearray([k + 1] * 4), 10 * k, True, None) for k, p in enumerate(places)]
    source = R.SampleReader({"path": str(tmp_path)})
    assert len(source.partitions()) == -(-os.path.getsize(tmp_path / "a.mp4") // R.RANGE_BYTES)
    assert sum(b.num_rows for p in source.partitions()[:3] for b in source.read(p)) == 1


def test_ranges_equal_whole_files(spark, tmp_path):
    good = [([(3, 100)], [(1, -10), (2, 5)], [(1, 2, 1), (2, 1, 1)], [3, 2, 4], [300, 350], [1, 3]), ([(4, 7)], None, [(1, 1, 1), (3, 2, 1)], [5, 0, 9, 1], [900, 20, 400], [])]
    names = []
    for k, parts in enumerate(good):
        head = movie(*parts)
        data = head + box("free", bytes(range(256)) * 5) + u32(0) + b"mdat" + bytes(9)
        names.append(tmp_path / f"{k}.mp4")
        names[-1].write_bytes(data)
    (tmp_path / "empty.mp4").write_bytes(b"")
    (tmp_path / "bad.mp4").write_bytes(u32(4) + b"free" + bytes(8))
    (tmp_path / "cut.mp4").write_bytes(u32(99) + b"moov")
    (tmp_path / "short.mp4").write_bytes(movie([(1, 10)], None, [(1, 1, 1)], [50], [500], None))
    (tmp_path / "tables.mp4").write_bytes(movie([(1, 10)], None, [(1, 1, 1)], [1, 1], [500], None))
    name = lambda r: r.path.rsplit("/", 1)[1]
    columns = [c for c in C.BOXES.replace(" string", "").replace(" int", "").replace(" bigint", "").replace(" binary", "").split(", ") if c != "path"]
    columns = [c.removesuffix("big") for c in columns]
    whole = sorted(((name(r), *[r[c] for c in columns]) for r in C.boxes(C.read_files(spark, f"{tmp_path}/*.mp4")).collect()), key=str)
    for per_task in (1, 100):
        assert sorted(((name(r), *[r[c] for c in columns]) for r in R.boxes(spark, str(tmp_path), per_task).collect()), key=str) == whole
    t = C.tracks(C.boxes(C.read_files(spark, f"{tmp_path}/*.mp4")))
    want = {(r.track, r.sample_idx): r for r in C.samples(t).collect()}
    for width in (64, 1 << 20):
        rows = R.samples(spark, str(tmp_path), range_bytes=width).collect()
        assert sorted((name(r), r.error) for r in rows if r.error) == [("short.mp4", "sample runs past its file"), ("tables.mp4", "sample tables differ in length")]
        got = {(f"{r.path}#{r.trak}", r.sample_idx): r for r in rows if r.sample_idx is not None}
        assert len(got) == len(want) == 8
        for (track, k), w in want.items():
            r = got[track.replace("file:///", "/").replace("file:/", "/") if (track, k) not in got else track, k]
            assert all(r[c] == w[c] for c in ("offset", "size", "dts", "pts", "duration", "description_index", "is_sync"))
            if r.error is None:
                assert bytes(r.data) == (tmp_path / name(r)).read_bytes()[r.offset : r.offset + r.size]


@pytest.mark.parametrize("change", [{"stts": None}, {"stco": None}, {"stsc": u32(0, 0)}, {"stsc": u32(0, 1) + u32(2, 1, 1)}, {"stts": u32(0, 2) + u32(0, 5, 3, 100)}, {"stss": u32(0, 1) + u32(9)}, {"ctts": u32(2 << 24, 1) + u32(3, 0)}, {"stsz": u32(0, 0, 9)}])
def test_malformed_tables(change):
    tables = {"stts": u32(0, 1) + u32(3, 100), "ctts": None, "stsc": u32(0, 2) + u32(1, 2, 1, 2, 1, 1), "stsz": u32(0, 0, 3) + u32(3, 2, 4), "stco": u32(0, 2) + u32(300, 350), "co64": None, "stss": None}
    assert R.sample_arrays(tables)["offset"].tolist() == [300, 303, 350]
    with pytest.raises(R.Malformed):
        R.sample_arrays(tables | change)


def test_files_are_committed_whole(spark, tmp_path):
    rows = spark.createDataFrame([(f"{k}.bin", bytes([k] * (k + 1))) for k in range(20)], "name string, content binary").repartition(4)
    pattern = W.write_files(rows, f"{tmp_path}/out")
    assert sorted((r.name, len(r.content)) for r in W.read_files(spark, pattern).collect()) == sorted((f"{k}.bin", k + 1) for k in range(20))
    assert all(n.startswith("part-") for n in os.listdir(tmp_path / "out"))
    bad = rows.union(spark.createDataFrame([("a/b", b"")], "name string, content binary"))
    with pytest.raises(Exception, match="names no file"):
        W.write_files(bad, f"{tmp_path}/bad")
    assert not os.path.exists(tmp_path / "bad/_temporary") and not list((tmp_path / "bad").glob("part-*"))
    W.write_files(rows.limit(3), f"{tmp_path}/out", mode="overwrite")
    assert W.read_files(spark, pattern).count() == 3
    # an attempt that is not counted leaves nothing
    writer = W.FolderWriter(f"{tmp_path}/lost", False)
    batch = pa.record_batch({"name": ["x"], "content": pa.array([b"1"], pa.binary())})
    writer.write(iter([batch]))
    writer.commit([writer.write(iter([batch])), None])
    assert sum(len(f) for _, _, f in os.walk(tmp_path / "lost")) == 1 and not (tmp_path / "lost/_temporary").exists()


def test_images(spark):
    y, small = bytes(range(6)), bytes([128, 200])
    frames = spark.createDataFrame([("a", 3, 2, y, small, small), ("b", 3, 2, y, small, bytes(3)), ("c", None, 2, y, small, small), ("d", 0, 2, b"", b"", b"")], "name string, width int, height int, y binary, cb binary, cr binary")
    out = {r.name: r for r in W.images(frames).collect()}
    assert out["a"].content[:11] == b"P6\n3 2\n255\n" and len(out["a"].content) == 11 + 18 and out["a"].error is None
    assert {k: out[k].error for k in "bcd"} == {"b": "a plane has a wrong length", "c": "frame has a null", "d": "frame has no size"}


def test_small_ranges_share_tasks(tmp_path):
    """As many tasks as the bytes and the number of files ask for, not one a range; every byte is in one range, and a file is in a task's list once."""
    files = [(f"{k:05d}", 3000 + k % 7 * 1000) for k in range(20_000)]
    parts = R.dealt(files, 4096)
    assert len(parts) <= 2 * R.TASKS
    seen = {}
    for p in parts:
        assert len({r.path for r in p.ranges}) == len(p.ranges)
        for r in p.ranges:
            seen.setdefault((r.path, r.size), []).append((r.start, r.end))
    assert {k: sum(e - s for s, e in v) for k, v in seen.items()} == {f: f[1] for f in files}
    assert all(sorted(v)[0][0] == 0 and all(a[1] == b[0] for a, b in zip(sorted(v), sorted(v)[1:], strict=False)) for v in seen.values())
    whole = R.dealt([("a", 5 * R.RANGE_BYTES), ("b", 1)], R.RANGE_BYTES)
    assert [[(r.path, r.start // R.RANGE_BYTES) for r in p.ranges] for p in whole] == [[("a", k)] for k in range(5)] + [[("b", 0)]]
