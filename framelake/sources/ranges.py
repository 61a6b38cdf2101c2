"""MP4 files read by ranges: headers by seek, samples by offset and size; media that nobody asked for is never read.

Two data sources in Python, for any store that pyarrow's file systems reach (file, hdfs, s3, gs):

* `mp4_boxes`: the rows of container.boxes(). A partition is a range of the list of files. A task seeks from one top-level box to the next and reads
  sixteen bytes of each; only metadata is read whole.
* `mp4_samples`: a row a sample with its bytes. Files are cut into byte ranges, so one large file is spread over many tasks; a sample belongs to the range that
  its first byte is in. A partition is a run of ranges, one of full size or many small ones. A task reads a file's metadata once for all its ranges and then its own samples only, neighbours in one read.

Options: path (a file, a folder, or a pattern in its last part), range_bytes, files_per_task.
"""

from __future__ import annotations

import fnmatch
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from framelake.sources import container as C

#: Bytes of a file's range, files of a task, and bytes between two samples that are rather read than skipped.
RANGE_BYTES, FILES_A_TASK, GAP = 64 << 20, 64, 64 << 10
#: Bytes that one read asks for at most.
READ_BYTES = 8 << 20
#: Ranges of a task, if they are small, at least and at most; between them as many as make this number of tasks.
LEAST_RANGES, MOST_RANGES, TASKS = 64, 1024, 256
SAMPLES = "path string, trak int, sample_idx bigint, offset bigint, size bigint, dts bigint, pts bigint, duration bigint, description_index bigint, is_sync boolean, data binary, error string"


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    if path.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    if "://" in path:
        return pafs.FileSystem.from_uri(path)
    return pafs.LocalFileSystem(), path


def list_files(path: str) -> list[tuple[str, int]]:
    """(path, bytes) of the files that a path names, in order: one file, all below a folder, or those whose names match a pattern."""
    fs, at = file_system(path)
    prefix = path[: len(path) - len(at)] if path.endswith(at) else ""
    folder, _, last = at.rpartition("/")
    pattern = last if any(c in last for c in "*?[") else "*"
    if pattern == "*" and last != "*":
        info = fs.get_file_info(at)
        if info.type == pafs.FileType.File:
            return [(prefix + info.path, info.size)]
        folder = at
    found = fs.get_file_info(pafs.FileSelector(folder, recursive=pattern == "*"))
    kept = [i for i in found if i.type == pafs.FileType.File and not i.base_name.startswith(("_", ".")) and fnmatch.fnmatch(i.base_name, pattern)]
    return sorted((prefix + i.path, i.size) for i in kept)


def seek_boxes(f: pa.NativeFile, size: int) -> Iterator[tuple]:
    """The rows of container.boxes() for an open file: what stands in media boxes is passed over."""
    at, order = 0, 0
    while at < size:
        f.seek(at)
        head = f.read(min(16, size - at))
        n, skip = int.from_bytes(head[:4], "big"), 8
        if size - at >= 16 and n == 1:
            n, skip = int.from_bytes(head[8:16], "big"), 16
        elif n == 0:
            n = size - at
        kind, bad = head[4:8].decode("latin-1"), C.header_error(size - at, n, skip)
        if bad or kind in C.MEDIA:
            yield (-1, f"/{kind}", 0, order, kind, at, n, skip, None, bad)
            if bad:
                return
        else:  # metadata: the scan of whole contents does the rest
            f.seek(at)
            data = f.read(n)
            for trak, box, depth, place, inner, offset, *rest in C.scan_boxes(data, 0, n, 0, "", -1):
                yield (trak, box, depth, order if depth == 0 else place, inner, offset + at, *rest)
        at, order = at + n, order + 1


@dataclass
class Files(InputPartition):
    files: list[tuple[str, int]]


@dataclass
class Range:
    path: str
    size: int
    start: int
    end: int


@dataclass
class Ranges(InputPartition):
    ranges: list[Range]


class BoxReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options = options

    def partitions(self) -> list[InputPartition]:
        n = int(self.options.get("files_per_task", FILES_A_TASK))
        files = list_files(self.options["path"])
        return [Files(files[i : i + n]) for i in range(0, len(files), n)] or [Files([])]

    def read(self, partition: Files) -> Iterator[tuple]:
        for path, size in partition.files:
            fs, at = file_system(path)
            with fs.open_input_file(at) as f:
                for row in seek_boxes(f, size):
                    yield (path, *row)


class Mp4Boxes(DataSource):
    """spark.read.format("mp4_boxes").load(path)"""

    @classmethod
    def name(cls) -> str:
        return "mp4_boxes"

    def schema(self) -> str:
        return C.BOXES

    def reader(self, schema) -> DataSourceReader:
        return BoxReader(dict(self.options))


class Malformed(ValueError):
    """What a track's tables break."""


def sample_arrays(tables: dict[str, bytes | None]) -> dict[str, np.ndarray]:
    """The columns of a track's sample table; raises Malformed. Tables as container.tracks() has them."""
    if all(tables[k] is None for k in ("stts", "stsc", "stsz", "stco", "co64")):
        return {k: np.zeros(0, dtype=np.int64) for k in ("offset", "size", "dts", "pts", "duration", "description_index", "is_sync")}
    for k in ("stts", "stsc", "stsz"):
        if tables[k] is None:
            raise Malformed(f"{k} box is missing")
    if (tables["stco"] is None) == (tables["co64"] is None):
        raise Malformed("not exactly one of stco and co64")
    facts = {}
    try:
        for kind, rows in C.track_facts(**tables):
            facts[kind] = rows
    except (ValueError, IndexError) as e:
        raise Malformed(str(e)) from e
    count = int(facts["size"][:, 1].sum())
    spread = lambda rows, c: np.repeat(rows[:, c], rows[:, 1])
    place = lambda rows: np.arange(int(rows[:, 1].sum())) - np.repeat(rows[:, 0], rows[:, 1])
    if tables["ctts"] is not None and tables["ctts"][0] > 1:
        raise Malformed("ctts box has an unknown version")
    steps = facts["step"]
    if not len(steps):
        raise Malformed("stsc box is empty")
    if (steps <= 0).any() or steps[0, 0] != 1 or (np.diff(steps[:, 0]) <= 0).any():
        raise Malformed("stsc box is not in order")
    for k in ("time", *["shift"] * (tables["ctts"] is not None)):
        if (facts[k][:, 1] == 0).any():
            raise Malformed(f"{'stts' if k == 'time' else 'ctts'} box has a zero count")
        if int(facts[k][:, 1].sum()) != count:
            raise Malformed("sample tables differ in length")
    if int(facts["chunk"][:, 1].sum()) != count:
        raise Malformed("sample tables differ in length")
    sync = facts["sync"][:, 0]
    if ((sync < 0) | (sync >= count)).any():
        raise Malformed("stss box names a sample that is not there")
    size, time, chunk = spread(facts["size"], 2), facts["time"], facts["chunk"]
    first = chunk[chunk[:, 1] > 0]
    before = np.cumsum(size) - size
    offset = spread(chunk, 2) + before - np.repeat(before[first[:, 0]], first[:, 1])
    dts = spread(time, 2) + place(time) * spread(time, 3)
    marked = np.zeros(count, dtype=bool)
    marked[sync] = True
    shift = spread(facts["shift"], 2) if tables["ctts"] is not None else 0
    return {"offset": offset, "size": size, "dts": dts, "pts": dts + shift, "duration": spread(time, 3), "description_index": spread(chunk, 3), "is_sync": marked if tables["stss"] is not None else ~marked}


def read_samples(f: pa.NativeFile, offset: np.ndarray, size: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """(position in the arrays, bytes) of each sample, in order of offset; samples that lie close come from one read."""
    order = np.argsort(offset, kind="stable")
    at = 0
    while at < len(order):
        start = int(offset[order[at]])
        last, end = at, start + int(size[order[at]])
        while last + 1 < len(order):
            o, s = int(offset[order[last + 1]]), int(size[order[last + 1]])
            if o > end + GAP or max(end, o + s) - start > READ_BYTES:
                break
            last, end = last + 1, max(end, o + s)
        f.seek(start)
        data = f.read(end - start)
        for i in order[at : last + 1].tolist():
            o = int(offset[i]) - start
            yield i, data[o : o + int(size[i])]
        at = last + 1


_TABLES = ("stts", "ctts", "stsc", "stsz", "stco", "co64", "stss")


def dealt(files: list[tuple[str, int]], range_bytes: int) -> list[Ranges]:
    """The files' ranges as partitions: in order, as many ranges a task as have RANGE_BYTES, a small one counted as a share of that. Neighbours of a file that meet in a task are one range."""
    share = RANGE_BYTES // min(MOST_RANGES, max(LEAST_RANGES, sum(-(-size // range_bytes) for _, size in files) // TASKS))
    out, held = [], 0
    for path, size in files:
        for at in range(0, size, range_bytes):
            end = min(size, at + range_bytes)
            cost = max(share, end - at)
            if not out or held + cost > RANGE_BYTES:
                out.append(Ranges([]))
                held = 0
            held += cost
            own = out[-1].ranges
            if at and own:
                own[-1].end = end
            else:
                own.append(Range(path, size, at, end))
    return out


class SampleReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options = options

    def partitions(self) -> list[InputPartition]:
        return dealt(list_files(self.options["path"]), int(self.options.get("range_bytes", RANGE_BYTES))) or [Ranges([])]

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        for part in partition.ranges:
            yield from self._read(part)

    def _read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        fs, at = file_system(partition.path)
        with fs.open_input_file(at) as f:
            traks: dict[int, dict[str, bytes | None]] = {}
            described: set[int] = set()
            for trak, _, _, _, kind, _, _, _, payload, error in seek_boxes(f, partition.size):
                if error is None and trak >= 0:
                    mine = traks.setdefault(trak, dict.fromkeys(_TABLES))
                    if kind in mine and mine[kind] is None:
                        mine[kind] = payload
                    if kind == "stsd":
                        described.add(trak)
            for trak, tables in sorted(traks.items()):
                if trak not in described:
                    continue
                try:
                    s = sample_arrays(tables)
                except Malformed as e:
                    if partition.start == 0:  # once a file
                        yield self._rows(partition.path, trak, None, [], str(e))
                    continue
                own = np.flatnonzero((s["offset"] >= partition.start) & (s["offset"] < partition.end))
                if partition.end == partition.size:  # what begins behind the end is in no range
                    own = np.concatenate([own, np.flatnonzero(s["offset"] >= partition.size)])
                rows, held = [], 0
                for i, data in read_samples(f, s["offset"][own], s["size"][own]):
                    rows.append((int(own[i]), data))
                    held += len(data)
                    if held >= READ_BYTES:
                        yield self._rows(partition.path, trak, s, rows, None)
                        rows, held = [], 0
                if rows:
                    yield self._rows(partition.path, trak, s, rows, None)

    @staticmethod
    def _rows(path: str, trak: int, s: dict[str, np.ndarray] | None, rows: list[tuple[int, bytes]], error: str | None) -> pa.RecordBatch:
        n = len(rows) if error is None else 1
        at = np.array([i for i, _ in rows], dtype=np.int64)
        out = {"path": pa.array([path] * n), "trak": pa.array([trak] * n, pa.int32()), "sample_idx": pa.array(at) if s else pa.nulls(1, pa.int64())}
        for k in ("offset", "size", "dts", "pts", "duration", "description_index"):
            out[k] = pa.array(s[k][at], pa.int64()) if s else pa.nulls(1, pa.int64())
        out["is_sync"] = pa.array(s["is_sync"][at], pa.bool_()) if s else pa.nulls(1, pa.bool_())
        cut = [s is not None and len(d) < int(s["size"][i]) for i, d in rows]
        out["data"] = pa.array([None if c else d for c, (_, d) in zip(cut, rows, strict=True)], pa.binary()) if s else pa.nulls(1, pa.binary())
        out["error"] = pa.array(["sample runs past its file" if c else None for c in cut], pa.string()) if s else pa.array([error])
        return pa.record_batch(out)


class Mp4Samples(DataSource):
    """spark.read.format("mp4_samples").load(path)"""

    @classmethod
    def name(cls) -> str:
        return "mp4_samples"

    def schema(self) -> str:
        return SAMPLES

    def reader(self, schema) -> DataSourceReader:
        return SampleReader(dict(self.options))


def register(spark: SparkSession) -> None:
    for source in (Mp4Boxes, Mp4Samples):
        spark.dataSource.register(source)


def boxes(spark: SparkSession, path: str, files_per_task: int = FILES_A_TASK) -> DataFrame:
    """container.boxes() of the files at path, of which media is not read."""
    register(spark)
    return spark.read.format("mp4_boxes").option("files_per_task", files_per_task).load(path)


def samples(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Every sample of every track of the files at path with its bytes. A malformed track is one row with an error; a sample that its file does not hold whole has an error and null data."""
    register(spark)
    return spark.read.format("mp4_samples").option("range_bytes", range_bytes).load(path)
