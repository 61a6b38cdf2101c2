"""A data source that writes one file a row, and pictures through it.

`df.write.format("whole_files").mode("append").save(path)` takes rows (name, content). A task writes into a folder of its own below
path/_temporary; the commit renames the folders of the tasks that Spark counts, one rename a task, to path/part-*, and deletes the rest,
so a lost or repeated task leaves nothing and names need only be unique in a task. Read them with `path/part-*/*`. overwrite replaces the parts that are there.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from framelake.sources.ranges import file_system

IMAGES = "name string, content binary, error string"


@dataclass
class Part(WriterCommitMessage):
    folder: str
    files: int


class FolderWriter(DataSourceArrowWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite, self.job = path, overwrite, uuid.uuid4().hex

    def _places(self) -> tuple[pafs.FileSystem, str, str]:
        fs, at = file_system(self.path)
        at = at.rstrip("/")
        return fs, at, f"{at}/_temporary/{self.job}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        fs, _, temporary = self._places()
        folder, n = uuid.uuid4().hex, 0
        fs.create_dir(f"{temporary}/{folder}", recursive=True)
        for batch in iterator:
            for name, content in zip(batch.column("name").to_pylist(), batch.column("content").to_pylist(), strict=True):
                if not name or "/" in name or name.startswith((".", "_")):
                    raise ValueError(f"{name!r} names no file")
                if content is None:
                    raise ValueError(f"{name} has no content")
                if fs.get_file_info(f"{temporary}/{folder}/{name}").type != pafs.FileType.NotFound:
                    raise ValueError(f"{name} comes twice in a task")
                with fs.open_output_stream(f"{temporary}/{folder}/{name}") as out:
                    out.write(content)
                n += 1
        return Part(folder, n)

    def _clean(self, fs: pafs.FileSystem, at: str, temporary: str) -> None:
        fs.delete_dir_contents(temporary, missing_dir_ok=True)
        fs.delete_dir(temporary) if fs.get_file_info(temporary).type == pafs.FileType.Directory else None
        outer = f"{at}/_temporary"
        if fs.get_file_info(outer).type == pafs.FileType.Directory and not fs.get_file_info(pafs.FileSelector(outer)):
            fs.delete_dir(outer)  # no other job is at work

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        fs, at, temporary = self._places()
        old = [i.path for i in fs.get_file_info(pafs.FileSelector(at, allow_not_found=True)) if i.base_name.startswith("part-")] if self.overwrite else []
        for m in messages:
            if m is not None and m.files:
                fs.move(f"{temporary}/{m.folder}", f"{at}/part-{m.folder}")
        for path in old:
            fs.delete_dir(path)
        self._clean(fs, at, temporary)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        self._clean(*self._places())


class WholeFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "whole_files"

    def schema(self) -> str:
        return "name string, content binary"

    def writer(self, schema, overwrite: bool) -> FolderWriter:
        return FolderWriter(self.options["path"], overwrite)


def write_files(rows: DataFrame, path: str, mode: str = "append") -> str:
    """Write rows (name, content) as files below path; returns the pattern that they are read by. No rows write nothing."""
    rows.sparkSession.dataSource.register(WholeFiles)
    rows.select("name", "content").write.format("whole_files").mode(mode).save(path)
    return f"{path}/part-*/*"


def rgb(y: np.ndarray, cb: np.ndarray, cr: np.ndarray) -> np.ndarray:
    """(height, width, 3) bytes of a picture of 4:2:0 planes: limited-range BT.601 in integers, odd sizes too."""
    h, w = y.shape
    c = 298 * np.maximum(y.astype(np.int64) - 16, 0)
    d, e = (p.astype(np.int64).repeat(2, axis=0).repeat(2, axis=1)[:h, :w] - 128 for p in (cb, cr))
    parts = [c + 409 * e, c - 100 * d - 208 * e, c + 516 * d]
    return np.stack([np.clip((p + 128) >> 8, 0, 255) for p in parts], axis=2).astype(np.uint8)


def images(frames: DataFrame, name: str = "name") -> DataFrame:
    """(name, content, error) for frames (name, width, height, y, cb, cr): each frame as a PPM picture.

    Planes are binary, chroma has half the size rounded up. A frame with a null, with a size below 1, or whose planes are not as long as its size asks for has an error and null content.
    """

    def picture(width: int | None, height: int | None, *planes: bytes | None) -> bytes | str:
        if width is None or height is None or None in planes:
            return "frame has a null"
        if width < 1 or height < 1:
            return "frame has no size"
        small = (height + 1) // 2, (width + 1) // 2
        if [len(p) for p in planes] != [width * height, small[0] * small[1], small[0] * small[1]]:
            return "a plane has a wrong length"
        y, cb, cr = (np.frombuffer(p, dtype=np.uint8).reshape(s) for p, s in zip(planes, ((height, width), small, small), strict=True))
        return b"P6\n%d %d\n255\n" % (width, height) + rgb(y, cb, cr).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [picture(*row) for row in zip(*[batch.column(c).to_pylist() for c in ("width", "height", "y", "cb", "cr")], strict=True)]
            yield pa.record_batch({"name": batch.column("name"), "content": pa.array([m if isinstance(m, bytes) else None for m in made], pa.binary()), "error": pa.array([m if isinstance(m, str) else None for m in made], pa.string())})

    return frames.selectExpr(f"CAST(`{name}` AS STRING) AS name", "CAST(width AS INT) AS width", "CAST(height AS INT) AS height", "y", "cb", "cr").mapInArrow(run, IMAGES)


def read_files(spark: SparkSession, pattern: str) -> DataFrame:
    """(name, content) of written files."""
    return spark.read.format("binaryFile").load(pattern).selectExpr("substring_index(path, '/', -1) AS name", "content")
