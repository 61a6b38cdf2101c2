"""Frames written to the folder that all machines share, where a later step reads them more than once; memory of Python workers."""

from __future__ import annotations

import contextlib
import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def new_folder(spark: SparkSession, name: str) -> str:
    """A new path under spark.checkpoint.dir, which driver and executors share.

    Where it is unset, a master that runs all in one machine gets a folder of its own; any other raises an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.match(r"local(\[[^,]*\])?$", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='framelake-')}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"


_written: list[str] = []


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: computed once, and safe from lost executors. clear_stored() deletes it."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    _written.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clear_stored(spark: SparkSession) -> int:
    """Delete all that stored() has written in this process, once no frame that reads it is needed; how many tables that were."""
    jvm, conf, n = spark._jvm, spark._jsparkSession.sessionState().newHadoopConf(), len(_written)
    while _written:
        path = jvm.org.apache.hadoop.fs.Path(_written.pop())
        path.getFileSystem(conf).delete(path, True)
    return n


def bounded_batches(spark: SparkSession) -> None:
    """Hold what goes to a Python worker at once to 2 MB (of rows beyond the first), as files and streams vary in size."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "2m")


def frugal(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """run(), which maps a partition's batches; at its end the worker, which lives on, gives memory back to the machine."""

    def wrapped(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # another C library
                ctypes.CDLL(None).malloc_trim(0)

    return wrapped
