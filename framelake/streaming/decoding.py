"""Decoder state over a stream of samples: the parameter set in force and the decoded-picture buffer, kept a track.

State is small whatever the track's length: an id and at most max_refs picture ids. Samples of a
track must come in decode order from batch to batch; inside a batch they are put in order.
"""

from __future__ import annotations

import json
import re
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from framelake.operators.references import marked
from framelake.sources.storage import new_folder

#: Rows of a slice, about, and slices of a batch at most; of a track no batch holds more rows than a slice has.
SLICE_ROWS, SLICES_A_BATCH = 1_000_000, 16
OUT = "user_id bigint, event_id bigint, set_id bigint, refs string"


def decoder_state(stream: DataFrame, max_refs: int = 4) -> DataFrame:
    """(user_id, event_id, set_id, refs) for each row of a stream of (user_id, event_id, ts, starts).

    A row that starts a group of pictures brings a new parameter set and empties the buffer; refs
    lists the pictures that the row can refer to, newest first, of which the buffer keeps max_refs.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        current, held = state.get if state.exists else (None, [])
        held = list(held)
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        out = []
        for event, starts in zip(rows["event_id"].tolist(), rows["starts"].tolist(), strict=True):
            if starts:
                current, held = event, []
            out.append((key[0], event, current, ",".join(map(str, held))))
            held = [event, *held][:max_refs]
        state.update((current, held))
        made = pd.DataFrame(out, columns=["user_id", "event_id", "set_id", "refs"])
        made["set_id"] = made["set_id"].astype("Int64")
        yield made

    return stream.groupBy("user_id").applyInPandasWithState(run, OUT, "current bigint, held array<bigint>", "append", GroupStateTimeout.NoTimeout)


MARKED = "track string, sample bigint, held string, error string"


def marking_state(stream: DataFrame, max_refs: int = 4, largest: int = 16) -> DataFrame:
    """(track, sample, held, error) for each row of a stream of reference pictures: the decoded-picture buffer that the picture is decoded with, and what its marking breaks.

    Rows are (track, sample, ts, frame_num, idr, long_term, adaptive, operations). A track's name has the sample description in it where a file has several, so that each has
    a buffer of its own. held lists picture:frame_num, with L and the index for long-term pictures, in order of arrival.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = [tuple(json.loads(x)) for x in state.get[0]] if state.exists else []
        rows = pd.concat(list(batches)).sort_values(["ts", "sample"])
        out = []
        for r in rows.itertuples(index=False):
            seen = ",".join(f"{p}:{n}" + (f"L{k}" if is_long else "") for p, n, is_long, k in held)
            operations = [(o["operation"], o["first"], o["second"]) for o in r.operations]
            held, error = marked(held, int(r.sample), int(r.frame_num), bool(r.idr), bool(r.long_term), bool(r.adaptive), operations, largest, max_refs)
            out.append((key[0], r.sample, seen, error))
        state.update(([json.dumps(p) for p in held],))
        yield pd.DataFrame(out, columns=["track", "sample", "held", "error"])

    return stream.groupBy("track").applyInPandasWithState(run, MARKED, "held array<string>", "append", GroupStateTimeout.NoTimeout)


def time_slices(rows: DataFrame, order: list[str], slice_rows: int, folder: str) -> int:
    """Write rows to folder as files slice=0, 1, ... of about slice_rows rows, cut along order, whose times of change ascend: a stream takes one after another. Returns their number."""
    spark = rows.sparkSession
    n = max(1, -(-rows.count() // slice_rows))
    # whatever the table's files are: a stream takes its files in no order of their rows
    dealt = rows.repartitionByRange(n, *[F.col(c).asc_nulls_last() for c in order]).withColumn("slice", F.spark_partition_id())
    dealt.write.partitionBy("slice").parquet(folder)
    jvm = spark._jvm
    pattern = jvm.org.apache.hadoop.fs.Path(f"{folder}/slice=*/*.parquet")
    fs = pattern.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    files = sorted((int(re.search(r"slice=(\d+)/", f.getPath().toString())[1]), f.getPath().toString()) for f in fs.globStatus(pattern) or [])
    start = int(time.time() * 1000) - 20 * len(files)
    for k, (_, path) in enumerate(files):  # a call a file, of a million rows each
        fs.setTimes(jvm.org.apache.hadoop.fs.Path(path), start + 10 * k, -1)
    return len(files)


ROCKS = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


def slices_a_batch(slices: DataFrame, tracks: list[str | Column], most_rows: int = SLICE_ROWS) -> int:
    """The most neighbouring slices, SLICES_A_BATCH at most, of which no run holds more than most_rows rows of a track.

    A track of a batch has its price, however few its rows are: with a batch a slice, tracks that last would be met in each, more often the more tracks there are.
    """
    largest = slices.groupBy("slice", *tracks).count().groupBy("slice").agg(F.max("count").alias("n")).orderBy("slice")
    rows = [r.n for r in largest.collect()]  # one a slice of a million rows
    fits = lambda m: all(sum(rows[i : i + m]) <= most_rows for i in range(len(rows)))
    return next((m for m in range(min(SLICES_A_BATCH, len(rows)), 1, -1) if fits(m)), 1)


def streamed(rows: DataFrame, order: list[str], state: Callable[[DataFrame], DataFrame], schema: str, slice_rows: int | None = None, conf: dict[str, str] | None = None, tracks: tuple[str | Column, ...] = ("track",)) -> DataFrame:
    """state() over rows, slices along order as batches of one stream, into a table of the shared folder.

    A batch is one slice of slice_rows, or, without that, as many slices of SLICE_ROWS as slices_a_batch() says: what a worker holds of a track at once is no more than one slice. conf holds while the stream starts.
    """
    spark = rows.sparkSession
    folder = new_folder(spark, "decoder")
    if not time_slices(rows, order, slice_rows or SLICE_ROWS, f"{folder}/slices"):
        return spark.createDataFrame([], schema)
    slices = spark.read.parquet(f"{folder}/slices")
    files = 1 if slice_rows else slices_a_batch(slices, list(tracks))
    stream = spark.readStream.schema(slices.schema).option("maxFilesPerTrigger", files).parquet(f"{folder}/slices").drop("slice")
    before = {k: spark.conf.get(k, None) for k in conf or {}}
    for k, v in (conf or {}).items():
        spark.conf.set(k, v)
    try:
        query = state(stream).writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    return spark.read.schema(schema).parquet(f"{folder}/out")


def decoder_rows(spark: SparkSession, sf_dir: str, slice_rows: int | None = None) -> DataFrame:
    """decoder_state() over the events."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    events = events.select("user_id", "event_id", "ts", F.coalesce(F.col("event_type") == "signup", F.lit(False)).alias("starts"))
    return streamed(events, ["ts", "event_id"], decoder_state, OUT, slice_rows, tracks=("user_id",))


def marked_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as reference pictures of a track a user: a sign-up is an IDR picture, numbers in props choose the operations."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("k", F.coalesce(F.regexp_extract("props", "([0-9]+)", 1).try_cast("bigint"), F.lit(0)))
    op = lambda n, first, second="0": f"named_struct('operation', {n}L, 'first', CAST({first} AS BIGINT), 'second', CAST({second} AS BIGINT))"
    operations = f"CASE k % 9 WHEN 1 THEN array({op(1, 'k % 3')}) WHEN 2 THEN array({op(3, 'k % 2', 'k % 4')}) WHEN 3 THEN array({op(2, 'k % 4')}) WHEN 4 THEN array({op(4, 'k % 3')}) WHEN 5 THEN array({op(6, 'k % 4')}) WHEN 6 THEN array({op(1, '0')}, {op(1, '1')}) WHEN 7 THEN array({op(5, '0')}) ELSE array() END"
    return e.selectExpr("CAST(user_id AS STRING) AS track", "event_id AS sample", "ts", "event_id % 16 AS frame_num", "coalesce(event_type = 'signup', false) AS idr", "k % 2 = 1 AS long_term", "k % 9 BETWEEN 1 AND 7 AS adaptive", f"CAST({operations} AS ARRAY<STRUCT<operation: BIGINT, first: BIGINT, second: BIGINT>>) AS operations")


def marking_rows(spark: SparkSession, sf_dir: str, slice_rows: int | None = None) -> DataFrame:
    """marking_state() over the events as reference pictures."""
    return streamed(marked_events(spark, sf_dir), ["ts", "sample"], marking_state, MARKED, slice_rows)
