"""Timelines of samples: decode times, presentation order and durations, groups of pictures, reorder buffer.

A sample row has a track key, idx (its decode index in the track) and delta (its duration in ticks). What goes by decode order is one
pass over the samples, what goes by presentation order another (scan.scan).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framelake.operators.scan import Carried, following, index, latest, prefix, running_max, scan

#: Samples of a chunk of a track, for orders that go by an index; ticks of a chunk for those by presentation time.
CHUNK_SAMPLES, CHUNK_TICKS = 1 << 16, 1 << 23
NANOSECONDS = 1_000_000_000


def by_index(column: str = "idx") -> Column:
    """The chunk of an index."""
    return F.floor(F.col(column) / CHUNK_SAMPLES)


def in_decode_order(samples: DataFrame, track: str, **columns: Carried) -> DataFrame:
    return scan(samples, [track], ["idx"], by_index(), **columns)


def in_presentation_order(samples: DataFrame, track: str, **columns: Carried) -> DataFrame:
    """Columns along presentation order, ties in decode order."""
    return scan(samples, [track], ["pts", "idx"], F.floor(F.col("pts") / CHUNK_TICKS), **columns)


def decode_times(samples: DataFrame, track: str, offset: Column) -> DataFrame:
    """samples with dts (running sum of delta) and pts (dts and the sample's composition offset, which may be negative)."""
    return in_decode_order(samples, track, dts=prefix(F.col("delta"))).withColumn("pts", (F.col("dts") + offset).cast("bigint"))


def presentation_order(samples: DataFrame, track: str) -> DataFrame:
    """samples with pos: the place in presentation order, ties in decode order."""
    return in_presentation_order(samples, track, pos=index())


def presented_ticks(pts: str = "pts", next_pts: str = "next_pts", delta: str = "delta") -> Column:
    """Ticks to the next presented sample where that is later, else the sample's own."""
    gap = F.col(next_pts) - F.col(pts)
    return F.when(gap > 0, gap).otherwise(F.col(delta)).cast("bigint")


def presentation_durations(samples: DataFrame, track: str, timescale: int) -> DataFrame:
    """samples with ticks (presented_ticks()) and duration_ns (truncated; null where ticks are not positive, which is an error of the file)."""
    out = in_presentation_order(samples, track, next_pts=following(F.col("pts"))).withColumn("ticks", presented_ticks()).drop("next_pts")
    return out.withColumn("duration_ns", F.when(F.col("ticks") > 0, ticks_to_ns("ticks", timescale)))


def presentation_timeline(samples: DataFrame, track: str, timescale: int) -> DataFrame:
    """samples (with pts) with pos, ticks, duration_ns and held, in one pass."""
    out = in_presentation_order(samples, track, pos=index(), next_pts=following(F.col("pts")), __top=running_max(F.col("idx")))
    out = out.withColumn("ticks", presented_ticks()).withColumn("held", (F.col("__top") + 1 - F.col("pos")).cast("bigint")).drop("next_pts", "__top")
    return out.withColumn("duration_ns", F.when(F.col("ticks") > 0, ticks_to_ns("ticks", timescale)))


def ticks_to_ns(ticks: str, timescale: int) -> Column:
    return F.expr(f"CAST({ticks} AS BIGINT) * {NANOSECONDS} div {timescale}")


def saturated_ns(ticks: str, timescale: str) -> Column:
    """Whole seconds and the rest, so that nothing overflows before the largest duration is reached; 0 without a timescale."""
    most = (1 << 63) - 1
    exact = f"(CAST({ticks} AS DECIMAL(20,0)) div {timescale}) * CAST({NANOSECONDS} AS DECIMAL(10,0)) + (CAST({ticks} AS DECIMAL(20,0)) % {timescale}) * {NANOSECONDS} div {timescale}"
    return F.expr(f"CASE WHEN {timescale} = 0 THEN 0L ELSE CAST(least({exact}, CAST({most} AS DECIMAL(38,0))) AS BIGINT) END")


def gop_number(before: Column, starts: Column) -> Column:
    """The group of pictures that a sample is in, from how many groups start before it and whether it starts one."""
    return (before + starts.cast("int")).cast("bigint")


def gop_ids(samples: DataFrame, track: str, starts: Column) -> DataFrame:
    """samples with gop: how many samples up to and including this one start a group of pictures."""
    counted = in_decode_order(samples, track, __g=prefix(starts.cast("int")))
    return counted.withColumn("gop", gop_number(F.col("__g"), starts)).drop("__g")


def reorder_occupancy(samples: DataFrame, track: str) -> DataFrame:
    """samples (with pts) with pos and held: the decoded samples not yet presented just before this one is."""
    out = in_presentation_order(samples, track, pos=index(), __top=running_max(F.col("idx")))
    return out.withColumn("held", (F.col("__top") + 1 - F.col("pos")).cast("bigint")).drop("__top")


def in_force(samples: DataFrame, track: str, value: Column, name: str) -> DataFrame:
    """samples with the latest non-null value at or before each in decode order."""
    return in_decode_order(samples, track, **{name: latest(value)})


def newest(samples: DataFrame, track: str, n: int) -> DataFrame:
    """The n newest samples of each track, rank 1 the newest; Spark keeps n a track before it shuffles."""
    order = Window.partitionBy(track).orderBy(F.desc("idx"))
    return samples.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def byte_offsets(sizes: DataFrame, chunk_keys: list[str], order: list[str], size: str) -> DataFrame:
    """sizes with offset: bytes of the chunk's earlier samples. A chunk of a container is small."""
    before = Window.partitionBy(*chunk_keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return sizes.withColumn("offset", F.coalesce(F.sum(size).over(before), F.lit(0)).cast("bigint"))


def expand_runs(runs: DataFrame, track: str, order: str, length: str, name: str = "sample_idx") -> DataFrame:
    """One row for each unit of each run of a run-length list: rep inside the run, and the index in the track."""
    placed = scan(runs, [track], [order], by_index(order), __first=prefix(F.col(length)))
    rows = placed.where(F.col(length) > 0).withColumn("rep", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(length).cast("bigint") - 1)))
    return rows.withColumn(name, F.col("__first") + F.col("rep")).drop("__first")
