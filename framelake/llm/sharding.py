"""Sharding by longest-processing-time scheduling: groups stay together, the largest goes first, always to the least loaded shard.

One heap over all groups would be one task, so the schedule is a tree. Groups are dealt by hash to
parts of about PART_GROUPS; each part schedules its own groups, largest first through a heap, on a
number of bins that is a multiple of the shards. The bins of up to FAN parts are then the jobs of
the next level, scheduled the same way, until one level's bins are the shards. A part sends its
bins on as one row, so what meets in a task is bounded at every level, whatever the input's size.
Equal sums stay equal within the smallest jobs of the last level, about 1% of a shard.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from framelake.llm.common import materialize, table

#: Groups of a part, bins of a part a shard, parts that meet at the next level.
PART_GROUPS, BINS_A_SHARD, FAN = 2048, 4, 256
#: Rows of a shard that are numbered together.
NUMBERED = 2000


def schedule(loads: np.ndarray, ties: np.ndarray, bins: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin of each job, load of each bin): jobs from the largest on, each to the least loaded bin, the lower one of equals."""
    heap = [(0, b) for b in range(bins)]
    to = np.zeros(len(loads), dtype=np.int32)
    for i in np.lexsort((ties, -loads)).tolist():
        load, b = heap[0]
        to[i] = b
        heapq.heapreplace(heap, (load + int(loads[i]), b))
    sums = np.zeros(bins, dtype=np.int64)
    for load, b in heap:
        sums[b] = load
    return to, sums


def assign(groups: DataFrame, shards: int) -> DataFrame:
    """(g, shard) for distinct groups (g binary, load bigint)."""
    n = groups.count()
    parts = max(1, -(-n // PART_GROUPS), min(16, n))
    levels = math.ceil(math.log(parts, FAN)) if parts > 1 else 0
    fan = math.ceil(parts ** (1 / levels)) if levels else 1

    def first(df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values("g").reset_index(drop=True)
        to, sums = schedule(df["load"].to_numpy(), df.index.to_numpy(), bins_at(0))
        return pd.DataFrame({"part": df["part"], "g": df["g"], "bin": to, "loads": [sums] + [None] * (len(df) - 1)})

    def next_level(bins: int, fan: int):
        def run(df: pd.DataFrame) -> pd.DataFrame:
            df = df.sort_values("part").reset_index(drop=True)
            loads = np.concatenate([np.asarray(x, dtype=np.int64) for x in df["loads"]])
            to, sums = schedule(loads, np.arange(len(loads)), bins)
            each = np.split(to, np.cumsum([len(x) for x in df["loads"]])[:-1])
            return pd.DataFrame({"part": df["part"], "up": df["part"] // fan, "bins": each, "loads": [sums] + [None] * (len(df) - 1)})

        return run

    def bins_at(level: int) -> int:
        return shards if level == levels else shards * BINS_A_SHARD

    dealt = groups.withColumn("part", F.pmod(F.xxhash64("g"), F.lit(parts)))
    lowest = materialize(dealt.groupBy("part").applyInPandas(first, "part bigint, g binary, bin int, loads array<bigint>"), "lpt")
    tables, below = [], lowest
    for level in range(1, levels + 1):
        rows = below.where("loads is not null").select("part" if level == 1 else F.col("up").alias("part"), "loads")
        below = materialize(rows.groupBy((F.col("part") / fan).cast("bigint").alias("into")).applyInPandas(next_level(bins_at(level), fan), "part bigint, up bigint, bins array<int>, loads array<bigint>"), "lpt")
        tables.append(below)
    # from the last level down: what each bin has become
    shard_of = None
    for t in reversed(tables):
        if shard_of is None:
            shard_of = t.select("part", F.col("bins").alias("shards"))
        else:
            up = shard_of.select(F.col("part").alias("up"), F.col("shards").alias("above"))
            shard_of = t.join(up, "up").select("part", F.expr("transform(bins, b -> element_at(above, b + 1))").alias("shards"))
    if shard_of is None:
        return lowest.select("g", F.col("bin").alias("shard"))
    return lowest.join(shard_of, "part").select("g", F.expr("element_at(shards, bin + 1)").alias("shard"))


def shard_documents(docs: DataFrame, shards: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, size, text_crc32, law, shard, slot, grown_shard) for every row of docs.

    size is the text's UTF-8 bytes plus 8. Rows of equal text stay in one shard; null texts are one
    such group of size 8 a row, with a null crc. slot numbers a shard's rows from 0 without a gap,
    by a hash of the key and the text's crc and then the key; rows that repeat a key, or have none, get a slot each. The law is
    `bytes`: shards have near equal sums of size, as far as a group larger than a shard's share
    allows. grown_shard is null, as that law says nothing of another number of shards.
    """
    base = docs.select(
        F.col(key).alias("k"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("bigint").alias("size"),
        F.crc32(F.col(text).cast("binary")).alias("text_crc32"),
        F.coalesce(F.unhex(F.md5(F.col(text).cast("binary"))), F.lit(b"")).alias("g"),
    )
    base = materialize(base, "sizes")
    placed = assign(base.groupBy("g").agg(F.sum("size").alias("load")), shards)
    parts = max(1, base.count() // (shards * NUMBERED))
    rows = base.join(placed, "g").select("k", "size", "text_crc32", "shard", F.pmod(F.xxhash64("k", "text_crc32"), F.lit(parts)).alias("sub"))
    rows = materialize(rows, "placed")
    order = Window.partitionBy("shard").orderBy("sub").rowsBetween(Window.unboundedPreceding, -1)
    before = rows.groupBy("shard", "sub").count().select("shard", "sub", F.coalesce(F.sum("count").over(order), F.lit(0)).alias("before"))
    inside = Window.partitionBy("shard", "sub").orderBy("k", "size", "text_crc32")
    numbered = rows.withColumn("inner", F.row_number().over(inside) - 1).join(before, ["shard", "sub"])
    return numbered.select(F.col("k").alias(key), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("before") + F.col("inner")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents", "doc_id", "text"), 24)
