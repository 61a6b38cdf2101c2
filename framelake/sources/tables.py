"""Reading the driver tables, and the tracks, steps and samples that the catalogue derives from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.operators.scan import Carried, index, prefix, scan
from framelake.sources.storage import stored


def read(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def samples(spark: SparkSession, sf_dir: str, **columns: Carried) -> DataFrame:
    """events as samples: a track a user, idx in order of time, k from props, delta in ticks; and columns along that order, in the same pass."""
    e = read(spark, sf_dir, "events", "user_id", "event_id", "ts", "event_type", "props")
    e = e.withColumn("k", F.regexp_extract("props", "([0-9]+)", 1).cast("bigint")).withColumn("delta", (100 + F.col("k") % 7 * 10).cast("bigint"))
    return scan(e.drop("props"), ["user_id"], ["ts", "event_id"], F.date_trunc("day", F.col("ts")), idx=index(), **columns)


def timed(spark: SparkSession, sf_dir: str, **columns: Carried) -> DataFrame:
    """samples with dts and pts; composition offsets run from -150 to 450 ticks."""
    return samples(spark, sf_dir, dts=prefix(F.col("delta")), **columns).withColumn("pts", (F.col("dts") + (F.col("k") % 5 - 1) * 150).cast("bigint"))


def stored_timed(spark: SparkSession, sf_dir: str, **columns: Carried) -> DataFrame:
    """timed(), written once, for a scan in another order."""
    return stored(timed(spark, sf_dir, **columns), "timed")


#: The same in SQL.
SAMPLES_SQL = """s AS (SELECT user_id, event_id, ts, event_type, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k,
  100 + CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) % 7 * 10 AS delta,
  row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS idx FROM events)"""
TIMED_SQL = f"""{SAMPLES_SQL},
d AS (SELECT *, CAST(COALESCE(sum(delta) OVER (PARTITION BY user_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS dts FROM s),
t AS (SELECT *, dts + (k % 5 - 1) * 150 AS pts FROM d),
p AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY pts, idx) - 1 AS pos FROM t)"""
