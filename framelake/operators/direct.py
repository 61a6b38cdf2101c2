"""Temporal direct prediction as joins: the colocated picture as of each picture, the block at the same place in it, and the reference that this block names in the first list."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelake.functions import arithmetic as A
from framelake.operators.scan import following, latest, prefix, scan


def colocated(pictures: DataFrame, track: str, order: str, chunk: Column, backwards: Column) -> DataFrame:
    """pictures (track, order, poc, is_reference) with before (references before each) and next_picture, the first reference behind it in order.

    chunk never falls along order, backwards never falls against it: both directions are ordered scans, so a track may be of any length.
    """
    numbered = scan(pictures, [track], [order], chunk, before=prefix(F.coalesce(F.col("is_reference"), F.lit(False)).cast("int")))
    turned = numbered.withColumn("__back", -F.col(order))
    # against the order, the latest reference is the first one behind; a reference itself looks past itself
    seen = scan(turned, [track], ["__back"], backwards, __at=latest(F.when(F.col("is_reference"), F.col(order))))
    after = scan(seen, [track], [order], chunk, __next=following(F.col("__at")))
    return after.withColumn("next_picture", F.when(F.col("is_reference"), F.col("__next")).otherwise(F.col("__at"))).drop("__back", "__at", "__next")


def direct_motion(blocks: DataFrame, pictures: DataFrame, motion: DataFrame, track: str, picture: str, place: str, active: int) -> DataFrame:
    """(track, picture, place, ref0, ref1, x0, y0, x1, y1, error) for each block in temporal direct mode.

    blocks are rows (track, picture, place); pictures is colocated() with order named as picture; motion has a row a block of reference pictures (track, picture, place, x, y, back, intra): the vector, and how many references before its picture the one that it
    names stands (0 the nearest). The first list of a picture is the active nearest references before it, nearest first. An intra or missing colocated block gives references 0 and 0 and no motion; a
    picture without a later reference, and a reference that is not in the list, are errors.
    """
    info = pictures.select(track, F.col(picture).alias("__p"), "poc", "before", "next_picture")
    rows = blocks.select(track, picture, place).join(info, (blocks[track] == info[track]) & (blocks[picture] == F.col("__p")), "left").drop(info[track]).drop("__p")
    there = pictures.where("is_reference").select(F.col(track).alias("__t"), F.col(picture).alias("__c"), F.col("poc").alias("colocated_poc"), F.col("before").alias("__number"))
    rows = rows.join(there, (F.col(track) == F.col("__t")) & (F.col("next_picture") == F.col("__c")), "left").drop("__t", "__c")
    m = motion.select(F.col(track).alias("__t"), F.col(picture).alias("__c"), F.col(place).alias("__b"), "x", "y", "back", "intra")
    rows = rows.join(m, (F.col(track) == F.col("__t")) & (F.col("next_picture") == F.col("__c")) & (F.col(place) == F.col("__b")), "left").drop("__t", "__c", "__b")
    named = F.when(~F.coalesce("intra", F.lit(True)), F.col("__number") - 1 - F.col("back"))
    rows = rows.withColumn("__named", F.when(named >= 0, named))
    refs = pictures.where("is_reference").select(F.col(track).alias("__t"), F.col("before").alias("__n"), F.col("poc").alias("reference_poc"))
    rows = rows.join(refs, (F.col(track) == F.col("__t")) & (F.col("__named") == F.col("__n")), "left").drop("__t", "__n")
    at = F.when(F.col("__named").isNotNull(), F.col("before") - 1 - F.col("__named"))
    error = F.when(F.col("next_picture").isNull(), "no later reference").when((at < 0) | (at >= active), "colocated reference is not in the first list")
    rows = rows.withColumn("error", error).withColumn("__v", A.temporal_direct("x", "y", "reference_poc", "colocated_poc", "poc", "false"))
    fine = F.col("error").isNull()
    return rows.select(track, picture, place, F.when(fine, F.coalesce(at, F.lit(0))).cast("bigint").alias("ref0"), F.when(fine, F.lit(0)).cast("bigint").alias("ref1"), *[F.when(fine, F.col(f"__v.{c}")).alias(c) for c in ("x0", "y0", "x1", "y1")], "error")
