"""Looking up code words by prefix: a table of codes against rows of bits, as joins and not as a decoder."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Bits of a code, at most.
LONGEST = 64


def with_code(rows: DataFrame, codes: DataFrame, table: str, bits: str, code: str, value: str) -> DataFrame:
    """rows with value, code_bits and code_error: the value of the one code of the row's table that its bits begin with.

    rows have columns table and bits (a string of 0 and 1), codes have table, code and value. Codes are counted by table and prefix first, so one equi-join a length of code
    finds at most one row of codes, whatever the codes are; a row whose bits no code begins, that several codes begin, or that has a null, has an error and null
    fields. Codes longer than LONGEST raise an error; null and empty codes are left out. Columns of rows with the new names are replaced.
    """
    kept = [c for c in rows.columns if c not in (value, "code_bits", "code_error")]
    usable = codes.where(F.col(table).isNotNull() & (F.length(code) > 0))
    one = usable.groupBy(F.col(table).alias("__table"), F.col(code).alias("__code")).agg(F.count("*").alias("__times"), F.min(value).alias("__value"))
    lengths = sorted(r[0] for r in one.select(F.length("__code")).distinct().limit(LONGEST + 1).collect())  # a few dozen at most
    if lengths and (len(lengths) > LONGEST or lengths[-1] > LONGEST):
        raise ValueError(f"codes of {lengths[-1]} bits, at most {LONGEST}")
    kind = dict(codes.dtypes)[value]
    out = rows.select(*[F.col(f"`{c}`") for c in kept], F.lit(0).cast("bigint").alias("__met"), F.lit(None).cast(kind).alias("__hit"), F.lit(None).cast("int").alias("__bits"))
    for n in lengths:
        of_length = one.where(F.length("__code") == n).select("__table", F.col("__code").alias("__prefix"), "__times", "__value")
        own = F.when(F.length(F.col(f"`{bits}`")) >= n, F.substring(F.col(f"`{bits}`"), 1, n))
        joined = out.join(of_length, (F.col(f"`{table}`") == F.col("__table")) & (own == F.col("__prefix")), "left")
        found = F.col("__times").isNotNull()
        out = joined.select(*[F.col(f"`{c}`") for c in kept], (F.col("__met") + F.coalesce("__times", F.lit(0))).alias("__met"), F.when(found, F.col("__value")).otherwise(F.col("__hit")).alias("__hit"), F.when(found, F.lit(n)).otherwise(F.col("__bits")).alias("__bits"))
    error = F.when(F.col(f"`{table}`").isNull() | F.col(f"`{bits}`").isNull(), "row has a null").when(F.col("__met") == 0, "no code begins the bits").when(F.col("__met") > 1, "several codes begin the bits")
    fine = error.isNull()
    return out.select(*[F.col(f"`{c}`") for c in kept], F.when(fine, F.col("__hit")).alias(value), F.when(fine, F.col("__bits")).alias("code_bits"), error.alias("code_error"))


def prefix_violations(codes: DataFrame, table: str, code: str) -> DataFrame:
    """(table, code, longer): neighbouring codes of a table of which one begins the other, which no table of unique decoding has.

    In sorted order a code stands before the codes that it begins, so if any pair is left, a pair of neighbours is; tables are small by their format.
    """
    following = F.lead(code).over(Window.partitionBy(table).orderBy(code))
    rows = codes.where(F.length(code) > 0).select(table, code).withColumn("longer", following)
    return rows.where(F.col("longer").isNotNull() & F.startswith(F.col("longer"), F.col(code)))
