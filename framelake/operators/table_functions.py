"""Splitting byte streams from SQL: table functions over whole tables, whatever their other columns are, and over single values by lateral join.

    register(spark)
    SELECT * FROM split_annexb(TABLE(streams), 'stream')                     -- the table's other columns, unit_idx, unit, error
    SELECT * FROM split_lengths(TABLE(samples), 'data', 'length_size')
    SELECT s.k, u.* FROM streams s, LATERAL annexb_units_of(s.stream) u

A malformed or null stream is one row with an error and no unit, as in units.split_bytes().
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import BinaryType, IntegerType, LongType, StringType, StructField, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from framelake.operators.parameter_sets import Malformed
from framelake.operators.units import cut_annexb, cut_lengths

MADE = [StructField("unit_idx", LongType()), StructField("unit", BinaryType()), StructField("error", StringType())]


def _units(data: bytes | None, cut: Callable[[bytes], list[bytes]]) -> Iterator[tuple]:
    try:
        if data is None:
            raise Malformed("stream is null")
        found = cut(bytes(data))
    except Malformed as e:
        yield None, None, str(e)
        return
    for k, unit in enumerate(found):
        yield k, unit, None


def _result(table: AnalyzeArgument, *named: AnalyzeArgument) -> AnalyzeResult:
    """The table's columns without the data's, and those of the units; columns are checked when the query is analysed."""
    if not table.isTable:
        raise ValueError("the first argument is a table")
    fields = {f.name: f for f in table.dataType.fields}
    for n, (argument, kind) in enumerate(zip(named, (BinaryType, IntegerType), strict=False)):
        if argument.isTable or not argument.isConstantExpression or argument.value not in fields:
            raise ValueError(f"argument {n + 2} names no column of the table")
        if not isinstance(fields[argument.value].dataType, kind):
            raise ValueError(f"{argument.value} is not {kind.typeName()}")
    taken = {f.name.lower() for f in MADE}
    kept = [f for f in fields.values() if f.name != named[0].value]
    if clash := [f.name for f in kept if f.name.lower() in taken]:
        raise ValueError(f"the table has a column {clash[0]} already")
    return AnalyzeResult(StructType([*kept, *MADE]))


class SplitAnnexb:
    @staticmethod
    def analyze(table: AnalyzeArgument, data: AnalyzeArgument) -> AnalyzeResult:
        return _result(table, data)

    def eval(self, row: Row, data: str) -> Iterator[tuple]:
        kept = [row[c] for c in row.__fields__ if c != data]
        for unit in _units(row[data], cut_annexb):
            yield (*kept, *unit)


class SplitLengths:
    @staticmethod
    def analyze(table: AnalyzeArgument, data: AnalyzeArgument, length_size: AnalyzeArgument) -> AnalyzeResult:
        return _result(table, data, length_size)

    def eval(self, row: Row, data: str, length_size: str) -> Iterator[tuple]:
        kept = [row[c] for c in row.__fields__ if c != data]
        for unit in _units(row[data], lambda d: cut_lengths(d, row[length_size] or 0)):
            yield (*kept, *unit)


class AnnexbUnitsOf:
    def eval(self, data: bytes) -> Iterator[tuple]:
        yield from _units(data, cut_annexb)


class LengthUnitsOf:
    def eval(self, data: bytes, length_size: int) -> Iterator[tuple]:
        yield from _units(data, lambda d: cut_lengths(d, length_size or 0))


def register(spark: SparkSession) -> None:
    """Make the four functions known to SQL in this session."""
    spark.udtf.register("split_annexb", udtf(SplitAnnexb))
    spark.udtf.register("split_lengths", udtf(SplitLengths))
    made = "unit_idx bigint, unit binary, error string"
    spark.udtf.register("annexb_units_of", udtf(AnnexbUnitsOf, returnType=made))
    spark.udtf.register("length_units_of", udtf(LengthUnitsOf, returnType=made))
