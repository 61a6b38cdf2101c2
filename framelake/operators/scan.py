"""Ordered scans over tracks that may be of any length.

A plain window over a track puts the whole track in one task. scan() takes a chunk column that never
falls along the order (a day of the time stamp, a stretch of the index), works inside (track,
chunk), and carries one row a chunk from each chunk to the next, so that a track with a third of all
rows is spread like any other rows. All columns that go by one order come from one pass: the input is
shuffled once, and read once more for a row a chunk, which is combined on the map side. The input is thus
planned twice, so store it (sources.storage.stored) where it is itself the result of a scan.

Rows whose track key or order value is null are kept: nulls are a key like any other, and come first in an order.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Carried:
    """A column of a scan. value is what it reads; local its value inside a chunk, from (value, window in order);
    chunk what a chunk sends on, from (value, order as a struct); carry what a chunk gets, from (what chunks sent, window over chunks);
    out the result, from (local, carried)."""

    value: Column
    local: Callable[[Column, WindowSpec], Column]
    chunk: Callable[[Column, Column], Column]
    carry: Callable[[Column, WindowSpec], Column]
    out: Callable[[Column, Column], Column]


def _before(w: WindowSpec) -> WindowSpec:
    return w.rowsBetween(Window.unboundedPreceding, -1)


def _so_far(w: WindowSpec) -> WindowSpec:
    return w.rowsBetween(Window.unboundedPreceding, Window.currentRow)


def prefix(value: Column) -> Carried:
    """The sum over the rows before, 0 first; a null counts as 0."""
    zero = F.lit(0).cast("bigint")
    return Carried(
        value.cast("bigint"),
        lambda v, w: F.coalesce(F.sum(v).over(_before(w)), zero),
        lambda v, _: F.sum(v),
        lambda v, w: F.coalesce(F.sum(v).over(_before(w)), zero),
        lambda own, carried: (own + carried).cast("bigint"),
    )


def index() -> Carried:
    """The number of rows before."""
    return prefix(F.lit(1))


def running_max(value: Column) -> Carried:
    """The largest value up to and including the row."""
    return Carried(value, lambda v, w: F.max(v).over(_so_far(w)), lambda v, _: F.max(v), lambda v, w: F.max(v).over(_before(w)), lambda own, carried: F.greatest(own, carried))


def latest(value: Column) -> Carried:
    """The latest value at or before the row that is not null: a step function, or a set of parameters in force."""
    return Carried(
        value,
        lambda v, w: F.last(v, ignorenulls=True).over(_so_far(w)),
        lambda v, order: F.max_by(v, F.when(v.isNotNull(), order)),
        lambda v, w: F.last(v, ignorenulls=True).over(_before(w)),
        lambda own, carried: F.coalesce(own, carried),
    )


def following(value: Column) -> Carried:
    """The next row's value, null at the end of the track."""
    return Carried(
        value,
        lambda v, w: F.struct(F.lead(v).over(w).alias("v"), F.lead(F.lit(1)).over(w).isNull().alias("end")),
        lambda v, order: F.min_by(v, order),
        lambda v, w: F.lead(v).over(w),
        lambda own, carried: F.when(own["end"], carried).otherwise(own["v"]),
    )


def preceding(value: Column) -> Carried:
    """The row before's value, null at the start of the track."""
    return Carried(
        value,
        lambda v, w: F.struct(F.lag(v).over(w).alias("v"), F.lag(F.lit(1)).over(w).isNull().alias("start")),
        lambda v, order: F.max_by(v, order),
        lambda v, w: F.lag(v).over(w),
        lambda own, carried: F.when(own["start"], carried).otherwise(own["v"]),
    )


def _zero(kind: T.DataType) -> Column:
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.lit("").cast(kind)
    return (F.lit("1970-01-01") if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)) else F.lit(0)).cast(kind)


def scan(df: DataFrame, keys: list[str], order: list[str], chunk: Column, **columns: Carried) -> DataFrame:
    """df with the columns, each along order inside the tracks that keys name; columns of those names are replaced.

    An empty df gives an empty result; rows that are equal in order are taken in any order.
    """
    kept = [F.col(f"`{c}`") for c in df.columns if c not in columns]
    ready = df.withColumns({"__chunk": chunk} | {f"__v_{n}": c.value for n, c in columns.items()})
    # keys for an equi-join that has nulls as values: what is null, and a value where it is
    parts = [*keys, "__chunk"]
    kinds = {f.name: f.dataType for f in ready.schema.fields}
    ready = ready.withColumns({f"__n_{i}": F.col(f"`{k}`").isNull() for i, k in enumerate(parts)} | {f"__k_{i}": F.coalesce(F.col(f"`{k}`"), _zero(kinds[k])) for i, k in enumerate(parts)})
    at = [f"__{x}_{i}" for x in "nk" for i in range(len(parts))]
    inside = Window.partitionBy(*at).orderBy(*order)
    across = Window.partitionBy(*[f"__{x}_{i}" for x in "nk" for i in range(len(keys))]).orderBy(F.desc(f"__n_{len(keys)}"), f"__k_{len(keys)}")
    chunks = ready.groupBy(*at).agg(*[c.chunk(F.col(f"__v_{n}"), F.struct(*order)).alias(f"__s_{n}") for n, c in columns.items()])
    chunks = chunks.select(*at, *[c.carry(F.col(f"__s_{n}"), across).alias(f"__c_{n}") for n, c in columns.items()])
    local = ready.withColumns({f"__l_{n}": c.local(F.col(f"__v_{n}"), inside) for n, c in columns.items()})
    return local.join(chunks, at).select(*kept, *[c.out(F.col(f"__l_{n}"), F.col(f"__c_{n}")).alias(n) for n, c in columns.items()])
