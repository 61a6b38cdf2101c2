"""Units of byte streams: splitting at start codes or by lengths, headers, filters, joining; decoder configurations.

Splitting walks bytes in a small helper inside tasks. What is malformed gives a row with an error in place of the stream's units.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelake.operators.parameter_sets import IDR_SLICE, SLICE, Malformed, unit_type
from framelake.sources.storage import bounded_batches, frugal

#: Units, and bytes of them, that go back from a worker at once, about.
BATCH_UNITS, BATCH_BYTES = 4096, 2 << 20

_START = re.compile(b"\0\0\1")


def unit_headers(units: DataFrame, data: str) -> DataFrame:
    """units with the fields of the first byte: forbidden bit, reference importance, type; null for an empty or null unit."""
    byte = F.when(F.octet_length(data) > 0, F.conv(F.hex(F.substring(data, 1, 1)), 16, 10).cast("bigint"))
    return units.withColumn("forbidden", F.shiftright(byte, 7)).withColumn("ref_idc", F.shiftright(byte, 5).bitwiseAND(F.lit(3))).withColumn("nal_type", byte.bitwiseAND(F.lit(31)))


def header_error(forbidden: str = "forbidden", nal_type: str = "nal_type") -> Column:
    """What is wrong with a unit's header fields, null if nothing."""
    return F.when(F.col(nal_type).isNull(), "unit is empty").when(F.col(forbidden) != 0, "forbidden bit is set").when(F.col(nal_type) == 0, "unit type is zero")


def coded_slices(units: DataFrame, nal_type: str = "nal_type") -> DataFrame:
    """The units that hold coded slices."""
    return units.where(F.col(nal_type).isin(SLICE, IDR_SLICE))


def first_slices(units: DataFrame, keys: list[str], order: str = "unit_idx", nal_type: str = "nal_type") -> DataFrame:
    """(keys, order, nal_type): the first coded slice of each sample; samples without one are left out."""
    first = coded_slices(units, nal_type).groupBy(*keys).agg(F.min(F.struct(order, nal_type)).alias("__first"))
    return first.select(*keys, "__first.*")


def cut_annexb(data: bytes) -> list[bytes]:
    """The units between start codes of three or four bytes, zeros at their ends trimmed, empty ones dropped."""
    marks = [(m.start() - (m.start() > 0 and data[m.start() - 1] == 0), m.end()) for m in _START.finditer(data)]
    if not marks:
        raise Malformed("stream has no start code")
    if data[: marks[0][0]].strip(b"\0"):
        raise Malformed("data before the first start code")
    ends = [a for a, _ in marks[1:]] + [len(data)]
    out = [u for (_, a), b in zip(marks, ends, strict=True) if (u := data[a:b].rstrip(b"\0"))]
    if not out:
        raise Malformed("stream has no units")
    for u in out:
        unit_type(u)
    return out


def cut_lengths(data: bytes, length_size: int) -> list[bytes]:
    """The units of a sample, each behind its length in 1, 2 or 4 bytes; an empty sample has none."""
    if length_size not in (1, 2, 4):
        raise Malformed(f"length of {length_size} bytes")
    out, at = [], 0
    while at < len(data):
        n = int.from_bytes(data[at : at + length_size], "big")
        if at + length_size > len(data) or not n or at + length_size + n > len(data):
            raise Malformed("unit is empty or cut short")
        at += length_size
        out.append(data[at : at + n])
        unit_type(out[-1])
        at += n
    return out


def split_bytes(streams: DataFrame, keys: list[str], data: str, length_size: str | None = None) -> DataFrame:
    """(keys, unit_idx, unit, error): the units of each byte stream in start-code form, or with lengths of as many bytes as the column length_size says.

    A malformed stream, and a null one, is one row with an error and no unit. Units are binary.
    """
    kinds = dict(streams.dtypes)
    bounded_batches(streams.sparkSession)
    size = F.col(length_size).cast("int") if length_size else F.lit(0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*[pa.array(c, pa.string()) for c in of_keys], pa.array(places, pa.int64()), pa.array(units, pa.binary()), pa.array(errors, pa.string())], [*keys, "unit_idx", "unit", "error"])

        of_keys, places, units, errors, held = [[] for _ in keys], [], [], [], 0
        for batch in batches:
            columns = [batch.column(k) for k in keys]
            for i in range(batch.num_rows):  # a stream at a time, so that one is there as bytes and units
                d, n = batch.column("__data")[i].as_py(), batch.column("__size")[i].as_py()
                try:
                    if d is None:
                        raise Malformed("stream is null")
                    found: list = cut_lengths(d, n) if length_size else cut_annexb(d)
                    error = None
                except Malformed as e:
                    found, error = [None], str(e)
                key = [c[i].as_py() for c in columns]
                for at in range(0, len(found), BATCH_UNITS):
                    part = found[at : at + BATCH_UNITS]
                    for c, k in zip(of_keys, key, strict=True):
                        c += [k] * len(part)
                    places += range(at, at + len(part)) if error is None else [None]
                    units += part
                    errors += [error] * len(part)
                    held += sum(map(len, part)) if error is None else 0
                    if len(units) >= BATCH_UNITS or held >= BATCH_BYTES:
                        yield made()
                        of_keys, places, units, errors, held = [[] for _ in keys], [], [], [], 0
            del batch, columns
        if units:
            yield made()

    rows = streams.select(*[F.col(k).cast("string").alias(k) for k in keys], F.col(data).alias("__data"), F.coalesce(size, F.lit(0)).alias("__size"))
    out = rows.mapInArrow(frugal(run), ", ".join(f"`{k}` string" for k in keys) + ", unit_idx bigint, unit binary, error string")
    return out.withColumns({k: F.col(k).cast(kinds[k]) for k in keys})


def join_bytes(units: DataFrame, keys: list[str], order: str = "unit_idx", data: str = "unit") -> DataFrame:
    """(keys, units, stream): each stream's units in order, a four-byte start code before each. A stream is one value, so it fits a row."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct(order, data))), lambda u: F.concat(F.lit("00000001"), F.hex(u[data])))
    return units.groupBy(*keys).agg(F.count("*").alias("units"), F.unhex(F.array_join(ordered, "")).alias("stream"))


CONFIG = "profile bigint, compatibility bigint, level bigint, length_size bigint, sequence_sets array<binary>, picture_sets array<binary>, trailing binary"


def read_config(data: bytes) -> tuple:
    """The fields of a decoder configuration record (an avcC box's payload)."""
    if len(data) < 7:
        raise Malformed("configuration is cut short")
    if data[0] != 1:
        raise Malformed(f"configuration of version {data[0]}")
    length, at = (data[4] & 3) + 1, 6
    if length == 3:
        raise Malformed("length of 3 bytes")

    def sets(n: int, at: int) -> tuple[list[bytes], int]:
        out = []
        for _ in range(n):
            size = int.from_bytes(data[at : at + 2], "big")
            if at + 2 > len(data) or not size or at + 2 + size > len(data):
                raise Malformed("parameter set is empty or cut short")
            out.append(data[at + 2 : at + 2 + size])
            at += 2 + size
        return out, at

    sequence, at = sets(data[5] & 31, at)
    if at >= len(data):
        raise Malformed("configuration has no picture sets")
    picture, at = sets(data[at], at + 1)
    return data[1], data[2], data[3], length, sequence, picture, data[at:]


def configurations(rows: DataFrame, keys: list[str], data: str) -> DataFrame:
    """(keys, fields of CONFIG, error) for each avcC payload; a malformed or null one has an error and null fields."""
    from framelake.operators.parameter_sets import _rows

    return _rows(rows.select(*keys, F.col(data).alias("unit")), CONFIG, lambda unit: read_config(unit or b""), keys)


def seeded_sets(configs: DataFrame, track: str) -> DataFrame:
    """(track, sample_idx -1, unit_idx, unit): the sets of each track's configuration, which are in force from its start."""
    every = F.concat(F.coalesce("sequence_sets", F.array().cast("array<binary>")), F.coalesce("picture_sets", F.array().cast("array<binary>")))
    return configs.select(track, F.lit(-1).cast("bigint").alias("sample_idx"), F.posexplode(every).alias("unit_idx", "unit")).withColumn("unit_idx", F.col("unit_idx").cast("bigint"))


def split_units(streams: DataFrame, text: str, start: str, padding: str = " ") -> DataFrame:
    """A row for each unit of text between start marks, trailing padding trimmed and empty units dropped, with unit_idx from 0."""
    parts = F.filter(F.transform(F.split(text, f"\\Q{start}\\E"), lambda u: F.rtrim(u, F.lit(padding))), lambda u: F.length(u) > 0)
    kept = [c for c in streams.columns if c != text]
    return streams.select(*kept, F.posexplode(parts).alias("unit_idx", "unit")).withColumn("unit_idx", F.col("unit_idx").cast("bigint"))


def join_units(units: DataFrame, keys: list[str], start: str) -> DataFrame:
    """(keys, units, stream): each stream's units in order, a start mark before each. A stream is one value, so it fits a row."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("unit_idx", "unit"))), lambda u: F.concat(F.lit(start), u["unit"]))
    return units.groupBy(*keys).agg(F.count("*").alias("units"), F.array_join(ordered, "").alias("stream"))
