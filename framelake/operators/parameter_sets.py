"""Sequence and picture parameter sets and slice headers of H.264 as rows, and which sets are in force at each sample.

A unit's bits are walked by a small helper inside tasks; finding the sets that a slice refers to is joins. A malformed unit is a row
with an error and null fields, never a failed task.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

# Profiles whose sets name a chroma format; unit types; slice types.
HIGH_PROFILES = (44, 83, 86, 100, 110, 118, 122, 128, 134, 135, 138, 139, 144, 244)
SLICE, IDR_SLICE, SPS_UNIT, PPS_UNIT = 1, 5, 7, 8
SLICE_TYPES = ("P", "B", "I", "SP", "SI")

SPS = (
    "sps_id bigint, profile bigint, level bigint, log2_max_frame_num bigint, poc_type bigint, log2_max_poc bigint, max_refs bigint, frame_mbs_only boolean, coded_width bigint, coded_height bigint, width bigint, height bigint"
    ", chroma_format bigint, bit_depth bigint, separate_planes boolean, poc_always_zero boolean"
)
PPS = (
    "pps_id bigint, sps_id bigint, cabac boolean, slice_groups bigint, refs_l0 bigint, refs_l1 bigint, weighted_pred boolean, weighted_bipred bigint, init_qp bigint, init_qs bigint, chroma_qp_offset bigint, deblocking_control boolean, constrained_intra boolean"
    ", bottom_order boolean, redundant_counts boolean"
)
SLICE_HEADER = (
    "first_mb bigint, slice_type string, all_same_type boolean, frame_num bigint, field boolean, bottom boolean, idr_pic_id bigint, poc_lsb bigint, redundant bigint, direct_spatial boolean, active_l0 bigint, active_l1 bigint"
    ", modifications array<struct<list:bigint,idc:bigint,value:bigint>>, luma_denominator bigint, chroma_denominator bigint, weights array<struct<list:bigint,entry:bigint,luma:bigint,luma_offset:bigint,cb:bigint,cb_offset:bigint,cr:bigint,cr_offset:bigint>>"
    ", long_term boolean, adaptive_marking boolean, marking array<struct<operation:bigint,first:bigint,second:bigint>>, cabac_init bigint, qp bigint, qs bigint, deblocking_off bigint, alpha_offset bigint, beta_offset bigint, header_bits bigint, has_data boolean"
)


class Malformed(ValueError):
    """What a unit breaks."""


def unescaped(body: bytes) -> bytes:
    """body without its emulation-prevention bytes; one at the end or before a byte above 3 is malformed."""
    if b"\0\0\3" not in body:
        return body
    out, at = [], 0
    for m in re.finditer(b"\0\0\3", body):
        if m.end() == len(body) or body[m.end()] > 3:
            raise Malformed("invalid emulation-prevention byte")
        out.append(body[at : m.end() - 1])
        at = m.end()
    return b"".join(out) + body[at:]


class Bits:
    """A cursor over a unit's body; reading past its end is malformed."""

    def __init__(self, unit: bytes):
        self.body = unescaped(unit[1:])
        self.at, self.end = 0, 8 * len(self.body)

    def u(self, n: int) -> int:
        if self.at + n > self.end:
            raise Malformed("unit is cut short")
        last = self.at + n
        part = int.from_bytes(self.body[self.at >> 3 : (last + 7) >> 3], "big")
        self.at = last
        return part >> (-last % 8) & ((1 << n) - 1)

    def flag(self) -> bool:
        at = self.at
        if at >= self.end:
            raise Malformed("unit is cut short")
        self.at = at + 1
        return bool(self.body[at >> 3] >> (7 - (at & 7)) & 1)

    def ue(self, most: int | None = None, what: str = "value") -> int:
        # the longest code is 127 bits, so a whole one is in 17 bytes if the body has it
        at = self.at
        part = self.body[at >> 3 : (at >> 3) + 17]
        size = 8 * len(part) - (at & 7)
        left = int.from_bytes(part, "big") & ((1 << size) - 1) if size > 0 else 0
        n = size - left.bit_length()
        if n > 63:
            raise Malformed("code is too long")
        if 2 * n >= size:
            raise Malformed("unit is cut short")
        self.at = at + 2 * n + 1
        value = (left >> (size - 2 * n - 1)) - 1
        if most is not None and value > most:
            raise Malformed(f"{what} is out of range")
        return value

    def se(self, low: int | None = None, high: int | None = None, what: str = "value") -> int:
        k = self.ue()
        value = (k + 1) // 2 if k % 2 else -(k // 2)
        if low is not None and not low <= value <= high:
            raise Malformed(f"{what} is out of range")
        return value

    def more(self) -> bool:
        """Whether anything but the closing 1 and zeros is left."""
        left = self.end - self.at
        if left <= 0:
            return False
        rest = int.from_bytes(self.body[self.at >> 3 :], "big") & ((1 << left) - 1)
        return rest != 1 << (left - 1)


def unit_type(unit: bytes | None) -> int:
    """The type of a whole unit; an empty one, one with the forbidden bit and one of type 0 are malformed."""
    if not unit:
        raise Malformed("unit is empty")
    if unit[0] & 0x80:
        raise Malformed("forbidden bit is set")
    if not unit[0] & 31:
        raise Malformed("unit type is zero")
    return unit[0] & 31


def _reader(unit: bytes, *types: int) -> Bits:
    if unit_type(unit) not in types:
        raise Malformed(f"unit of type {unit[0] & 31}")
    return Bits(unit)


def _skip_scaling_list(r: Bits, size: int) -> None:
    last = following = 8
    for _ in range(size):
        if following:
            following = (last + r.se()) % 256
        last = following or last


def read_sps(unit: bytes) -> tuple:
    r = _reader(unit, SPS_UNIT)
    profile, _, level, ident = r.u(8), r.u(8), r.u(8), r.ue()
    chroma, planes, depth = 1, False, 8
    if profile in HIGH_PROFILES:
        chroma = r.ue(3, "chroma format")
        planes = chroma == 3 and r.flag()
        depth = 8 + r.ue(6, "luma depth")
        r.ue(6, "chroma depth"), r.u(1)
        if r.flag():
            for k in range(12 if chroma == 3 else 8):
                if r.flag():
                    _skip_scaling_list(r, 16 if k < 6 else 64)
    frame_num, poc_type, poc, always_zero = r.ue(12, "frame number length") + 4, r.ue(2, "picture order type"), 0, False
    if poc_type == 0:
        poc = r.ue(12, "picture order length") + 4
    elif poc_type == 1:
        always_zero = r.flag()
        r.se(), r.se()
        for _ in range(r.ue(255, "picture order cycle")):
            r.se()
    refs, _, across, down, frames = r.ue(), r.u(1), r.ue() + 1, r.ue() + 1, r.flag()
    if not frames:
        r.u(1)
    r.u(1)
    left = right = top = bottom = 0
    if r.flag():
        left, right, top, bottom = r.ue(), r.ue(), r.ue(), r.ue()
    unit_x = 2 if chroma in (1, 2) and not planes else 1
    unit_y = (2 if chroma == 1 and not planes else 1) * (1 if frames else 2)
    w, h = across * 16, down * 16 * (1 if frames else 2)
    across, down = unit_x * (left + right), unit_y * (top + bottom)
    if across >= w or down >= h:
        raise Malformed("crop exceeds the picture")
    return ident, profile, level, frame_num, poc_type, poc, refs, frames, w, h, w - across, h - down, chroma, depth, planes, always_zero


def _skip_slice_groups(r: Bits, groups: int) -> None:
    kind = r.ue(6, "slice group map")
    if kind == 0:
        for _ in range(groups):
            r.ue()
    elif kind == 2:
        for _ in range(2 * (groups - 1)):
            r.ue()
    elif kind in (3, 4, 5):
        r.u(1), r.ue()
    elif kind == 6:
        bits = (groups - 1).bit_length()
        for _ in range(r.ue(1 << 28, "slice group map size") + 1):
            if r.u(bits) >= groups:
                raise Malformed("slice group is out of range")


def read_pps(unit: bytes) -> tuple:
    r = _reader(unit, PPS_UNIT)
    ident, sps, cabac, bottom, groups = r.ue(), r.ue(), r.flag(), r.flag(), r.ue(7, "slice groups") + 1
    if groups > 1:
        _skip_slice_groups(r, groups)
    l0, l1, weighted, bipred = r.ue(31, "references") + 1, r.ue(31, "references") + 1, r.flag(), r.u(2)
    qp, qs, offset = 26 + r.se(-26, 25, "quantiser"), 26 + r.se(-26, 25, "quantiser"), r.se(-12, 12, "chroma offset")
    deblock, intra, redundant = r.flag(), r.flag(), r.flag()
    return ident, sps, cabac, groups, l0, l1, weighted, bipred, qp, qs, offset, deblock, intra, bottom, redundant


def read_slice_start(unit: bytes) -> tuple:
    """(first_mb, slice type as coded, pps_id): what a slice says before its sets are known."""
    r = _reader(unit, SLICE, IDR_SLICE)
    return r.ue(), r.ue(9, "slice type"), r.ue()


def read_slice(unit: bytes, pps: dict, sps: dict) -> tuple:
    """The fields of SLICE_HEADER, given the sets that the slice refers to, as dicts of their columns. has_data says whether anything but the closing bits is behind the header."""
    r = _reader(unit, SLICE, IDR_SLICE)
    idr, is_reference = unit[0] & 31 == IDR_SLICE, unit[0] >> 5 & 3 != 0
    first, coded, _ = r.ue(), r.ue(9, "slice type"), r.ue()
    kind = SLICE_TYPES[coded % 5]
    inter, lists = kind in ("P", "SP", "B"), 2 if kind == "B" else 1
    if pps["slice_groups"] > 1:
        raise Malformed("several slice groups are not supported")
    if sps["separate_planes"]:
        r.u(2)
    frame_num = r.u(sps["log2_max_frame_num"])
    field = not sps["frame_mbs_only"] and r.flag()
    bottom = field and r.flag()
    idr_pic = r.ue() if idr else 0
    poc = 0
    if sps["poc_type"] == 0:
        poc = r.u(sps["log2_max_poc"])
    if sps["poc_type"] == 1 and not sps["poc_always_zero"]:
        r.se()
    if (sps["poc_type"] == 0 or (sps["poc_type"] == 1 and not sps["poc_always_zero"])) and pps["bottom_order"] and not field:
        r.se()
    redundant = r.ue() if pps["redundant_counts"] else 0
    direct = kind == "B" and r.flag()
    active = [pps["refs_l0"], pps["refs_l1"]]
    if inter and r.flag():
        for k in range(lists):
            active[k] = r.ue(31, "references") + 1
    modifications = []
    for k in range(lists if inter else 0):
        if r.flag():
            while (idc := r.ue(3, "list modification")) != 3:
                modifications.append({"list": k, "idc": idc, "value": r.ue()})
    weights, luma, chroma = [], 0, 0
    if (pps["weighted_pred"] and kind in ("P", "SP")) or (pps["weighted_bipred"] == 1 and kind == "B"):
        coloured = sps["chroma_format"] != 0 and not sps["separate_planes"]
        luma = r.ue(7, "weight denominator")
        chroma = r.ue(7, "weight denominator") if coloured else 0
        for k in range(lists):
            for i in range(active[k]):
                y = (r.se(), r.se()) if r.flag() else (1 << luma, 0)
                c = (r.se(), r.se(), r.se(), r.se()) if coloured and r.flag() else (1 << chroma, 0) * 2 if coloured else (0, 0, 0, 0)
                weights.append(dict(zip(("list", "entry", "luma", "luma_offset", "cb", "cb_offset", "cr", "cr_offset"), (k, i, *y, *c), strict=True)))
    long_term, adaptive, marking = False, False, []
    if is_reference and idr:
        r.u(1)
        long_term = r.flag()
    elif is_reference:
        adaptive = r.flag()
        while adaptive and (op := r.ue(6, "memory operation")):
            marking.append({"operation": op, "first": r.ue() if op != 5 else 0, "second": r.ue() if op == 3 else 0})
    cabac = r.ue(2, "entropy table") if pps["cabac"] and kind not in ("I", "SI") else 0
    qp = pps["init_qp"] + r.se()
    if not -6 * (sps["bit_depth"] - 8) <= qp <= 51:
        raise Malformed("quantiser is out of range")
    qs = 0
    if kind in ("SP", "SI"):
        if kind == "SP":
            r.u(1)
        qs = pps["init_qs"] + r.se()
        if not 0 <= qs <= 51:
            raise Malformed("quantiser is out of range")
    off, alpha, beta = 0, 0, 0
    if pps["deblocking_control"]:
        off = r.ue(2, "filter switch")
        if off != 1:
            alpha, beta = 2 * r.se(-6, 6, "filter offset"), 2 * r.se(-6, 6, "filter offset")
    return first, kind, coded >= 5, frame_num, field, bottom, idr_pic, poc, redundant, direct, *active, modifications, luma, chroma, weights, long_term, adaptive, marking, cabac, qp, qs, off, alpha, beta, r.at, r.more()


def _names(fields: str) -> list[str]:
    """Names of top-level fields of a schema."""
    return [f.split()[0] for f in re.sub(r"<[^<>]*(<[^<>]*>)?[^<>]*>", "", fields).split(", ")]


def _rows(df: DataFrame, fields: str, read: Callable[..., tuple], carried: list[str]) -> DataFrame:
    """df's carried columns, the fields that read() gives for each row's other columns (in their order), and the error, if any."""
    names, kinds = _names(fields), dict(df.dtypes)
    given = [c for c in df.columns if c not in carried]
    made_types = to_arrow_schema(StructType.fromDDL(f"{fields}, error string")).types

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = _read_rows(read, zip(*[batch.column(c).to_pylist() for c in given], strict=True), len(names))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in carried], *_columns(made, made_types)], [*carried, *names, "error"])

    keys = ", ".join(f"`{c}` {kinds[c]}" for c in carried)
    return df.mapInArrow(run, f"{keys}, {fields}, error string")


def _read_rows(read: Callable[..., tuple], rows: Iterable[tuple], n: int) -> list[tuple]:
    """The n fields that read() gives for each row and a null, or n nulls and the error."""
    made = []
    for row in rows:
        try:
            made.append((*read(*row), None))
        except Malformed as e:
            made.append((*[None] * n, str(e)))
    return made


def _columns(rows: list[tuple], types: list[pa.DataType]) -> list[pa.Array]:
    return [pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [()] * len(types), types, strict=True)]


def parsed(units: DataFrame, key: str | list[str], data: str, kind: str) -> DataFrame:
    """(key, fields of the set, error) for units of one kind: 'sps', 'pps' or 'start' (a slice's first fields).

    A malformed, empty or null unit, or one of another kind, has an error and null fields.
    """
    keys = [key] if isinstance(key, str) else key
    read, fields = {"sps": (read_sps, SPS), "pps": (read_pps, PPS), "start": (read_slice_start, "first_mb bigint, coded_type bigint, pps_id bigint")}[kind]
    return _rows(units.select(*keys, F.col(data).alias("unit")), fields, lambda unit: read(unit or b""), keys)


def unsupported(error: str = "error") -> Column:
    """Why pictures of a parsed sequence set can't be reconstructed by a progressive 8-bit 4:2:0 decoder: its error, or what it asks for; null if nothing."""
    return F.when(F.col(error).isNotNull(), F.col(error)).when(~F.col("frame_mbs_only"), "interlaced").when(F.col("chroma_format") != 1, "chroma format").when(F.col("bit_depth") != 8, "bit depth")


def orphans(pps: DataFrame, sps: DataFrame, keys: list[str]) -> DataFrame:
    """Picture sets whose sequence set is not there."""
    return pps.join(sps, [*keys, "sps_id"], "left_anti")


def in_force(slices: DataFrame, sets: DataFrame, track: str, ident: str) -> DataFrame:
    """slices (track, sample_idx, ident, ...) with set, the sample whose set of that id is in force: the newest at or before the slice's own sample.

    All sets of a sample apply before its slices, whatever their order; sets of a file's configuration stand at sample -1. One
    ordered scan over sets and slices together (slices last in a sample), in tracks of (track, id).
    """
    from framelake.operators.scan import latest, scan
    from framelake.operators.timeline import by_index

    marks = sets.select(track, "sample_idx", ident).distinct().withColumns({"__late": F.lit(0), "__set": F.col("sample_idx")})
    both = slices.withColumn("__late", F.lit(1)).unionByName(marks, allowMissingColumns=True)
    placed = scan(both, [track, ident], ["sample_idx", "__late"], by_index("sample_idx"), set=latest(F.col("__set")))
    return placed.where("__late = 1").drop("__late", "__set")


def last_of_sample(sets: DataFrame, track: str, ident: str, order: str) -> DataFrame:
    """Of several sets with one id in a sample, the last."""
    w = Window.partitionBy(track, "sample_idx", ident).orderBy(F.desc(order))
    return sets.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def parsed_units(units: DataFrame, keys: list[str], data: str) -> DataFrame:
    """(keys, kind, pps_id, sps_id, set, error) for each set and coded slice among units, in one pass: a set's ids and bytes, or the id of the picture set that a slice names.

    kind is the unit's type. A malformed unit has an error in place of ids and bytes; units of other types are left out.
    """
    kind = F.conv(F.hex(F.substring(data, 1, 1)), 16, 10).cast("int").bitwiseAND(F.lit(31))
    rows = units.select(*keys, F.col(data).alias("unit"), kind.alias("kind")).where(f"kind IN ({SLICE}, {IDR_SLICE}, {SPS_UNIT}, {PPS_UNIT})")

    def read(unit: bytes, kind: int) -> tuple:
        if kind == SPS_UNIT:
            return None, read_sps(unit)[0], unit
        if kind == PPS_UNIT:
            return *read_pps(unit)[:2], unit
        return read_slice_start(unit)[2], None, None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = _read_rows(read, zip(batch.column("unit").to_pylist(), batch.column("kind").to_pylist(), strict=True), 3)
            found = _columns(made, [pa.int64(), pa.int64(), pa.binary(), pa.string()])
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in keys], batch.column("kind"), *found], [*keys, "kind", "pps_id", "sps_id", "set", "error"])

    types = dict(units.dtypes)
    return rows.mapInArrow(run, ", ".join(f"`{k}` {types[k]}" for k in keys) + ", kind int, pps_id bigint, sps_id bigint, set binary, error string")


@functools.lru_cache(maxsize=4096)
def _set_fields(unit: bytes) -> dict:
    """The fields of a well-formed set."""
    names, read = (_names(SPS), read_sps) if unit_type(unit) == SPS_UNIT else (_names(PPS), read_pps)
    return dict(zip(names, read(unit), strict=True))


def slice_headers(units: DataFrame, track: str = "track", order: str = "unit_idx", data: str = "unit") -> DataFrame:
    """(track, sample_idx, order, pps_id, sps_id, header fields, error) for each coded slice (types 1 and 5) among units.

    units are rows (track, sample_idx, order, data), best stored, as they are read twice; sets of a file's configuration stand at sample -1. A slice's picture set, and that
    set's sequence set, are those in force at the slice's sample (the last of several with one id); where one is not there, or a unit is malformed, the row has an error. Other units are left out.
    The sets' bytes are carried along one ordered scan for either kind, and meet the slices' bytes in one join at the end; a worker reads a set once for many slices.
    """
    from framelake.operators.scan import latest, scan
    from framelake.operators.timeline import by_index
    from framelake.sources.storage import stored

    keys = [track, "sample_idx", order]
    is_slice = F.col("kind").isin(SLICE, IDR_SLICE)
    found = stored(parsed_units(units, keys, data), "parsed").withColumn("late", is_slice.cast("int"))
    chunk = by_index("sample_idx")
    ordered = ["sample_idx", "late", order]
    # what is malformed passes by: a bad set changes nothing, a bad slice has its error
    pps = found.where(is_slice | ((F.col("kind") == PPS_UNIT) & F.col("error").isNull()))
    first = scan(pps, [track, "pps_id"], ordered, chunk, held=latest(F.when(~is_slice, F.struct("sps_id", "set")))).where("late = 1")
    first = first.select(*keys, "late", "pps_id", F.col("held.sps_id").alias("sps_id"), F.col("held.set").alias("pps"), F.lit(None).cast("binary").alias("set"), "error")
    sps = found.where((F.col("kind") == SPS_UNIT) & F.col("error").isNull()).select(*keys, "late", "pps_id", "sps_id", F.lit(None).cast("binary").alias("pps"), "set", "error")
    second = scan(stored(first, "slices").unionByName(sps), [track, "sps_id"], ordered, chunk, held=latest(F.col("set"))).where("late = 1")
    lacking = F.coalesce("error", F.when(F.col("pps").isNull(), "picture set is missing"), F.when(F.col("held").isNull(), "sequence set is missing"))
    kept = second.select(*keys, "pps_id", "sps_id", "pps", F.col("held").alias("sps"), lacking.alias("lacking"))
    bytes_of = units.select(*[F.col(k).alias(f"__{i}") for i, k in enumerate(keys)], F.col(data).alias("unit"))
    same = [F.col(k).eqNullSafe(F.col(f"__{i}")) for i, k in enumerate(keys)]
    whole = kept.join(bytes_of, same).drop(*[f"__{i}" for i in range(len(keys))])
    fields = StructType.fromDDL(f"{SLICE_HEADER}, error string")
    made_types, names = to_arrow_schema(fields).types, _names(SLICE_HEADER)
    carried = [*keys, "pps_id", "sps_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def read(unit: bytes, pps: bytes, sps: bytes, lacking: str | None) -> tuple:
            if lacking is not None:
                raise Malformed(lacking)
            return read_slice(unit, _set_fields(pps), _set_fields(sps))

        for batch in batches:
            rows = zip(*[batch.column(c).to_pylist() for c in ("unit", "pps", "sps", "lacking")], strict=True)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in carried], *_columns(_read_rows(read, rows, len(names)), made_types)], [*carried, *names, "error"])

    types = dict(kept.dtypes)
    return whole.mapInArrow(run, ", ".join(f"`{c}` {types[c]}" for c in carried) + f", {SLICE_HEADER}, error string")
