"""MP4 containers as tables: boxes, tracks, samples and units of files that Spark has read, and files made from samples.

Only the box scan and the unit split are Python loops, small ones over bytes; tables inside boxes are
decoded by the column, run lengths are expanded and brought together as rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.operators import timeline as T
from framelake.operators import units as U
from framelake.sources.storage import bounded_batches, frugal

# Boxes that hold boxes, and sample entry formats of video.
CONTAINERS = ("moov", "trak", "mdia", "minf", "stbl")
VIDEO_FORMATS = ("avc1", "avc3", "hvc1", "hev1", "vp09", "av01")
# Boxes whose bytes are no metadata.
MEDIA = ("mdat", "free", "skip")

BOXES = "path string, trak int, box_path string, depth int, ord int, type string, offset bigint, size bigint, header_size int, payload binary, error string"


def header_error(left: int, size: int, head: int) -> str | None:
    """What is wrong with a box of size bytes, head of them its header, where left bytes are left."""
    return "box is cut short" if left < 8 or size == 1 else "box is smaller than its header" if size < head else "box runs past its parent" if size > left else None


def scan_boxes(data: bytes, start: int, end: int, depth: int, parent: str, trak: int) -> Iterator[tuple]:
    """Rows of the boxes from start to end and of those inside; a malformed box gives an error row and ends its level."""
    at, order, traks = start, 0, 0
    while at < end:
        size, head = int.from_bytes(data[at : at + 4], "big"), 8
        kind = data[at + 4 : at + 8].decode("latin-1")
        if end - at >= 16 and size == 1:
            size, head = int.from_bytes(data[at + 8 : at + 16], "big"), 16
        elif size == 0:
            size = end - at
        bad = header_error(end - at, size, head)
        if bad:
            yield (trak, f"{parent}/{kind}", depth, order, kind, at, size, head, None, bad)
            return
        own = traks if kind == "trak" else trak
        traks += kind == "trak"
        inner = kind in CONTAINERS
        yield (own, f"{parent}/{kind}", depth, order, kind, at, size, head, None if inner or kind in MEDIA else data[at + head : at + size], None)
        if inner:
            yield from scan_boxes(data, at + head, at + size, depth + 1, f"{parent}/{kind}", own)
        at, order = at + size, order + 1


_NULL = (-1, "", 0, 0, "", 0, 0, 0, None, "content is null")


def read_files(spark: SparkSession, pattern: str) -> DataFrame:
    """(path, content) of the files that a path or pattern names."""
    return spark.read.format("binaryFile").load(pattern).select("path", "content")


def boxes(files: DataFrame) -> DataFrame:
    """A row for each box of files (path, content); payload is there for metadata boxes, not for media bytes. A file of null content is an error row, an empty one has no rows."""

    names = [f.split()[0] for f in BOXES.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for batch in batches:
            for i in range(batch.num_rows):  # a file at a time
                path, content = batch.column("path")[i].as_py(), batch.column("content")[i].as_py()
                for r in [_NULL] if content is None else scan_boxes(content, 0, len(content), 0, "", -1):
                    rows.append((path, *r))
                    held += len(r[8] or b"") + ROW_BYTES
                    if held >= BATCH_BYTES:
                        yield _batch(rows, names)
                        rows, held = [], 0
            del batch
        if rows:
            yield _batch(rows, names)

    bounded_batches(files.sparkSession)
    return files.select("path", "content").mapInArrow(frugal(run), BOXES)


_BOX_TYPES = {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary()}
#: Bytes of boxes that go back from a worker at once, about; those of a row beside its payload.
BATCH_BYTES, ROW_BYTES = 2 << 20, 200


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    kinds = [_BOX_TYPES[f.split()[1]] for f in BOXES.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def number(data: str, at: str | int, width: int) -> str:
    """SQL: the unsigned big-endian number of width bytes at byte `at` (from 0) of data."""
    return f"CAST(conv(hex(substring({data}, CAST({at} + 1 AS INT), {width})), 16, 10) AS DECIMAL(20,0))"


def long(data: str, at: str | int, width: int = 4) -> str:
    return f"CAST({number(data, at, width)} AS BIGINT)"


def _entries(payload: str, width: int, fields: list[tuple[str, int, int]]) -> Column:
    """A table box's rows as an array of structs; null for a count that the payload's length contradicts (track_error() says so)."""
    count = long(payload, 4)
    made = ", ".join(f"'{name}', {long(payload, f'8 + i * {width} + {at}', n)}" for name, at, n in fields)
    rows = f"transform(CASE WHEN {count} = 0 THEN CAST(array() AS ARRAY<BIGINT>) ELSE sequence(0L, {count} - 1) END, i -> named_struct({made}))"
    return F.expr(f"CASE WHEN length({payload}) >= 8 AND length({payload}) = 8 + {count} * {width} THEN {rows} END")


def brands(found: DataFrame) -> DataFrame:
    """(path, major, minor, compatible, error) from each file's first ftyp box; files without one are left out."""
    f = found.where("type = 'ftyp' AND depth = 0").groupBy("path").agg(F.min_by(F.struct("payload", "error"), "offset").alias("b")).select("path", "b.*")
    bad = F.coalesce("error", F.when((F.length("payload") < 8) | (F.length("payload") % 4 != 0), "ftyp box has a wrong length"))
    f = f.withColumn("error", bad)
    name = lambda at: f"decode(substring(payload, {at}, 4), 'ISO-8859-1')"
    rest = f"CASE WHEN length(payload) = 8 THEN CAST(array() AS ARRAY<STRING>) ELSE transform(sequence(0, CAST(length(payload) / 4 AS INT) - 3), i -> {name('9 + i * 4')}) END"
    whole = lambda e: F.when(F.col("error").isNull(), F.expr(e))
    return f.select("path", whole(name("1")).alias("major"), whole(long("payload", 4)).alias("minor"), whole(rest).alias("compatible"), "error")


def tracks(found: DataFrame) -> DataFrame:
    """One row a track: ids, handler, timescales, durations, size, sample entry and the payloads of its sample tables; track_error() says what is wrong with it."""
    wanted = ["tkhd", "mdhd", "hdlr", "stsd", "stts", "ctts", "stsc", "stsz", "stco", "co64", "stss"]
    t = found.where(F.col("error").isNull() & (F.col("trak") >= 0)).groupBy("path", "trak").agg(
        *[F.min_by("payload", F.when(F.col("type") == k, F.col("offset"))).alias(k) for k in wanted], *[F.coalesce(F.bool_or(F.col("type") == k), F.lit(False)).alias(f"has_{k}") for k in ("minf", "stbl")]
    )
    movie = found.where("type = 'mvhd' AND error IS NULL").groupBy("path").agg(F.max_by("payload", "offset").alias("mvhd"))

    def timed(box: str, at: int) -> tuple[str, str]:
        v1 = f"hex(substring({box}, 1, 1)) = '01'"
        return f"CASE WHEN {v1} THEN {long(box, at + 8)} ELSE {long(box, at)} END", f"CASE WHEN {v1} THEN {long(box, at + 12, 8)} ELSE {long(box, at + 4)} END"

    movie_scale, movie_length = timed("mvhd", 12)
    scale, length = timed("mdhd", 12)
    n = "length(tkhd)"
    return t.join(movie, "path", "left").selectExpr(
        "path",
        "trak",
        f"CASE WHEN hex(substring(tkhd, 1, 1)) = '01' THEN {long('tkhd', 20)} ELSE {long('tkhd', 12)} END AS track_id",
        "decode(substring(hdlr, 9, 4), 'ISO-8859-1') AS handler",
        f"{movie_scale} AS movie_timescale",
        f"{movie_length} AS movie_duration",
        f"{scale} AS timescale",
        f"{length} AS duration",
        f"shiftright({long('tkhd', f'{n} - 8')}, 16) AS width",
        f"shiftright({long('tkhd', f'{n} - 4')}, 16) AS height",
        f"{long('stsd', 4)} AS entries",
        "decode(substring(stsd, 13, 4), 'ISO-8859-1') AS format",
        *["tkhd", "stts", "ctts", "stsc", "stsz", "stco", "co64", "stss", "stsd", "mvhd", "mdhd", "hdlr", "has_minf", "has_stbl"],
    )


DESCRIPTIONS = "path string, trak int, description_index bigint, format string, visual boolean, width bigint, height bigint, config_type string, config binary, error string"
# Boxes that configure a decoder.
CONFIGS = ("avcC", "hvcC", "vpcC", "av1C")


def _described(data: bytes | None) -> Iterator[tuple]:
    """The sample entries of a stsd payload: a visual one has 78 bytes, with its size, before its own boxes."""
    if data is None:
        return
    if len(data) < 8:
        yield (None, None, None, None, None, None, None, "stsd box has a wrong length")
        return
    found = [r for r in scan_boxes(data, 8, len(data), 0, "", -1)]
    bad = next((r[-1] for r in found if r[-1]), None) or ("stsd box counts its entries wrongly" if len(found) != int.from_bytes(data[4:8], "big") else None)
    if bad:
        yield (None, None, None, None, None, None, None, bad)
        return
    for k, (_, _, _, _, kind, at, size, head, *_) in enumerate(found):
        body = data[at + head : at + size]
        if kind not in VIDEO_FORMATS:
            yield (k + 1, kind, False, None, None, None, None, None)
        elif len(body) < 78:
            yield (k + 1, kind, True, None, None, None, None, "sample entry is cut short")
        else:
            inner = list(scan_boxes(body, 78, len(body), 0, "", -1))
            bad = next((r[-1] for r in inner if r[-1]), None)
            config = next(((r[4], body[r[5] + r[7] : r[5] + r[6]]) for r in inner if r[4] in CONFIGS), (None, None))
            yield (k + 1, kind, True, int.from_bytes(body[24:26], "big"), int.from_bytes(body[26:28], "big"), *config, bad)


def descriptions(t: DataFrame) -> DataFrame:
    """A row for each sample entry of tracks(): its place from 1, format, size and decoder configuration. A malformed stsd is a row with an error; a track without one has no rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(p, k, *r) for p, k, d in batch.itertuples(index=False) for r in _described(None if d is None else bytes(d))]
            yield pd.DataFrame(rows, columns=[f.split()[0] for f in DESCRIPTIONS.split(", ")], dtype=object)

    return t.select("path", "trak", "stsd").mapInPandas(run, DESCRIPTIONS)


def track_error() -> Column:
    """What is wrong with a row of tracks(), null if nothing: the checks of headers and sample tables beyond their lengths."""
    size = lambda k: F.length(k)
    v1 = F.expr("hex(substring(tkhd, 1, 1)) = '01'")

    def header(k: str, what: str) -> Column:
        version = long(k, 0, 1)
        return F.expr(f"{k} IS NOT NULL AND " + (f"length({k}) < CASE WHEN {version} = 1 THEN 32 ELSE 20 END" if what == "cut" else f"{version} > 1"))

    head = (
        F.when(F.col("tkhd").isNull(), "track has no header")
        .when(size("tkhd") < F.when(v1, 96).otherwise(84), "tkhd box is cut short")
        .when(header("mvhd", "cut"), "mvhd box is cut short")
        .when(header("mvhd", "version"), "mvhd box has an unknown version")
        .when(F.col("movie_timescale") == 0, "movie timescale is zero")
        .when(F.col("timescale").isNull(), "track has no media header")
        .when(header("mdhd", "cut"), "mdhd box is cut short")
        .when(header("mdhd", "version"), "mdhd box has an unknown version")
        .when(F.col("timescale") == 0, "timescale is zero")
        .when(F.col("handler").isNull() | (F.col("handler") == "\0\0\0\0"), "track has no handler")
    )

    def framed(k: str, width: int) -> Column:
        return F.expr(f"{k} IS NOT NULL AND (length({k}) < 8 OR length({k}) <> 8 + {long(k, 4)} * {width})")

    # a track with no table at all may have its samples elsewhere
    some = "coalesce(stts, stsc, stsz, stco, co64) IS NOT NULL"
    head = head.when(F.col("has_minf") & ~F.col("has_stbl"), "media has no sample tables")
    for k in ("stts", "stsc", "stsz"):
        head = head.when(F.expr(f"{some} AND {k} IS NULL"), f"{k} box is missing")
    head = head.when(F.expr(f"{some} AND (stco IS NULL) = (co64 IS NULL)"), "not exactly one of stco and co64")
    for k, width in (("stts", 8), ("ctts", 8), ("stsc", 12), ("stco", 4), ("co64", 8), ("stss", 4)):
        head = head.when(framed(k, width), f"{k} box has a wrong length")
    head = head.when(F.expr(f"stsz IS NOT NULL AND (length(stsz) < 12 OR {long('stsz', 4)} = 0 AND length(stsz) <> 12 + 4 * {long('stsz', 8)})"), "stsz box has a wrong length")
    counts = lambda k: F.exists(_entries(k, 8, [("n", 0, 4)]), lambda e: e["n"] == 0)
    steps = _entries("stsc", 12, [("chunk", 0, 4), ("n", 4, 4), ("d", 8, 4)])
    later = F.exists(F.zip_with(F.slice(steps, 2, F.greatest(F.size(steps) - 1, F.lit(0))), F.slice(steps, 1, F.greatest(F.size(steps) - 1, F.lit(0))), lambda b, a: b["chunk"] <= a["chunk"]), lambda x: x)
    marks = _entries("stss", 4, [("k", 0, 4)])
    total = lambda k: F.aggregate(_entries(k, 8, [("n", 0, 4)]), F.lit(0).cast("bigint"), lambda a, e: a + e["n"])
    chunks, count = F.expr(f"CASE WHEN stco IS NOT NULL THEN {long('stco', 4)} ELSE {long('co64', 4)} END"), F.expr(long("stsz", 8))
    # a step holds for the chunks up to the next one's first, the last one to the end
    ends = F.concat(F.transform(F.slice(steps, 2, F.greatest(F.size(steps) - 1, F.lit(0))), lambda e: e["chunk"] - 1), F.array(chunks))
    mapped = F.aggregate(F.zip_with(steps, ends, lambda e, end: e["n"] * F.greatest(F.least(end, chunks) - e["chunk"] + 1, F.lit(0))), F.lit(0).cast("bigint"), lambda a, n: a + n)
    return (
        head.when(F.expr(f"ctts IS NOT NULL AND {long('ctts', 0, 1)} > 1"), "ctts box has an unknown version")
        .when(counts("stts"), "stts box has a zero count")
        .when(counts("ctts"), "ctts box has a zero count")
        .when(F.size(steps) == 0, "stsc box is empty")
        .when(F.exists(steps, lambda e: (e["chunk"] == 0) | (e["n"] == 0) | (e["d"] == 0)), "stsc box has a zero")
        .when((F.size(steps) > 0) & (F.get(steps, F.lit(0))["chunk"] != 1), "stsc box does not begin at the first chunk")
        .when(later, "stsc box does not rise")
        .when(F.exists(steps, lambda e: e["d"] > F.col("entries")), "stsc box names a description that is not there")
        .when(F.exists(marks, lambda e: (e["k"] == 0) | (e["k"] > count)), "stss box names a sample that is not there")
        .when((total("stts") != count) | (total("ctts") != count) | (mapped != count), "sample tables differ in length")
    )


def bad_tracks(t: DataFrame) -> DataFrame:
    """(path, trak, error): the tracks that samples() leaves out, and why."""
    return t.withColumn("error", track_error()).where("error IS NOT NULL").select("path", "trak", "error")


def is_video(handler: str = "handler") -> Column:
    return F.col(handler) == "vide"


def first_video(t: DataFrame) -> DataFrame:
    """The first video track of each file that has samples; files without one are left out."""
    some = t.where(is_video() & F.expr(f"stsz IS NOT NULL AND length(stsz) >= 12 AND {long('stsz', 8)} > 0"))
    return some.join(some.groupBy("path").agg(F.min("trak").alias("trak")), ["path", "trak"])


def decoders(t: DataFrame) -> DataFrame:
    """first_video() tracks' sample entries that a decoder is made for (avc1, avc3), each with its own configuration: decoder state is kept by (path, trak, description_index).

    A video track without any is a row with an error: no later track takes its place.
    """
    every = first_video(t).select("path", "trak", "stsd")
    fit = descriptions(every).where("format IN ('avc1', 'avc3') AND error IS NULL")
    rows = every.select("path", "trak").join(fit, ["path", "trak"], "left")
    return rows.withColumn("error", F.when(F.col("format").isNull(), "video track has no decodable entry"))


FACTS = "track string, kind string, first bigint, n bigint, a bigint, b bigint, c bigint"
#: Samples that one row of facts stands for, at most: what one task makes of it.
FACT_SAMPLES = 1 << 16
#: Rows of a batch of facts.
BATCH = 1 << 16


def _table(data: bytes | None, width: int, kind: str = ">u4") -> np.ndarray:
    """The entries of a table box as rows of integers; a count that the payload's length contradicts is an error."""
    if data is None:
        return np.zeros((0, width // int(kind[2])), dtype=np.int64)
    if len(data) < 8 or len(data) != 8 + int.from_bytes(data[4:8], "big") * width:
        raise ValueError("table box has a wrong length")
    return np.frombuffer(data, dtype=kind, offset=8).reshape(-1, width // int(kind[2])).astype(np.int64)


def track_facts(stts: bytes | None, ctts: bytes | None, stsc: bytes | None, stsz: bytes | None, stco: bytes | None, co64: bytes | None, stss: bytes | None) -> Iterator[tuple[str, np.ndarray]]:
    """(kind, rows of first sample, number of samples, a, b, c) from one track's tables."""
    before = lambda x: np.cumsum(x) - x
    column = lambda *cs: np.stack(np.broadcast_arrays(*cs), axis=1).astype(np.int64)
    n, delta = _table(stts, 8).T
    yield "time", column(before(n), n, before(n * delta), delta, 0)
    n, shift = _table(ctts, 8).T
    if ctts is not None and ctts[0] == 1:
        shift = np.where(shift >= 1 << 31, shift - (1 << 32), shift)
    yield "shift", column(before(n), n, shift, 0, 0)
    flags = (stss is not None) + 2 * (ctts is not None)
    if stsz is not None:
        fixed, count = int.from_bytes(stsz[4:8], "big"), int.from_bytes(stsz[8:12], "big")
        if fixed:
            yield "size", column([0], [count], [fixed], [flags], 0)
        else:
            yield "size", column(np.arange(count), 1, np.frombuffer(stsz, dtype=">u4", offset=12), flags, 0)
    offsets = (_table(stco, 4) if stco is not None else _table(co64, 8, ">u8"))[:, 0]
    steps = _table(stsc, 12)
    yield "step", steps
    chunk = np.arange(1, len(offsets) + 1)
    step = np.searchsorted(steps[:, 0], chunk, side="right") - 1
    some = step >= 0
    n = np.where(some, steps[np.maximum(step, 0), 1], 0) if len(steps) else np.zeros(len(chunk), dtype=np.int64)
    what = steps[np.maximum(step, 0), 2] if len(steps) else n
    yield "chunk", column(before(n), n, offsets, what, chunk)
    yield "sync", column(_table(stss, 4)[:, 0] - 1, 1, 0, 0, 0)


def _cut(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of runs cut into runs of at most FACT_SAMPLES, and where in its run each begins; those of no samples go."""
    parts = -(-rows[:, 1] // FACT_SAMPLES)
    out = np.repeat(rows, parts, axis=0)
    place = np.arange(len(out)) - np.repeat(np.cumsum(parts) - parts, parts)
    out[:, 1] = np.minimum(out[:, 1] - place * FACT_SAMPLES, FACT_SAMPLES)
    out[:, 0] += place * FACT_SAMPLES
    return out, place * FACT_SAMPLES


def samples(t: DataFrame) -> DataFrame:
    """The sample table of each of tracks(): track, sample_idx, offset, size, dts, pts, duration, description_index, is_sync.

    Tables are decoded by the column, runs become a row a sample, and what the tables say of a sample meets in one aggregation.
    A track without any table, or without sample entries, has no samples. Tracks with an error are left out: bad_tracks() has them.
    """
    tables = ["stts", "ctts", "stsc", "stsz", "stco", "co64", "stss"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                for kind, rows in track_facts(*[row[k] for k in tables]):
                    if kind == "step":  # the chunks have them
                        continue
                    rows, place = _cut(rows)
                    if kind == "time":
                        rows[:, 2] += place * rows[:, 3]
                    for at in range(0, len(rows), BATCH):
                        part = rows[at : at + BATCH]
                        yield pa.record_batch({"track": [row["track"]] * len(part), "kind": [kind] * len(part)} | dict(zip(("first", "n", "a", "b", "c"), part.T.copy(), strict=True)))

    whole = t.where(track_error().isNull() & F.col("stsd").isNotNull() & F.col("stsz").isNotNull())
    named = whole.select(F.concat_ws("#", "path", F.col("trak").cast("string")).alias("track"), *tables)
    facts = named.mapInArrow(run, FACTS).repartition("track", "first").withColumn("rep", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1)))
    of = lambda kind, value: F.max(F.when(F.col("kind") == kind, F.expr(value)))
    rows = facts.groupBy("track", (F.col("first") + F.col("rep")).alias("sample_idx")).agg(
        of("size", "a").alias("size"), of("size", "b").alias("has"), of("time", "a + rep * b").alias("dts"), of("time", "b").alias("delta"), of("shift", "a").alias("shift"),
        of("chunk", "a").alias("chunk_offset"), of("chunk", "b").alias("description_index"), of("chunk", "c").alias("chunk"), F.coalesce(of("sync", "1"), F.lit(0)).alias("marked"),
    )
    rows = T.byte_offsets(rows, ["track", "chunk"], ["sample_idx"], "size")
    sync = (F.col("has").bitwiseAND(F.lit(1)) == 0) | (F.col("marked") == 1)
    return rows.select("track", "sample_idx", (F.col("chunk_offset") + F.col("offset")).alias("offset"), "size", "dts", (F.col("dts") + F.coalesce("shift", F.lit(0))).alias("pts"), F.col("delta").alias("duration"), "description_index", sync.alias("is_sync"))


def length_sizes(t: DataFrame) -> DataFrame:
    """(track, description_index, length_size): how many bytes the length before a unit has, by the decoder configuration of each sample entry of tracks()."""
    d = descriptions(t).where("config_type = 'avcC' AND error IS NULL")
    return d.select(F.concat_ws("#", "path", F.col("trak").cast("string")).alias("track"), "description_index", F.expr(f"CAST(({long('config', 4, 1)} & 3) + 1 AS INT)").alias("length_size"))


def units(files: DataFrame, of_samples: DataFrame, sizes: DataFrame | None = None) -> DataFrame:
    """(track, sample_idx, unit_idx, ref_idc, nal_type, bytes, error) for each length-prefixed unit of each sample.

    sizes is length_sizes() of the tracks; a description without a configuration, and any where sizes is not given, has lengths of four bytes. A malformed sample, and one that its file does
    not hold whole, is one row with an error in place of its units.
    """
    located = of_samples.withColumn("path", F.substring_index("track", "#", 1)).join(files, "path")
    if sizes is not None:
        located = located.join(sizes, ["track", "description_index"], "left")
    length = F.coalesce("length_size", F.lit(4)) if sizes is not None else F.lit(4)
    cut = located.select("track", "sample_idx", length.alias("length_size"), F.expr("CASE WHEN offset + size <= length(content) THEN substring(content, CAST(offset + 1 AS INT), CAST(size AS INT)) END").alias("data"))
    split = U.unit_headers(U.split_bytes(cut, ["track", "sample_idx"], "data", "length_size"), "unit")
    return split.select("track", "sample_idx", "unit_idx", "ref_idc", "nal_type", F.octet_length("unit").cast("bigint").alias("bytes"), "error")


# --- writing ----------------------------------------------------------------------------------


def big_endian(x: str, width: int) -> str:
    """SQL: the last width bytes of a number."""
    return f"unhex(right(lpad(hex(CAST({x} AS BIGINT)), 16, '0'), {2 * width}))"


def box(kind: str, *parts: str) -> str:
    """SQL: a box of the parts. The payload is named by a lambda, as it is used twice and boxes nest."""
    return f"transform(array(concat({', '.join(parts)})), p -> concat({big_endian('8 + length(p)', 4)}, CAST('{kind}' AS BINARY), p))[0]"


def zeros(n: int) -> str:
    return f"unhex(repeat('00', {n}))"


def _list(array: str, item: str) -> str:
    return f"unhex(array_join(transform({array}, x -> hex({item})), ''))"


def mux(of_samples: DataFrame, file: str, timescale: int, width: int, height: int, per_chunk: int = 3) -> DataFrame:
    """(path, content): an MP4 of one video track for each value of file, from rows (file, idx, delta, shift, sync, data).

    A file is one value, so its samples must fit a row; file keys should bound them.
    """
    s = of_samples.groupBy(F.col(file).cast("string").alias("path")).agg(F.array_sort(F.collect_list(F.struct("idx", "delta", "shift", "sync", "data"))).alias("s"))
    s = s.withColumn("head", F.expr(box("ftyp", "CAST('isom' AS BINARY)", big_endian("512", 4), "CAST('isommp42' AS BINARY)")))
    s = s.withColumn("media", F.expr(_list("s", "x.data"))).withColumn("n", F.expr("CAST(size(s) AS BIGINT)"))
    s = s.withColumn("starts", F.expr("aggregate(s, named_struct('at', CAST(length(head) + 8 AS BIGINT), 'all', CAST(array() AS ARRAY<BIGINT>)), (a, x) -> named_struct('at', a.at + length(x.data), 'all', array_append(a.all, a.at)), a -> a.all)"))
    s = s.withColumn("firsts", F.expr(f"filter(starts, (x, i) -> i % {per_chunk} = 0)")).withColumn("ticks", F.expr("aggregate(s, 0L, (a, x) -> a + x.delta)"))
    full, rest = f"n div {per_chunk}", f"n % {per_chunk}"
    u = big_endian
    step = lambda chunk, k: f"{u(chunk, 4)}, {u(k, 4)}, {u('1', 4)}"
    stsc = f"CASE WHEN {rest} = 0 OR {full} = 0 THEN concat({u('1', 4)}, {step('1', f'least(n, {per_chunk})')}) ELSE concat({u('2', 4)}, {step('1', str(per_chunk))}, {step(f'{full} + 1', rest)}) END"
    entry = box("avc1", zeros(6), u("1", 2), zeros(16), u(str(width), 2), u(str(height), 2), zeros(50), box("avcC", "unhex('0142C00AFF')"))
    stbl = box(
        "stbl",
        box("stsd", zeros(4), u("1", 4), entry),
        box("stts", zeros(4), u("n", 4), _list("s", f"concat({u('1', 4)}, {u('x.delta', 4)})")),
        box("ctts", "unhex('01000000')", u("n", 4), _list("s", f"concat({u('1', 4)}, {u('x.shift', 4)})")),
        box("stsc", zeros(4), stsc),
        box("stsz", zeros(4), zeros(4), u("n", 4), _list("s", u("length(x.data)", 4))),
        box("stco", zeros(4), u("size(firsts)", 4), _list("firsts", u("x", 4))),
        box("stss", zeros(4), u("size(filter(s, x -> x.sync))", 4), _list("filter(s, x -> x.sync)", u("x.idx + 1", 4))),
    )
    media_header = box("mdhd", zeros(12), u(str(timescale), 4), u("ticks", 4), zeros(4))
    # columns between, so that expressions stay small
    s = s.withColumn("stbl", F.expr(stbl))
    s = s.withColumn("mdia", F.expr(box("mdia", media_header, box("hdlr", zeros(8), "CAST('vide' AS BINARY)", zeros(13)), box("minf", "stbl"))))
    tkhd = box("tkhd", zeros(12), u("1", 4), zeros(60), u(f"{width} * 65536", 4), u(f"{height} * 65536", 4))
    s = s.withColumn("moov", F.expr(box("moov", box("mvhd", zeros(12), u(str(timescale), 4), u("ticks", 4), zeros(80)), box("trak", tkhd, "mdia"))))
    return s.select("path", F.expr(f"concat(head, {box('mdat', 'media')}, moov)").alias("content"))
