"""Queries over files and pictures that are written from the driver tables, each with SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.functions import bitstrings as S
from framelake.functions import blocks as B
from framelake.operators import direct
from framelake.operators import relations as N
from framelake.operators import table_functions
from framelake.operators.codes import with_code
from framelake.operators.units import configurations, seeded_sets
from framelake.plans.catalogue import _FILE_SQL, _WINDOW_SQL, _boxes_query, _files, _query, _slice_units, _streams, bs_strength, oracle_sql
from framelake.sources import file_sink, ranges
from framelake.sources.storage import new_folder, stored
from framelake.sources.tables import SAMPLES_SQL, TIMED_SQL, read, stored_timed
from framelake.streaming import decoding, reorder, sets


def _written_files(spark: SparkSession, d: str) -> str:
    """The MP4 files of the events as files of the shared folder; the pattern that names them."""
    rows = _files(spark, d).select(F.concat("path", F.lit(".mp4")).alias("name"), "content")
    return file_sink.write_files(rows, new_folder(spark, "mp4"))


def _folder(pattern: str) -> str:
    return pattern.rsplit("/", 2)[0]


def _stem(df: DataFrame) -> DataFrame:
    return df.withColumn("path", F.regexp_extract("path", r"([^/]+)\.mp4$", 1))


@_query(_boxes_query())
def ranged_boxes(spark: SparkSession, d: str) -> DataFrame:
    """Every box of files on disk; what stands in mdat is not read."""
    found = ranges.boxes(spark, _folder(_written_files(spark, d)))
    return _stem(found).select("path", "trak", "box_path", "depth", "type", "offset", "size", "error")


@_query(f"""WITH {_FILE_SQL} SELECT path, CAST(0 AS INTEGER) AS trak, idx AS sample_idx, "offset", size, dts, dts + shift AS pts, delta AS duration, CAST(1 AS BIGINT) AS description_index, sync AS is_sync,
md5(CASE WHEN sync THEN '0000000167' || printf('%08X', CAST(1 + strlen(props) AS BIGINT)) || '65' ELSE printf('%08X', CAST(1 + strlen(props) AS BIGINT)) || '41' END || hex(encode(props))) AS digest, CAST(NULL AS VARCHAR) AS error FROM m""")
def ranged_samples(spark: SparkSession, d: str) -> DataFrame:
    """Every sample of files on disk by its offset and size, in ranges of 4 kB so that most files are read by several tasks."""
    found = ranges.samples(spark, _folder(_written_files(spark, d)), range_bytes=4096)
    return _stem(found).select("path", "trak", "sample_idx", "offset", "size", "dts", "pts", "duration", "description_index", "is_sync", F.md5(F.hex("data").cast("binary")).alias("digest"), "error")


def _rgb_sql(term: str) -> str:
    return f"greatest(least((298 * greatest(b[i + 1] - 16, 0) + {term} + 128) >> 8, 255), 0)"


_CB, _CR = "(b[i // 16 * 4 + i % 8 // 2 + 1] - 128)", "(b[i // 16 * 4 + i % 8 // 2 + 17] - 128)"


@_query(f"""WITH x AS (SELECT vec_id, list_transform(embedding, lambda v: (CAST(floor(CAST(v AS DOUBLE) * 128) AS BIGINT) & 255)) AS b FROM embeddings)
SELECT vec_id || '.ppm' AS name, CAST(203 AS BIGINT) AS bytes, md5('50360A3820380A3235350A' || array_to_string(list_transform(range(64), lambda i: printf('%02X%02X%02X', {_rgb_sql(f'409 * {_CR}')}, {_rgb_sql(f'-100 * {_CB} - 208 * {_CR}')}, {_rgb_sql(f'516 * {_CB}')})), '')) AS digest FROM x""")
def image_sink(spark: SparkSession, d: str) -> DataFrame:
    """Every vector as a picture of 8x8 with chroma, written as a file of its own and read back."""
    b = read(spark, d, "embeddings", "vec_id", "embedding").select("vec_id", F.transform(B.quantised(F.col("embedding"), 128), lambda v: v.bitwiseAND(F.lit(255))).alias("b"))
    plane = lambda first, n: F.unhex(F.array_join(F.transform(F.slice("b", first, n), lambda v: F.lpad(F.hex(v), 2, "0")), ""))
    frames = b.select(F.concat(F.col("vec_id").cast("string"), F.lit(".ppm")).alias("name"), F.lit(8).alias("width"), F.lit(8).alias("height"), plane(1, 64).alias("y"), plane(1, 16).alias("cb"), plane(17, 16).alias("cr"))
    pattern = file_sink.write_files(file_sink.images(frames).where("error IS NULL"), new_folder(spark, "images"))
    back = file_sink.read_files(spark, pattern)
    return back.select("name", F.octet_length("content").cast("bigint").alias("bytes"), F.md5(F.hex("content").cast("binary")).alias("digest"))


# --- streams with state -------------------------------------------------------------------------


def reorder_rows(spark: SparkSession, d: str, slice_rows: int | None = None) -> DataFrame:
    """reordered() over the events' samples, which arrive up to three days late."""
    rows = stored_timed(spark, d).select(F.col("user_id").cast("string").alias("track"), "idx", "ts", "dts", "delta", "pts", F.timestamp_add("HOUR", F.pmod(F.xxhash64("event_id"), F.lit(72)).cast("int"), F.col("ts")).alias("arrives"))
    # a row of no track, a season later, tells that nothing more is to come
    last = rows.agg(F.max("arrives").alias("arrives")).select(F.lit("").alias("track"), F.lit(0).cast("bigint").alias("idx"), F.timestamp_add("DAY", F.lit(90), F.col("arrives")).alias("ts"), *[F.lit(0).cast("bigint").alias(c) for c in ("dts", "delta", "pts")], F.timestamp_add("DAY", F.lit(90), F.col("arrives")).alias("arrives"))
    every = rows.unionByName(last.where("ts IS NOT NULL"))
    week = 7 * 24 * 3_600_000
    out = decoding.streamed(every, ["arrives"], lambda s: reorder.reordered(s, least_shift=-150, gap="7 days", gap_ms=week), reorder.OUT, slice_rows, decoding.ROCKS)
    return out.where("track <> ''")


@_query(f"WITH {TIMED_SQL} SELECT CAST(user_id AS VARCHAR) AS track, idx, CAST(pts AS BIGINT) AS pts, pos FROM p")
def stream_reorder(spark: SparkSession, d: str) -> DataFrame:
    return reorder_rows(spark, d)


def set_rows(spark: SparkSession, d: str, slice_rows: int | None = None) -> DataFrame:
    """sets_in_force() over the units of slice_headers, whose samples change between two descriptions every five samples; each description is seeded by its own configuration."""
    units = _slice_units(spark, d, "ts")
    inband = units.where("sample_idx >= 0").withColumn("description", (F.floor(F.col("sample_idx") / 5) % 2 + 1).cast("bigint"))
    inband = inband.select(F.col("user_id").cast("string").alias("track"), "description", "sample_idx", "unit_idx", "unit", "ts")
    # a configuration record of each track's first sets, read back as the sets that it holds
    first = units.where("sample_idx = -1").groupBy("user_id").agg(F.max(F.when(F.col("unit_idx") == 0, F.hex("unit"))).alias("s"), F.max(F.when(F.col("unit_idx") == 1, F.hex("unit"))).alias("p"))
    size = lambda c: f"lpad(hex(length({c}) div 2), 4, '0')"
    record = first.selectExpr("CAST(user_id AS STRING) AS track", f"unhex(concat('0142000AFFE1', {size('s')}, s, '01', {size('p')}, p)) AS config")
    seeds = seeded_sets(configurations(record, ["track"], "config"), "track").select("track", F.explode(F.array(F.lit(1).cast("bigint"), F.lit(2).cast("bigint"))).alias("description"), "unit")
    seeds = stored(seeds, "seeds")
    buckets = sets.buckets_for(seeds.count() // 2)  # a sequence set and a picture set a decoder
    return decoding.streamed(inband, ["ts"], lambda s: sets.sets_in_force(s, seeds, buckets), sets.OUT, slice_rows, decoding.ROCKS, (sets.bucket(buckets),))


@_query(f"""WITH {SAMPLES_SQL}, v AS (SELECT user_id, idx, event_id, k, event_type = 'signup' AS idr, idx // 5 % 2 + 1 AS description FROM s),
w AS (SELECT *, COALESCE(last_value(CASE WHEN idr THEN idx END IGNORE NULLS) OVER o, -1) AS since, COALESCE(last_value(CASE WHEN idr THEN event_id END IGNORE NULLS) OVER o, 0) AS v FROM v WINDOW o AS (PARTITION BY user_id, description ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT CAST(user_id AS VARCHAR) AS track, CAST(description AS BIGINT) AS description, idx AS sample_idx, k % 50 AS first_mb, user_id % 8 AS pps_id, since AS set_sample, user_id % 4 AS sps_id, since AS sps_sample, 26 + v % 13 - 6 AS init_qp, 4 + v % 9 AS log2_max_frame_num, CAST(NULL AS VARCHAR) AS error FROM w""")
def stream_sets(spark: SparkSession, d: str) -> DataFrame:
    return set_rows(spark, d).drop("unit_idx")


# --- joins of blocks ------------------------------------------------------------------------------

_UE_SQL = lambda x: f"lpad(bin({x} + 1), CAST(2 * length(bin({x} + 1)) - 1 AS INTEGER), '0')"


@_query(f"""WITH c AS (SELECT DISTINCT p_size % 2 AS t, {_UE_SQL('p_size')} AS code, CAST(p_size AS BIGINT) AS value FROM part UNION ALL SELECT 1, '0001', CAST(99 AS BIGINT)),
r AS (SELECT p_partkey, p_partkey % 2 AS t, CASE WHEN p_partkey % 29 > 0 THEN {_UE_SQL('p_partkey % 60')} || bin(p_partkey) END AS bits FROM part),
j AS (SELECT p_partkey, bits, count(code) AS n, min(value) AS value, min(length(code)) AS length FROM r LEFT JOIN c ON r.t = c.t AND starts_with(bits, code) GROUP BY ALL)
SELECT p_partkey, CASE WHEN n = 1 THEN value END AS value, CASE WHEN n = 1 THEN CAST(length AS INTEGER) END AS code_bits, CASE WHEN bits IS NULL THEN 'row has a null' WHEN n = 0 THEN 'no code begins the bits' WHEN n > 1 THEN 'several codes begin the bits' END AS code_error FROM j""")
def codeword_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Two tables of codes that the sizes of parts give, one of them with a code that begins others, against bits of each part."""
    part = read(spark, d, "part", "p_partkey", "p_size")
    codes = part.selectExpr("p_size % 2 AS t", f"{S.ue('p_size')} AS code", "CAST(p_size AS BIGINT) AS value").distinct().unionByName(part.limit(1).selectExpr("1 AS t", "'0001' AS code", "99L AS value"))
    rows = part.selectExpr("p_partkey", "CAST(p_partkey % 2 AS INT) AS t", f"CASE WHEN p_partkey % 29 > 0 THEN concat({S.ue('p_partkey % 60')}, bin(p_partkey)) END AS bits")
    return with_code(rows, codes, "t", "bits", "code", "value").select("p_partkey", "value", "code_bits", "code_error")


@_query("""WITH x AS (SELECT vec_id, unnest(range(64)) AS a, unnest(list_transform(embedding, lambda v: CAST(floor(CAST(v AS DOUBLE) * 16) AS BIGINT))) AS v FROM embeddings), b AS (SELECT *, a // (5 + vec_id % 23) AS s FROM x WHERE (a + vec_id) % 11 > 0)
SELECT b.vec_id, b.a AS address, b.v AS value, CAST(b.s AS BIGINT) AS slice, CASE WHEN b.a % 8 > 0 THEN l.v END AS "left", t.v AS top, CASE WHEN b.a % 8 < 7 THEN r.v END AS top_right, CASE WHEN b.a % 8 > 0 THEN q.v END AS top_left
FROM b LEFT JOIN b l ON l.vec_id = b.vec_id AND l.a = b.a - 1 AND l.s = b.s LEFT JOIN b t ON t.vec_id = b.vec_id AND t.a = b.a - 8 AND t.s = b.s LEFT JOIN b r ON r.vec_id = b.vec_id AND r.a = b.a - 7 AND r.s = b.s LEFT JOIN b q ON q.vec_id = b.vec_id AND q.a = b.a - 9 AND q.s = b.s""")
def block_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """Every vector as a picture of 8x8 blocks in slices, one block in eleven lost; tiles of 3x3 blocks."""
    e = read(spark, d, "embeddings", "vec_id", "embedding").select("vec_id", F.posexplode(B.quantised(F.col("embedding"), 16)).alias("address", "value"))
    blocks = e.selectExpr("vec_id", "CAST(address AS BIGINT) AS address", "value", "CAST(address div (5 + vec_id % 23) AS BIGINT) AS slice").where("(address + vec_id) % 11 > 0")
    return N.tiled_neighbours(blocks, "vec_id", "address", "value", "slice", 8, tile=3)


@_query("""WITH p AS (SELECT o_custkey, o_orderkey, 2 * o_orderkey AS poc, o_orderkey % 3 <> 1 AS ref FROM orders),
n AS (SELECT *, COALESCE(sum(CAST(ref AS INT)) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, min(CASE WHEN ref THEN o_orderkey END) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next FROM p),
m AS (SELECT l_orderkey, min(l_linenumber) AS place, l_linenumber, min(CAST(l_quantity AS BIGINT)) - 25 AS x, 9 - min(CAST(l_quantity AS BIGINT)) AS y, l_linenumber % 3 AS back, bool_or(l_returnflag = 'A') AS intra FROM lineitem GROUP BY l_orderkey, l_linenumber),
b AS (SELECT n.*, l.l_linenumber AS place FROM n JOIN m l ON l.l_orderkey = n.o_orderkey WHERE NOT n.ref),
j AS (SELECT b.*, c.poc AS cpoc, CASE WHEN NOT COALESCE(m.intra, true) AND c.before - 1 - m.back >= 0 THEN c.before - 1 - m.back END AS named, m.x, m.y FROM b LEFT JOIN n c ON c.o_custkey = b.o_custkey AND c.o_orderkey = b.next LEFT JOIN m ON m.l_orderkey = b.next AND m.l_linenumber = b.place),
k AS (SELECT j.*, r.poc AS rpoc, j.before - 1 - named AS slot FROM j LEFT JOIN n r ON r.ref AND r.o_custkey = j.o_custkey AND r.before = named),
t AS (SELECT *, CASE WHEN next IS NULL THEN 'no later reference' WHEN slot < 0 OR slot >= 2 THEN 'colocated reference is not in the first list' END AS error, greatest(least(cpoc - rpoc, 127), -128) AS td, greatest(least(poc - rpoc, 127), -128) AS tb FROM k),
s AS (SELECT *, greatest(least((CAST(tb * ((16384 + abs(td // 2)) // td) AS BIGINT) + 32) >> 6, 1023), -1024) AS scale FROM t)
SELECT o_custkey, o_orderkey, CAST(place AS INTEGER) AS place, CASE WHEN error IS NULL THEN CAST(COALESCE(slot, 0) AS BIGINT) END AS ref0, CASE WHEN error IS NULL THEN CAST(0 AS BIGINT) END AS ref1,
CASE WHEN error IS NULL THEN CAST(CASE WHEN rpoc IS NULL THEN 0 ELSE (scale * x + 128) >> 8 END AS BIGINT) END AS x0, CASE WHEN error IS NULL THEN CAST(CASE WHEN rpoc IS NULL THEN 0 ELSE (scale * y + 128) >> 8 END AS BIGINT) END AS y0,
CASE WHEN error IS NULL THEN CAST(CASE WHEN rpoc IS NULL THEN 0 ELSE ((scale * x + 128) >> 8) - x END AS BIGINT) END AS x1, CASE WHEN error IS NULL THEN CAST(CASE WHEN rpoc IS NULL THEN 0 ELSE ((scale * y + 128) >> 8) - y END AS BIGINT) END AS y1, error FROM s""")
def temporal_direct(spark: SparkSession, d: str) -> DataFrame:
    """Orders of a customer as pictures, of which one in three is no reference and takes the motion of its lines from the next reference's lines."""
    p = stored(read(spark, d, "orders", "o_custkey", "o_orderkey").selectExpr("o_custkey", "o_orderkey", "2 * o_orderkey AS poc", "o_orderkey % 3 <> 1 AS is_reference"), "pictures")
    step = 1 << 16
    pictures = stored(direct.colocated(p, "o_custkey", "o_orderkey", F.floor(F.col("o_orderkey") / step), F.floor(-F.col("o_orderkey") / step)), "colocated")
    lines = read(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_quantity", "l_returnflag").groupBy("l_orderkey", "l_linenumber").agg(F.min(F.col("l_quantity").cast("bigint")).alias("q"), F.bool_or(F.col("l_returnflag") == "A").alias("intra"))
    owned = stored(lines.join(p.select("o_custkey", "o_orderkey", "is_reference"), F.col("l_orderkey") == F.col("o_orderkey")), "lines")
    motion = owned.where("is_reference").selectExpr("o_custkey", "o_orderkey", "l_linenumber AS place", "q - 25 AS x", "9 - q AS y", "l_linenumber % 3 AS back", "intra")
    blocks = owned.where("NOT is_reference").selectExpr("o_custkey", "o_orderkey", "CAST(l_linenumber AS INT) AS place")
    return direct.direct_motion(blocks, pictures, motion, "o_custkey", "o_orderkey", "place", active=2)


# --- SQL table functions ----------------------------------------------------------------------------


@_query(oracle_sql()["annexb_units"])
def annexb_sql(spark: SparkSession, d: str) -> DataFrame:
    """The units of the documents' streams by a query in SQL alone."""
    table_functions.register(spark)
    _streams(spark, d).createOrReplaceTempView("framelake_streams")
    return spark.sql("""SELECT doc_id, unit_idx, CAST(octet_length(unit) AS BIGINT) AS bytes, shiftright(b, 5) & 3 AS ref_idc, b & 31 AS nal_type, error
      FROM (SELECT *, CAST(conv(hex(substring(unit, 1, 1)), 16, 10) AS BIGINT) AS b FROM split_annexb(TABLE(framelake_streams), 'stream'))""")


@_query(oracle_sql()["annexb_units"])
def annexb_lateral(spark: SparkSession, d: str) -> DataFrame:
    """The same by a lateral join, a stream at a time."""
    table_functions.register(spark)
    _streams(spark, d).createOrReplaceTempView("framelake_streams")
    return spark.sql("""SELECT doc_id, unit_idx, CAST(octet_length(unit) AS BIGINT) AS bytes, shiftright(b, 5) & 3 AS ref_idc, b & 31 AS nal_type, error
      FROM (SELECT s.doc_id, u.*, CAST(conv(hex(substring(u.unit, 1, 1)), 16, 10) AS BIGINT) AS b FROM framelake_streams s, LATERAL annexb_units_of(s.stream) u)""")


@_query(f"SELECT l_orderkey, (line - 1) // 2 AS segment, max(bs) AS bs FROM ({oracle_sql()['bs_strength']}) GROUP BY ALL")
def chroma_strength(spark: SparkSession, d: str) -> DataFrame:
    """The strength of a chroma segment, which lies along two luma segments: neighbouring lines of an order."""
    edges = bs_strength(spark, d).withColumn("segment", F.expr("(line - 1) div 2"))
    return N.strongest(edges, ["l_orderkey", "segment"], "bs", "bs")


# --- prediction as columns ---------------------------------------------------------------------------

_H = lambda row: f"least(greatest((t[{row}] + 16) >> 5, 0), 255)"
_V = lambda column: f"least(greatest((({' + '.join(f'{w} * s[{6 * r + column}]' for r, w in enumerate(B.TAPS))}) + 16) >> 5, 0), 255)"
_D = f"least(greatest((({' + '.join(f'{w} * t[{r + 1}]' for r, w in enumerate(B.TAPS))}) + 512) >> 10, 0), 255)"
_MEAN = lambda a, b: f"(({a}) + ({b}) + 1) >> 1"
_G, _R, _B, _RB = "s[15]", "s[16]", "s[21]", "s[22]"  # the sample, and those to its right, below and both
_PLACES = [
    _G, _MEAN(_G, "h"), "h", _MEAN("h", _R),
    _MEAN(_G, "v"), _MEAN("h", "v"), _MEAN("h", "d"), _MEAN("h", "m"),
    "v", _MEAN("v", "d"), "d", _MEAN("d", "m"),
    _MEAN("v", _B), _MEAN("v", "u"), _MEAN("d", "u"), _MEAN("u", "m"),
]


@_query(f"""WITH {_WINDOW_SQL}, y AS (SELECT *, list_transform(range(6), lambda r: {' + '.join(f'{w} * s[6 * r + {c + 1}]' for c, w in enumerate(B.TAPS))}) AS t FROM x),
z AS (SELECT vec_id, w, s, {_H(3)} AS h, {_H(4)} AS u, {_V(3)} AS v, {_V(4)} AS m, {_D} AS d FROM y)
SELECT vec_id, w, concat_ws(',', {', '.join(f'CAST({p} AS BIGINT)' for p in _PLACES)}) AS places FROM z""")
def luma_quarter_samples(spark: SparkSession, d: str) -> DataFrame:
    """Every vector as an 8x8 picture; all 16 quarter samples of all its 6x6 windows."""
    b = read(spark, d, "embeddings", "vec_id", "embedding").select("vec_id", F.transform(B.quantised(F.col("embedding"), 128), lambda v: v.bitwiseAND(F.lit(255))).alias("b"))
    w = b.select("vec_id", "b", F.explode(F.sequence(F.lit(0), F.lit(8))).alias("w"))
    x = w.select("vec_id", "w", F.expr("transform(sequence(0, 35), i -> b[CAST((w div 3 + i div 6) * 8 + w % 3 + i % 6 AS INT)])").alias("s"))
    return x.select("vec_id", "w", B.joined(B.quarter_samples(F.col("s"))).alias("places"))


def _plane_sql(top: str, left: str, size: int, factor: int) -> str:
    half = size // 2
    at = lambda side, i: f"{side}[{i + 1}]" if i >= 0 else "c"
    slope = lambda side: f"(({factor} * ({' + '.join(f'{i} * ({at(side, half - 1 + i)} - {at(side, half - 1 - i)})' for i in range(1, half + 1))}) + 32) >> 6)"
    return f"list_transform(range({size * size}), lambda i: least(greatest((16 * ({top}[{size}] + {left}[{size}]) + {slope(top)} * (i % {size} - {half - 1}) + {slope(left)} * (i // {size} - {half - 1}) + 16) >> 5, 0), 255))"


def _mean_sql(*sides: tuple[str, int, int]) -> str:
    """The rounded mean of parts of sides (name, first, number) that are all there."""
    n = sum(k for *_, k in sides)
    return f"CAST(({' + '.join(f'list_sum({s}[{a}:{a + k - 1}])' for s, a, k in sides)} + {n // 2}) // {n} AS BIGINT)"


_CHROMA_MEAN = f"""CASE WHEN t IS NOT NULL AND l IS NOT NULL THEN [{_mean_sql(('t', 1, 4), ('l', 1, 4))}, {_mean_sql(('t', 5, 4))}, {_mean_sql(('l', 5, 4))}, {_mean_sql(('t', 5, 4), ('l', 5, 4))}]
 WHEN t IS NOT NULL THEN [{_mean_sql(('t', 1, 4))}, {_mean_sql(('t', 5, 4))}, {_mean_sql(('t', 1, 4))}, {_mean_sql(('t', 5, 4))}] WHEN l IS NOT NULL THEN [{_mean_sql(('l', 1, 4))}, {_mean_sql(('l', 1, 4))}, {_mean_sql(('l', 5, 4))}, {_mean_sql(('l', 5, 4))}] ELSE [128, 128, 128, 128] END"""
_LUMA_MEAN = f"CASE WHEN t IS NOT NULL AND l IS NOT NULL THEN {_mean_sql(('t', 1, 16), ('l', 1, 16))} WHEN t IS NOT NULL THEN {_mean_sql(('t', 1, 16))} WHEN l IS NOT NULL THEN {_mean_sql(('l', 1, 16))} ELSE 128 END"


@_query(f"""WITH x AS (SELECT vec_id, list_transform(embedding, lambda v: (CAST(floor(CAST(v AS DOUBLE) * 128) AS BIGINT) & 255)) AS b FROM embeddings),
y AS (SELECT vec_id, CASE WHEN vec_id % 4 <> 1 AND vec_id % 8 <> 6 THEN b[1:16] END AS t, CASE WHEN vec_id % 4 <> 2 THEN b[17:32] END AS l, CASE WHEN vec_id % 5 > 0 THEN b[33] END AS c FROM x),
m AS (SELECT *, {_LUMA_MEAN} AS dc, {_CHROMA_MEAN} AS cm FROM y)
SELECT vec_id, array_to_string(CASE WHEN t IS NOT NULL THEN list_transform(range(256), lambda i: t[i % 16 + 1]) END, ',') AS luma_down, array_to_string(CASE WHEN l IS NOT NULL THEN list_transform(range(256), lambda i: l[i // 16 + 1]) END, ',') AS luma_across, dc AS luma_mean,
array_to_string(CASE WHEN t IS NOT NULL AND l IS NOT NULL AND c IS NOT NULL THEN {_plane_sql('t', 'l', 16, 5)} END, ',') AS luma_plane, array_to_string(list_transform(range(64), lambda i: cm[i // 32 * 2 + i % 8 // 4 + 1]), ',') AS chroma_mean,
array_to_string(CASE WHEN t IS NOT NULL AND l IS NOT NULL AND c IS NOT NULL THEN {_plane_sql('t', 'l', 8, 34)} END, ',') AS chroma_plane FROM m""")
def intra_squares(spark: SparkSession, d: str) -> DataFrame:
    """Borders of squares from every vector, some without one side or the corner; luma and chroma modes."""
    b = read(spark, d, "embeddings", "vec_id", "embedding").select("vec_id", F.transform(B.quantised(F.col("embedding"), 128), lambda v: v.bitwiseAND(F.lit(255))).alias("b"))
    b = b.selectExpr("vec_id", "CASE WHEN vec_id % 4 <> 1 AND vec_id % 8 <> 6 THEN slice(b, 1, 16) END AS t", "CASE WHEN vec_id % 4 <> 2 THEN slice(b, 17, 16) END AS l", "CASE WHEN vec_id % 5 > 0 THEN b[32] END AS c")
    t, l, c = F.col("t"), F.col("l"), F.col("c")
    joined = lambda mode, size: B.joined(B.intra_square(mode, F.slice(t, 1, size), F.slice(l, 1, size), c, size))
    return b.select("vec_id", joined(0, 16).alias("luma_down"), joined(1, 16).alias("luma_across"), B.intra_square(2, t, l, c)[0].alias("luma_mean"), joined(3, 16).alias("luma_plane"), joined(0, 8).alias("chroma_mean"), joined(3, 8).alias("chroma_plane"))


_SUB_SQL = "[[8, 8, 3], [8, 8, 0], [8, 8, 1], [8, 8, 2], [8, 4, 0], [4, 8, 0], [8, 4, 1], [4, 8, 1], [8, 4, 2], [4, 8, 2], [4, 4, 0], [4, 4, 1], [4, 4, 2]]"
_PAIR_SQL = "[[0, 0], [1, 1], [0, 1], [1, 0], [0, 2], [1, 2], [2, 0], [2, 1], [2, 2]]"


@_query(f"""WITH p AS (SELECT p_partkey, CAST(p_partkey % 24 AS INTEGER) AS raw, p_size AS z FROM part),
w AS (SELECT p_partkey, 0 AS x, 0 AS y, 16 AS width, 16 AS height, (raw + 3) % 4 AS k FROM p WHERE raw < 4),
h AS (SELECT p_partkey, CASE WHEN raw % 2 = 1 THEN 8 * i ELSE 0 END AS x, CASE WHEN raw % 2 = 0 THEN 8 * i ELSE 0 END AS y, CASE WHEN raw % 2 = 1 THEN 8 ELSE 16 END AS width, CASE WHEN raw % 2 = 1 THEN 16 ELSE 8 END AS height, list_extract(list_extract({_PAIR_SQL}, (raw - 4) // 2 + 1), i + 1) AS k FROM (SELECT *, CAST(unnest(range(2)) AS INTEGER) AS i FROM p WHERE raw BETWEEN 4 AND 21)),
q AS (SELECT p_partkey, q, list_extract({_SUB_SQL}, CAST((z + q) % 13 AS INTEGER) + 1) AS s FROM (SELECT *, CAST(unnest(range(4)) AS INTEGER) AS q FROM p WHERE raw = 22)),
e AS (SELECT p_partkey, q, s, CAST(unnest(range(64 // (s[1] * s[2]))) AS INTEGER) AS i FROM q),
a AS (SELECT * FROM w UNION ALL SELECT * FROM h UNION ALL SELECT p_partkey, q % 2 * 8 + i % (8 // s[1]) * s[1], q // 2 * 8 + i // (8 // s[1]) * s[2], s[1], s[2], s[3] FROM e)
SELECT p_partkey, CAST(x AS BIGINT) AS x, CAST(y AS BIGINT) AS y, CAST(width AS BIGINT) AS width, CAST(height AS BIGINT) AS height, k IN (0, 2) AS list0, k IN (1, 2) AS list1, k = 3 AS direct FROM a""")
def bi_partitions(spark: SparkSession, d: str) -> DataFrame:
    """Parts as B macroblocks of every type and an unknown one."""
    x = read(spark, d, "part", "p_partkey", "p_size").select("p_partkey", (F.col("p_partkey") % 24).alias("raw"), F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: (F.col("p_size") + i) % 13).alias("sub"))
    return x.select("p_partkey", F.explode(B.bi_partitions(F.col("raw"), F.col("sub"))).alias("p")).select("p_partkey", "p.*")
