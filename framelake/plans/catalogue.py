"""Queries over the driver tables: each applies an operator or function of the library to a whole table, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from framelake.functions import arithmetic as A
from framelake.functions import bitstrings as S
from framelake.functions import blocks as B
from framelake.operators import parameter_sets as P
from framelake.operators import references as R
from framelake.operators import relations as N
from framelake.operators import timeline as T
from framelake.operators import units as U
from framelake.operators.scan import latest, preceding, prefix, scan
from framelake.sources import container as C
from framelake.sources.storage import stored
from framelake.sources.tables import SAMPLES_SQL, TIMED_SQL, read, samples, stored_timed, timed
from framelake.streaming import decoding as D

TIMESCALE = 12288
_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def _query(sql: str):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        _QUERIES[f.__name__] = f
        _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


#: Whether an event starts a group of pictures.
_STARTS = "CAST(event_type = 'signup' AS INT)"


def _groups(rows: DataFrame) -> DataFrame:
    """rows (with before: the starts before each) with gop, the group that each is in."""
    return rows.withColumn("gop", T.gop_number(F.col("before"), F.expr(_STARTS))).drop("before")


# --- timelines over events -------------------------------------------------------------------


@_query(f"WITH {TIMED_SQL} SELECT user_id, event_id, idx, dts, pts, pos FROM p")
def pts_order(spark: SparkSession, d: str) -> DataFrame:
    return T.presentation_order(stored_timed(spark, d), "user_id").select("user_id", "event_id", "idx", "dts", "pts", "pos")


_TICKS = "CASE WHEN lead(pts) OVER (PARTITION BY user_id ORDER BY pts, idx) - pts > 0 THEN lead(pts) OVER (PARTITION BY user_id ORDER BY pts, idx) - pts ELSE delta END"


@_query(f"WITH {TIMED_SQL}, x AS (SELECT user_id, event_id, pts, {_TICKS} AS ticks FROM t) SELECT *, ticks * 1000000000 // {TIMESCALE} AS duration_ns FROM x")
def pts_duration(spark: SparkSession, d: str) -> DataFrame:
    return T.presentation_durations(stored_timed(spark, d), "user_id", TIMESCALE).select("user_id", "event_id", "pts", "ticks", "duration_ns")


@_query(f"WITH {SAMPLES_SQL} SELECT event_id, delta * 1000000000 // {TIMESCALE} AS frame_ns FROM s")
def frame_ns(spark: SparkSession, d: str) -> DataFrame:
    return samples(spark, d).select("event_id", T.ticks_to_ns("delta", TIMESCALE).alias("frame_ns"))


@_query(f"WITH {TIMED_SQL} SELECT event_id, dts FROM d")
def dts_prefix_sum(spark: SparkSession, d: str) -> DataFrame:
    return timed(spark, d).select("event_id", "dts")


@_query(f"WITH {SAMPLES_SQL} SELECT event_id, user_id, CAST(sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY idx) AS BIGINT) AS gop FROM s")
def gop_id(spark: SparkSession, d: str) -> DataFrame:
    return _groups(samples(spark, d, before=prefix(F.expr(_STARTS)))).select("event_id", "user_id", "gop")


@_query(f"""WITH {SAMPLES_SQL}, g AS (SELECT *, sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY idx) AS gop FROM s)
SELECT user_id, CAST(gop AS BIGINT) AS gop, count(*) AS frames, CAST(sum(delta) AS BIGINT) AS ticks, min(idx) AS first_idx FROM g GROUP BY user_id, gop""")
def gop_summary(spark: SparkSession, d: str) -> DataFrame:
    g = _groups(samples(spark, d, before=prefix(F.expr(_STARTS))))
    return g.groupBy("user_id", "gop").agg(F.count("*").alias("frames"), F.sum("delta").alias("ticks"), F.min("idx").alias("first_idx"))


@_query(f"WITH {TIMED_SQL} SELECT event_id, pos, max(idx) OVER (PARTITION BY user_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) + 1 - pos AS held FROM p")
def reorder_occupancy(spark: SparkSession, d: str) -> DataFrame:
    return T.reorder_occupancy(stored_timed(spark, d), "user_id").select("event_id", "pos", "held")


@_query(f"WITH {SAMPLES_SQL} SELECT event_id, last_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS set_id FROM s")
def paramset_asof(spark: SparkSession, d: str) -> DataFrame:
    return samples(spark, d, set_id=latest(F.when(F.col("event_type") == "signup", F.col("event_id")))).select("event_id", "set_id")


@_query(f"WITH {SAMPLES_SQL}, r AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY idx DESC) AS rank FROM s) SELECT user_id, event_id, rank FROM r WHERE rank <= 4")
def sliding_refs(spark: SparkSession, d: str) -> DataFrame:
    return T.newest(samples(spark, d), "user_id", 4).select("user_id", "event_id", F.col("rank").cast("bigint").alias("rank"))


@_query(f"WITH {SAMPLES_SQL} SELECT event_id, CAST(((26 + sum(k % 7 - 3) OVER (PARTITION BY user_id ORDER BY idx)) % 52 + 52) % 52 AS BIGINT) AS qp FROM s")
def qp_accum(spark: SparkSession, d: str) -> DataFrame:
    q = samples(spark, d, before=prefix(F.col("k") % 7 - 3))
    return q.select("event_id", A.wrapped_qp("before", "k % 7 - 3").alias("qp"))


@_query("WITH r AS (SELECT user_id, event_type, arg_max(event_id, ts) AS event_id, max(ts) AS ts FROM events GROUP BY user_id, event_type) SELECT user_id, event_type, event_id FROM r")
def last_write_wins(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "events", "user_id", "event_type", "event_id", "ts")
    return N.last_writes(e, ["user_id", "event_type"], "event_id", ["ts", "event_id"])


@_query("SELECT event_id, CAST(floor((event_id - 5000) / 7.0) AS BIGINT) AS quotient, (((event_id - 5000) % 7) + 7) % 7 AS remainder FROM events")
def floor_divmod(spark: SparkSession, d: str) -> DataFrame:
    q, r = A.floor_divmod("(event_id - 5000)", 7)
    return read(spark, d, "events", "event_id").select("event_id", q.alias("quotient"), r.alias("remainder"))


_RGB = {"r": "409 * v", "g": "-100 * u - 208 * v", "b": "516 * u"}


@_query("WITH x AS (SELECT event_id, 298 * greatest(event_id * 37 % 256 - 16, 0) AS y, event_id * 59 % 256 - 128 AS u, event_id * 83 % 256 - 128 AS v FROM events) SELECT event_id, " + ", ".join(f"CAST(least(greatest((y + ({t}) + 128) >> 8, 0), 255) AS BIGINT) AS {k}" for k, t in _RGB.items()) + " FROM x")
def clip_bt601(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "events", "event_id").selectExpr("event_id", "event_id * 37 % 256 AS y", "event_id * 59 % 256 AS cb", "event_id * 83 % 256 AS cr")
    return e.select("event_id", *[c.alias(k) for k, c in A.bt601("y", "cb", "cr").items()])


_TAPS = (1, -5, 20, 20, -5, 1)


@_query(f"WITH {SAMPLES_SQL} SELECT event_id, CAST(least(greatest((" + " + ".join(f"{w} * COALESCE({'lag' if o < 0 else 'lead'}(k, {abs(o)}) OVER w, {'first_value' if o < 0 else 'last_value'}(k) OVER f)" if o else f"{w} * k" for o, w in zip(range(-2, 4), _TAPS, strict=True)) + " + 16) >> 5, 0), 255) AS BIGINT) AS sample FROM s WINDOW w AS (PARTITION BY user_id ORDER BY idx), f AS (PARTITION BY user_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)")
def sixtap(spark: SparkSession, d: str) -> DataFrame:
    return R.six_tap(samples(spark, d), "user_id", "idx", "k", _TAPS).select("event_id", "sample")


# --- run lengths, joins and orders over the star tables ---------------------------------------


@_query("""WITH r AS (SELECT p_brand, p_partkey, CAST(p_size AS BIGINT) AS n, CAST(COALESCE(sum(p_size) OVER (PARTITION BY p_brand ORDER BY p_partkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS f FROM part),
x AS (SELECT *, unnest(range(n)) AS rep FROM r) SELECT p_brand, p_partkey, rep, f + rep AS sample_idx FROM x""")
def rle_expand(spark: SparkSession, d: str) -> DataFrame:
    return T.expand_runs(read(spark, d, "part", "p_brand", "p_partkey", "p_size"), "p_brand", "p_partkey", "p_size").select("p_brand", "p_partkey", "rep", "sample_idx")


_LINE = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity"]


@_query(f"""SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS line, l_partkey, l_suppkey, CAST(floor(l_quantity) AS BIGINT) AS size,
CAST(COALESCE(sum(CAST(floor(l_quantity) AS BIGINT)) OVER (PARTITION BY l_orderkey ORDER BY {', '.join(_LINE)} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset" FROM lineitem""")
def byte_offsets(spark: SparkSession, d: str) -> DataFrame:
    x = read(spark, d, "lineitem", "l_orderkey", *_LINE).withColumn("size", F.floor("l_quantity").cast("bigint"))
    return T.byte_offsets(x, ["l_orderkey"], _LINE, "size").select("l_orderkey", F.col("l_linenumber").cast("bigint").alias("line"), "l_partkey", "l_suppkey", "size", "offset")


@_query("""SELECT o_orderkey, last_value(CASE WHEN o_orderpriority = '1-URGENT' THEN o_orderkey END IGNORE NULLS) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS step FROM orders""")
def stsc_asof(spark: SparkSession, d: str) -> DataFrame:
    o = read(spark, d, "orders", "o_orderkey", "o_custkey", "o_orderpriority")
    return scan(o, ["o_custkey"], ["o_orderkey"], T.by_index("o_orderkey"), step=latest(F.when(F.col("o_orderpriority") == "1-URGENT", F.col("o_orderkey")))).select("o_orderkey", "step")


@_query("SELECT o_orderkey, o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity >= 49) AS is_sync FROM orders")
def sync_flag(spark: SparkSession, d: str) -> DataFrame:
    marks = read(spark, d, "lineitem", "l_orderkey", "l_quantity").where("l_quantity >= 49")
    return N.flagged(read(spark, d, "orders", "o_orderkey"), "o_orderkey", marks, "l_orderkey", "is_sync")


@_query("SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS line, l_partkey, p_brand, p_type FROM lineitem JOIN part ON l_partkey = p_partkey")
def desc_lookup(spark: SparkSession, d: str) -> DataFrame:
    j = N.described(read(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_partkey"), "l_partkey", read(spark, d, "part", "p_partkey", "p_brand", "p_type"), "p_partkey")
    return j.select("l_orderkey", F.col("l_linenumber").cast("bigint").alias("line"), "l_partkey", "p_brand", "p_type")


@_query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment <> 'BUILDING')")
def fk_violations(spark: SparkSession, d: str) -> DataFrame:
    c = read(spark, d, "customer", "c_custkey", "c_mktsegment").where("c_mktsegment <> 'BUILDING'")
    return N.dangling(read(spark, d, "orders", "o_orderkey", "o_custkey"), "o_custkey", c, "c_custkey")


@_query("""WITH x AS (SELECT *, o_orderstatus = 'F' AS long, CAST(o_orderkey % 16 AS BIGINT) AS fn, CAST(o_orderkey % 32 AS BIGINT) AS li FROM orders), y AS (SELECT *, fn - CASE WHEN fn > 9 THEN 16 ELSE 0 END AS pn FROM x)
SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY long, CASE WHEN long THEN li ELSE -pn END, o_orderkey) - 1 AS place FROM y""")
def ref_list_p(spark: SparkSession, d: str) -> DataFrame:
    o = read(spark, d, "orders", "o_custkey", "o_orderkey", "o_orderstatus").selectExpr("o_custkey", "o_orderkey", "o_orderstatus = 'F' AS long", "o_orderkey % 16 AS frame_num", "o_orderkey % 32 AS long_idx")
    return R.list_p(o, "o_custkey", "o_orderkey", current=9, largest=16).select("o_custkey", "o_orderkey", F.col("place").cast("bigint").alias("place"))


@_query("""WITH x AS (SELECT o_custkey, o_orderkey, o_orderstatus = 'F' AS long, o_orderkey % 64 AS poc FROM orders),
a AS (SELECT o_custkey, string_agg(o_orderkey, ',' ORDER BY CASE WHEN long THEN 2 WHEN poc < 32 THEN 0 ELSE 1 END, CASE WHEN NOT long AND poc < 32 THEN -poc ELSE poc END, o_orderkey) AS l0,
string_agg(o_orderkey, ',' ORDER BY CASE WHEN long THEN 2 WHEN poc < 32 THEN 1 ELSE 0 END, CASE WHEN NOT long AND poc < 32 THEN -poc ELSE poc END, o_orderkey) AS l1,
list(o_orderkey ORDER BY CASE WHEN long THEN 2 WHEN poc < 32 THEN 1 ELSE 0 END, CASE WHEN NOT long AND poc < 32 THEN -poc ELSE poc END, o_orderkey) AS e FROM x GROUP BY o_custkey)
SELECT o_custkey, l0, CASE WHEN l0 = l1 AND len(e) > 1 THEN array_to_string(list_concat([e[2], e[1]], e[3:]), ',') ELSE l1 END AS l1 FROM a""")
def ref_list_b(spark: SparkSession, d: str) -> DataFrame:
    o = read(spark, d, "orders", "o_custkey", "o_orderkey", "o_orderstatus").selectExpr("o_custkey", "o_orderkey", "o_orderstatus = 'F' AS long", "o_orderkey % 64 AS poc", "o_orderkey % 64 AS long_idx")
    return R.lists_b(o, "o_custkey", "o_orderkey", current=32).select("o_custkey", B.joined(F.col("l0")).alias("l0"), B.joined(F.col("l1")).alias("l1"))


@_query("WITH r AS (SELECT c_mktsegment, c_custkey, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey) AS place FROM customer) SELECT * FROM r WHERE place <= 5")
def topk_active(spark: SparkSession, d: str) -> DataFrame:
    c = read(spark, d, "customer", "c_mktsegment", "c_custkey", "c_acctbal")
    return N.top(c, ["c_mktsegment"], [F.desc("c_acctbal"), "c_custkey"], 5).select("c_mktsegment", "c_custkey", "place")


@_query("""SELECT o_orderkey, CAST(CASE WHEN s = 0 THEN 0 ELSE least((t // s) * CAST(1000000000 AS HUGEINT) + (t % s) * 1000000000 // s, 9223372036854775807) END AS BIGINT) AS ns
FROM (SELECT o_orderkey, CAST(o_orderkey AS HUGEINT) * 1000000007 AS t, CAST(o_custkey % 4 AS HUGEINT) AS s FROM orders)""")
def duration_saturate(spark: SparkSession, d: str) -> DataFrame:
    o = read(spark, d, "orders", "o_orderkey", "o_custkey").selectExpr("o_orderkey", "o_orderkey * 1000000007 AS t", "o_custkey % 4 AS s")
    return o.select("o_orderkey", T.saturated_ns("t", "s").alias("ns"))


@_query("SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS line, count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1")
def duplicate_addresses(spark: SparkSession, d: str) -> DataFrame:
    x = N.duplicates(read(spark, d, "lineitem", "l_orderkey", "l_linenumber"), ["l_orderkey", "l_linenumber"])
    return x.select("l_orderkey", F.col("l_linenumber").cast("bigint").alias("line"), "n")


@_query("SELECT l_orderkey, count(DISTINCT l_linenumber) AS decoded, CAST(max(l_linenumber) AS BIGINT) AS expected, count(DISTINCT l_linenumber) = max(l_linenumber) AS complete FROM lineitem GROUP BY l_orderkey")
def complete_pictures(spark: SparkSession, d: str) -> DataFrame:
    return N.completeness(read(spark, d, "lineitem", "l_orderkey", "l_linenumber"), "l_orderkey", "l_linenumber", F.max("l_linenumber"))


# --- scalar functions over lineitem and part --------------------------------------------------

_L = "l_orderkey, CAST(l_linenumber AS BIGINT) AS line, l_partkey, l_suppkey"


def _lines(spark: SparkSession, d: str) -> DataFrame:
    x = read(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    return x.withColumn("q", F.floor("l_quantity").cast("bigint")).withColumn("line", F.col("l_linenumber").cast("bigint"))


_KEYS = ("l_orderkey", "line", "l_partkey", "l_suppkey")
_Q = "CAST(floor(l_quantity) AS BIGINT)"


@_query(f"SELECT {_L}, greatest(least(l_partkey, l_suppkey), least(greatest(l_partkey, l_suppkey), {_Q} * 20)) AS m FROM lineitem")
def median3(spark: SparkSession, d: str) -> DataFrame:
    return _lines(spark, d).select(*_KEYS, A.median3("l_partkey", "l_suppkey", "q * 20").alias("m"))


@_query(f"""SELECT {_L}, CAST(least(greatest(CASE WHEN dn >= 1 THEN (x * w + (1 << (dn - 1))) >> dn ELSE x * w END + o, 0), 255) AS BIGINT) AS sample
FROM (SELECT *, l_partkey % 256 AS x, {_Q} - 20 AS w, CAST(l_linenumber % 4 AS INTEGER) AS dn, l_suppkey % 21 - 10 AS o FROM lineitem)""".replace("greatest(CASE", "greatest((CASE").replace("END + o", "END) + o").replace("(1 << (dn - 1))", "(CAST(1 AS BIGINT) << greatest(dn - 1, 0))"))
def weighted_p(spark: SparkSession, d: str) -> DataFrame:
    x = _lines(spark, d).selectExpr(*_KEYS, "l_partkey % 256 AS x", "q - 20 AS w", "l_linenumber % 4 AS dn", "l_suppkey % 21 - 10 AS o")
    return x.select(*_KEYS, A.weighted("x", "w", "o", "dn").alias("sample"))


@_query(f"""SELECT {_L}, CAST(least(greatest(((x * w + y * (64 - w) + (CAST(1 AS BIGINT) << dn)) >> (dn + 1)) + ((o + 1) >> 1), 0), 255) AS BIGINT) AS sample
FROM (SELECT *, l_partkey % 256 AS x, l_suppkey % 256 AS y, {_Q} AS w, CAST(l_linenumber % 6 AS INTEGER) AS dn, l_suppkey % 21 - 10 AS o FROM lineitem)""")
def weighted_b(spark: SparkSession, d: str) -> DataFrame:
    x = _lines(spark, d).selectExpr(*_KEYS, "l_partkey % 256 AS x", "l_suppkey % 256 AS y", "q AS w", "64 - q AS w1", "l_linenumber % 6 AS dn", "l_suppkey % 21 - 10 AS o")
    return x.select(*_KEYS, A.weighted_pair("x", "y", "w", "w1", "o", "dn").alias("sample"))


@_query(f"""WITH x AS (SELECT *, l_partkey % 300 AS p0, l_suppkey % 300 AS p1, {_Q} * 5 AS c FROM lineitem), y AS (SELECT *, least(greatest(c - p0, -128), 127) AS tb, least(greatest(p1 - p0, -128), 127) AS td FROM x),
z AS (SELECT *, CASE WHEN td = 0 THEN NULL ELSE least(greatest((tb * ((16384 + abs(td // 2)) // td) + 32) >> 6, -1024), 1023) >> 2 END AS w FROM y)
SELECT {_L}, CAST(CASE WHEN p0 = p1 OR w < -64 OR w > 128 THEN 32 ELSE w END AS BIGINT) AS weight FROM z""")
def implicit_b(spark: SparkSession, d: str) -> DataFrame:
    x = _lines(spark, d).selectExpr(*_KEYS, "l_partkey % 300 AS p0", "l_suppkey % 300 AS p1", "q * 5 AS c")
    return x.select(*_KEYS, A.implicit_weight("p0", "p1", "c").alias("weight"))


@_query(f"""SELECT {_L}, CAST(CASE WHEN i AND e THEN 4 WHEN i THEN 3 WHEN q % 3 = 0 THEN 2 WHEN l_partkey % 2 <> l_suppkey % 2 OR q % 8 >= 4 THEN 1 ELSE 0 END AS BIGINT) AS bs
FROM (SELECT *, l_returnflag = 'A' AS i, l_linestatus = 'O' AS e, {_Q} AS q FROM lineitem)""")
def bs_strength(spark: SparkSession, d: str) -> DataFrame:
    x = read(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag", "l_linestatus")
    x = x.withColumn("q", F.floor("l_quantity").cast("bigint")).withColumn("line", F.col("l_linenumber").cast("bigint"))
    return x.select(*_KEYS, A.strength("l_returnflag = 'A'", "l_linestatus = 'O'", "q % 3 = 0", "l_partkey % 2 <> l_suppkey % 2", "q % 8").alias("bs"))


@_query("SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN -(p_partkey // 2) ELSE p_partkey // 2 + 1 END AS value FROM part")
def se_golomb(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "part", "p_partkey").select("p_partkey", A.signed_golomb("p_partkey").alias("value"))


@_query("SELECT p_partkey, CAST(2 * length(bin(p_partkey + 1)) - 1 AS BIGINT) AS bits FROM part")
def ue_bits(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "part", "p_partkey").select("p_partkey", A.golomb_bits("p_partkey").alias("bits"))


@_query(f"SELECT p_partkey, CAST(CASE WHEN q < 30 THEN q ELSE list_extract({A.CHROMA_QP}, CAST(q - 29 AS BIGINT)) END AS BIGINT) AS qp FROM (SELECT p_partkey, least(greatest(p_partkey % 60 + p_size % 25 - 12, 0), 51) AS q FROM part)")
def chroma_qp(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "part", "p_partkey", "p_size").select("p_partkey", A.chroma_qp("p_partkey % 60", "p_size % 25 - 12").alias("qp"))


@_query("SELECT p_partkey, CAST(((p_partkey % 256) * 31 // 255) << 11 AS BIGINT) AS scaled FROM part")
def mask_scale(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "part", "p_partkey").select("p_partkey", A.mask_scale("(p_partkey % 256)", 5, 11).alias("scaled"))


@_query("SELECT p_partkey, (p_partkey + 7) // 8 * 8 AS aligned FROM part")
def align(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "part", "p_partkey").select("p_partkey", A.align("p_partkey", 8).alias("aligned"))


@_query("""WITH x AS (SELECT p_partkey, least(greatest(((p_partkey % 61 - 30) * least(greatest(CAST(p_size AS BIGINT) + 3, 0), 51) >> 4) + p_partkey % 127 - 40, 1), 126) AS pre FROM part)
SELECT p_partkey, CASE WHEN pre <= 63 THEN 63 - pre ELSE pre - 64 END AS state, CAST(CASE WHEN pre <= 63 THEN 0 ELSE 1 END AS BIGINT) AS mps FROM x""")
def cabac_init(spark: SparkSession, d: str) -> DataFrame:
    state, mps = A.context_state("(p_partkey % 61 - 30)", "(p_partkey % 127 - 40)", "p_size + 3")
    return read(spark, d, "part", "p_partkey", "p_size").select("p_partkey", state.alias("state"), mps.alias("mps"))


@_query("SELECT p_partkey, p_partkey % 16 % 2 + p_partkey % 16 // 4 % 2 * 2 AS bx, p_partkey % 16 // 2 % 2 + p_partkey % 16 // 8 * 2 AS \"by\" FROM part")
def block_xy(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "part", "p_partkey").select("p_partkey", *[c.alias(n) for n, c in zip(("bx", "by"), A.block_place("(p_partkey % 16)"), strict=True)])


@_query("SELECT p_partkey, p_partkey % 40 AS mb_x, p_partkey // 40 AS mb_y FROM part")
def raster_xy(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "part", "p_partkey").select("p_partkey", *[c.alias(n) for n, c in zip(("mb_x", "mb_y"), A.raster_place("p_partkey", 40), strict=True)])


@_query("SELECT n_nationkey AS y, CAST(x AS INTEGER) AS x, CAST(x * 255 // 24 AS BIGINT) AS red, CAST(n_nationkey * 255 // 24 AS BIGINT) AS green FROM nation, range(25) r(x)")
def gradient(spark: SparkSession, d: str) -> DataFrame:
    n = read(spark, d, "nation", "n_nationkey").withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(24))))
    return n.select(F.col("n_nationkey").alias("y"), "x", A.gradient("x", 25).alias("red"), A.gradient("n_nationkey", 25).alias("green"))


def _motion(suffix: str, shift: int) -> dict[str, str]:
    return {
        f"r{suffix}": f"CASE WHEN (l_partkey + {shift}) % 5 > 0 THEN (l_suppkey + {shift}) % 3 END", f"x{suffix}": f"CASE WHEN (l_partkey + {shift}) % 5 > 0 THEN (l_partkey + {shift}) % 23 - 11 END", f"y{suffix}": f"CASE WHEN (l_partkey + {shift}) % 5 > 0 THEN (l_suppkey * 3 + {shift}) % 19 - 9 END"
    }


_MOTION = _motion("a", 0) | _motion("b", 1) | _motion("c", 7) | {"ref": "l_orderkey % 3"}
_MOTION_SQL = f"SELECT {_L}, " + ", ".join(f"{e} AS {n}" for n, e in _MOTION.items()) + " FROM lineitem"
_NEIGHBOURS = {k: (f"r{k}", f"x{k}", f"y{k}") for k in "abc"}


def _vector_sql(direct: str, axis: str, ref: str = "ref") -> str:
    v = {k: f"COALESCE({axis}{k}, 0)" for k in "abc"}
    hit = " + ".join(f"CASE WHEN r{k} = {ref} THEN 1 ELSE 0 END" for k in "abc")
    has = " + ".join(f"CASE WHEN r{k} IS NOT NULL THEN 1 ELSE 0 END" for k in "abc")
    middle = f"list_extract(list_sort([{v['a']}, {v['b']}, {v['c']}]), 2)"
    return f"CAST(CASE {direct} WHEN {hit} = 1 THEN CASE WHEN ra = {ref} THEN {axis}a WHEN rb = {ref} THEN {axis}b ELSE {axis}c END WHEN {has} <= 1 THEN COALESCE({axis}a, {axis}b, {axis}c, 0) ELSE {middle} END AS BIGINT)"


@_query(f"WITH m AS ({_MOTION_SQL}) SELECT l_orderkey, line, l_partkey, l_suppkey, " + ", ".join(f"{_vector_sql('', a)} AS v{a}, {_vector_sql(f'WHEN rb = ref THEN {a}b', a)} AS t{a}, {_vector_sql(f'WHEN rc = ref THEN {a}c', a)} AS r{a}, CASE WHEN ra IS NULL OR rb IS NULL OR ra <> 0 OR rb <> 0 OR (xa = 0 AND ya = 0) OR (xb = 0 AND yb = 0) THEN 0 ELSE {_vector_sql('', a, '0')} END AS s{a}" for a in "xy") + " FROM m")
def motion_vectors(spark: SparkSession, d: str) -> DataFrame:
    m = _lines(spark, d).select(*_KEYS, *[F.expr(e).alias(n) for n, e in _MOTION.items()])
    whole, top, right, skip = A.predicted_vector("ref", _NEIGHBOURS), A.predicted_vector("ref", _NEIGHBOURS, "16x8", 0), A.predicted_vector("ref", _NEIGHBOURS, "8x16", 1), A.skip_vector(_NEIGHBOURS)
    return m.select(*_KEYS, *[v[i].alias(f"{n}{a}") for n, v in (("v", whole), ("t", top), ("r", right), ("s", skip)) for i, a in enumerate("xy")])


_PQ = _motion("p0", 0) | _motion("p1", 3) | _motion("q0", 5) | _motion("q1", 8)
_SAME = lambda p, q: f"(r{p} IS NOT DISTINCT FROM r{q} AND NOT COALESCE(abs(x{p} - x{q}) >= 4 OR abs(y{p} - y{q}) >= 4, false))"


@_query(f"WITH m AS (SELECT {_L}, l_returnflag, l_linestatus, {_Q} AS q, " + ", ".join(f"{e} AS {n}" for n, e in _PQ.items()) + f""" FROM lineitem)
SELECT l_orderkey, line, l_partkey, l_suppkey, CAST(CASE WHEN l_returnflag = 'A' AND l_linestatus = 'O' THEN 4 WHEN l_returnflag = 'A' THEN 3 WHEN q % 9 = 0 THEN 2 WHEN ({_SAME('p0', 'q0')} AND {_SAME('p1', 'q1')}) OR ({_SAME('p0', 'q1')} AND {_SAME('p1', 'q0')}) THEN 0 ELSE 1 END AS BIGINT) AS bs FROM m""")
def bs_strength_b(spark: SparkSession, d: str) -> DataFrame:
    x = read(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag", "l_linestatus")
    x = x.withColumn("q", F.floor("l_quantity").cast("bigint")).withColumn("line", F.col("l_linenumber").cast("bigint")).withColumns({n: F.expr(e) for n, e in _PQ.items()})
    motion = lambda k: tuple(f"{v}{k}{i}" for i in (0, 1) for v in "rxy")
    return x.select(*_KEYS, A.strength_b("l_returnflag = 'A'", "l_linestatus = 'O'", "q % 9 = 0", motion("p"), motion("q")).alias("bs"))


@_query(f"SELECT {_L}, CAST(((8 - fx) * (8 - fy) * a + fx * (8 - fy) * b + (8 - fx) * fy * c + fx * fy * e + 32) >> 6 AS BIGINT) AS sample FROM (SELECT *, l_partkey % 256 AS a, l_suppkey % 256 AS b, {_Q} * 5 AS c, l_orderkey % 256 AS e, l_partkey % 8 AS fx, l_suppkey % 8 AS fy FROM lineitem)")
def chroma_bilinear(spark: SparkSession, d: str) -> DataFrame:
    x = _lines(spark, d).selectExpr(*_KEYS, "l_partkey % 256 AS a", "l_suppkey % 256 AS b", "q * 5 AS c", "l_orderkey % 256 AS e", "l_partkey % 8 AS fx", "l_suppkey % 8 AS fy")
    return x.select(*_KEYS, A.bilinear("a", "b", "c", "e", "fx", "fy").alias("sample"))


_TYPES = "['P', 'B', 'I', 'SP', 'SI']"


@_query(f"SELECT p_partkey, t AS slice_type, CAST(CASE WHEN v BETWEEN 0 AND 25 THEN v END AS BIGINT) AS intra_type, (p_size >> 1) & 1 = 1 AS coded, CAST(CASE WHEN p_size % 4 = 0 THEN p_partkey % 7 WHEN p_size % 4 = 1 THEN NULL ELSE least(p_partkey % 7, p_size % 5) END AS BIGINT) AS least_ref, CAST(CASE WHEN p_size > 10 THEN 1 ELSE 0 END + CASE WHEN p_partkey % 3 = 1 THEN 1 ELSE 0 END AS BIGINT) AS increment FROM (SELECT *, raw - CASE t WHEN 'I' THEN 0 WHEN 'SI' THEN 1 WHEN 'B' THEN 23 ELSE 5 END AS v FROM (SELECT *, list_extract({_TYPES}, p_partkey % 5 + 1) AS t, p_partkey * 7 % 53 AS raw FROM part))")
def macroblock_types(spark: SparkSession, d: str) -> DataFrame:
    x = read(spark, d, "part", "p_partkey", "p_size").selectExpr("p_partkey", "p_size", "element_at(array('P', 'B', 'I', 'SP', 'SI'), CAST(p_partkey % 5 + 1 AS INT)) AS slice_type", "p_partkey * 7 % 53 AS raw", "CASE WHEN p_size % 4 <> 1 THEN p_partkey % 7 END AS l", "CASE WHEN p_size % 4 > 1 THEN p_size % 5 END AS t", "CASE WHEN p_partkey % 3 > 0 THEN p_partkey % 3 = 1 END AS c")
    return x.select("p_partkey", "slice_type", A.intra_type("slice_type", "raw").alias("intra_type"), A.coded("p_size", "1").alias("coded"), A.least_reference("l", "t").alias("least_ref"), A.increments("p_size > 10", "c").alias("increment"))


# --- neighbours and quality gates -------------------------------------------------------------


@_query("""WITH x AS (SELECT conv_id, turn, CAST(length(text) % 17 AS BIGINT) AS n FROM conversations)
SELECT a.conv_id, a.turn, CAST(COALESCE((l.n + t.n + 1) // 2, l.n, t.n, 0) AS BIGINT) AS nc FROM x a LEFT JOIN x l ON l.conv_id = a.conv_id AND l.turn = a.turn - 1 LEFT JOIN x t ON t.conv_id = a.conv_id AND t.turn = a.turn - 3""")
def neighbour_nc(spark: SparkSession, d: str) -> DataFrame:
    x = read(spark, d, "conversations", "conv_id", "turn", "text").select("conv_id", "turn", (F.length("text") % 17).cast("bigint").alias("n"))
    j = N.with_neighbours(x, "conv_id", "turn", "n", {"l": 1, "t": 3})
    return j.select("conv_id", "turn", A.neighbour_total("l", "t").alias("nc"))


@_query("""SELECT d.doc_id, CASE WHEN l.toxic = 1 THEN 'toxic' WHEN l.quality = 0 THEN 'quality' WHEN d.n_chars < 200 THEN 'short' WHEN l.doc_id IS NULL THEN 'unlabelled' ELSE 'ok' END AS reason FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id""")
def quality_gate(spark: SparkSession, d: str) -> DataFrame:
    lab = read(spark, d, "labels", "doc_id", "quality", "toxic").withColumnRenamed("doc_id", "k")
    j = read(spark, d, "documents", "doc_id", "n_chars").join(lab, F.col("doc_id") == F.col("k"), "left")
    return j.select("doc_id", F.expr("CASE WHEN toxic = 1 THEN 'toxic' WHEN quality = 0 THEN 'quality' WHEN n_chars < 200 THEN 'short' WHEN k IS NULL THEN 'unlabelled' ELSE 'ok' END").alias("reason"))


# --- blocks of embeddings ---------------------------------------------------------------------


def _block(spark: SparkSession, d: str, n: int, scale: int = 512) -> DataFrame:
    return read(spark, d, "embeddings", "vec_id", "embedding").select("vec_id", B.quantised(F.slice("embedding", 1, n), scale).alias("b"))


def _blocks(spark: SparkSession, d: str, n: int = 16, scale: int = 512) -> DataFrame:
    """(vec_id, g, b): every vector as blocks of n integers."""
    whole = read(spark, d, "embeddings", "vec_id", "embedding").select("vec_id", F.posexplode(F.transform(F.sequence(F.lit(0), F.floor(F.size("embedding") / n).cast("int") - 1), lambda i: F.slice("embedding", i * n + 1, n))).alias("g", "e"))
    return whole.select("vec_id", "g", B.quantised(F.col("e"), scale).alias("b"))


def _blocks_sql(n: int = 16, scale: int = 512) -> str:
    return f"""g AS (SELECT vec_id, unnest(range(len(embedding) // {n})) AS g, embedding FROM embeddings),
x AS (SELECT vec_id, CAST(g AS INTEGER) AS g, list_transform(embedding[g * {n} + 1:g * {n} + {n}], lambda v: CAST(floor(CAST(v AS DOUBLE) * {scale}) AS BIGINT)) AS b FROM g)"""


def _block_sql(n: int, scale: int = 512) -> str:
    return f"x AS (SELECT vec_id, list_transform(embedding[1:{n}], lambda v: CAST(floor(CAST(v AS DOUBLE) * {scale}) AS BIGINT)) AS b FROM embeddings)"


@_query(f"WITH {_block_sql(64, 16)} SELECT vec_id, len(list_filter(b, lambda v: v <> 0)) AS n FROM x")
def count_nonzero(spark: SparkSession, d: str) -> DataFrame:
    return _block(spark, d, 64, 16).select("vec_id", B.nonzero(F.col("b")).alias("n"))


@_query(f"WITH {_block_sql(64)} SELECT vec_id, CAST(list_sum(b) AS BIGINT) AS total FROM x")
def plane_checksum(spark: SparkSession, d: str) -> DataFrame:
    return _block(spark, d, 64).select("vec_id", B.checksum(F.col("b")).alias("total"))


@_query(f"WITH {_blocks_sql()} SELECT vec_id, g, array_to_string(list_transform({[A.ZIGZAG.index(i) + 1 for i in range(16)]}, lambda i: b[i]), ',') AS block FROM x")
def zigzag_4x4(spark: SparkSession, d: str) -> DataFrame:
    return _blocks(spark, d).select("vec_id", "g", B.joined(B.zigzag(F.col("b"))).alias("block"))


def _matrix_sql(step: list[str], n: int, last: str) -> str:
    """Two passes of a 4-point step written with a, b, c, d: over the rows of x.b, then over columns."""

    def use(f: str, names: list[str]) -> str:
        return "".join(dict(zip("abcd", names, strict=True)).get(ch, ch) for ch in f)

    rows = [use(f, [f"b[{4 * r + k + 1}]" for k in range(4)]) for r in range(4) for f in step]
    cols = [use(step[r], [f"m[{4 * k + c + 1}]" for k in range(4)]) for r in range(4) for c in range(4)]
    return f"WITH {_blocks_sql(n)}, y AS (SELECT vec_id, g, [{', '.join(rows)}] AS m FROM x), z AS (SELECT vec_id, g, [{', '.join(cols)}] AS o FROM y) SELECT vec_id, g, array_to_string({last}, ',') AS block FROM z"


@_query(_matrix_sql(["((a)+(c))+((b)+((d)>>1))", "((a)-(c))+(((b)>>1)-(d))", "((a)-(c))-(((b)>>1)-(d))", "((a)+(c))-((b)+((d)>>1))"], 16, "list_transform(o, lambda v: (v + 32) >> 6)"))
def idct_4x4(spark: SparkSession, d: str) -> DataFrame:
    return _blocks(spark, d).select("vec_id", "g", B.joined(B.inverse_4x4(F.col("b"))).alias("block"))


@_query(_matrix_sql(["a+b+c+d", "a+b-c-d", "a-b-c+d", "a-b+c-d"], 16, "o"))
def dc_hadamard(spark: SparkSession, d: str) -> DataFrame:
    return _blocks(spark, d).select("vec_id", "g", B.joined(B.hadamard_4x4(F.col("b"))).alias("block"))


@_query(f"""WITH {_blocks_sql(8, 64)} SELECT vec_id, g, array_to_string([b[1], (2*b[1]+3*b[2]+b[3]+b[4]+b[5]+4)>>3, (b[2]+b[3]+b[4]+b[5]+2)>>2, (b[2]+2*b[3]+2*b[4]+2*b[5]+b[6]+4)>>3,
(b[3]+2*b[4]+2*b[5]+2*b[6]+b[7]+4)>>3, (b[4]+b[5]+b[6]+b[7]+2)>>2, (2*b[8]+3*b[7]+b[6]+b[5]+b[4]+4)>>3, b[8]], ',') AS edge FROM x""")
def edge_filter(spark: SparkSession, d: str) -> DataFrame:
    return _blocks(spark, d, 8, 64).select("vec_id", "g", B.joined(B.strong_edge(F.col("b"))).alias("edge"))


_QP = "CAST((vec_id * 7 + g * 5) % 52 AS INTEGER)"
_SCALE_SQL = f"list_extract({[list(s) for s in B.LEVEL_SCALES]}, qp % 6 + 1)"


@_query(f"""WITH {_blocks_sql(16, 64)}, q AS (SELECT vec_id, g, b, {_QP} AS qp FROM x) SELECT vec_id, g, array_to_string(list_transform(range(1, 17), lambda i: b[i] * list_extract({_SCALE_SQL}, (i - 1) // 4 % 2 + (i - 1) % 2 + 1) * CAST(pow(2, qp // 6) AS BIGINT)), ',') AS block FROM q""")
def dequant_4x4(spark: SparkSession, d: str) -> DataFrame:
    return _blocks(spark, d, 16, 64).select("vec_id", "g", B.joined(B.dequantised(F.col("b"), F.expr(_QP))).alias("block"))


@_query(f"""WITH {_blocks_sql(4, 64)}, q AS (SELECT vec_id, g, b, {_QP} AS qp FROM x), h AS (SELECT vec_id, g, qp, [b[1]+b[2]+b[3]+b[4], b[1]-b[2]+b[3]-b[4], b[1]+b[2]-b[3]-b[4], b[1]-b[2]-b[3]+b[4]] AS h FROM q)
SELECT vec_id, g, array_to_string(list_transform(h, lambda v: CASE WHEN qp >= 6 THEN (v * {_SCALE_SQL}[1]) * CAST(pow(2, qp // 6 - 1) AS BIGINT) ELSE (v * {_SCALE_SQL}[1]) >> 1 END), ',') AS block FROM h""")
def chroma_dc(spark: SparkSession, d: str) -> DataFrame:
    return _blocks(spark, d, 4, 64).select("vec_id", "g", B.joined(B.chroma_dc(F.col("b"), F.expr(_QP))).alias("block"))


@_query(_matrix_sql(["a+b+c+d", "a+b-c-d", "a-b-c+d", "a-b+c-d"], 16, "o").replace("SELECT vec_id, g, array_to_string(o, ',') AS block FROM z", f"""SELECT vec_id, g, array_to_string(list_transform(o, lambda v: CASE WHEN qp >= 12 THEN (v * {_SCALE_SQL}[1]) * CAST(pow(2, qp // 6 - 2) AS BIGINT) ELSE (v * {_SCALE_SQL}[1] + CAST(pow(2, 1 - qp // 6) AS BIGINT)) >> (2 - qp // 6) END), ',') AS block FROM (SELECT *, {_QP} AS qp FROM z)"""))
def luma_dc(spark: SparkSession, d: str) -> DataFrame:
    return _blocks(spark, d).select("vec_id", "g", B.joined(B.luma_dc(F.col("b"), F.expr(_QP))).alias("block"))


_BORDER_SQL = f"{_blocks_sql(16, 128)}, n AS (SELECT vec_id, g, list_transform(b, lambda v: v & 255) AS b, (vec_id + g) % 4 AS lack FROM x)"


def _border(spark: SparkSession, d: str) -> DataFrame:
    """Borders of blocks: top (8 samples), left (4) and corner, of which some blocks lack one or both sides."""
    n = _blocks(spark, d, 16, 128).select("vec_id", "g", F.transform("b", lambda v: v.bitwiseAND(F.lit(255))).alias("b"), ((F.col("vec_id") + F.col("g")) % 4).alias("lack"))
    return n.select("vec_id", "g", "b", F.when(~F.col("lack").isin(1, 3), F.slice("b", 1, 8)).alias("top"), F.when(~F.col("lack").isin(2, 3), F.slice("b", 9, 4)).alias("left"), F.get("b", F.lit(12)).alias("corner"))


@_query(f"WITH {_BORDER_SQL} SELECT vec_id, g, CAST(CASE lack WHEN 3 THEN 128 WHEN 1 THEN (list_sum(b[9:12]) + 2) // 4 WHEN 2 THEN (list_sum(b[1:4]) + 2) // 4 ELSE (list_sum(b[1:4]) + list_sum(b[9:12]) + 4) // 8 END AS BIGINT) AS dc FROM n")
def intra_dc(spark: SparkSession, d: str) -> DataFrame:
    return _border(spark, d).select("vec_id", "g", B.intra_dc(F.when(F.col("top").isNotNull(), F.slice("top", 1, 4)), F.col("left")).alias("dc"))


def _intra_sql() -> str:
    """Modes of 4x4 prediction by the samples' places: top(i), left(i) and the corner at -1."""
    t = lambda i: "b[13]" if i < 0 else f"b[{i + 1}]"
    l = lambda i: "b[13]" if i < 0 else f"b[{9 + i}]"  # noqa: E731, E741
    two = lambda a, b: f"({a} + {b} + 1) >> 1"
    three = lambda a, b, c: f"({a} + 2 * {b} + {c} + 2) >> 2"

    def at(mode: int, x: int, y: int) -> str:
        if mode == 0:
            return t(x)
        if mode == 1:
            return l(y)
        if mode == 3:
            return three(t(6), t(7), t(7)) if x + y == 6 else three(t(x + y), t(x + y + 1), t(x + y + 2))
        if mode == 4:
            return three(t(0), t(-1), l(0)) if x == y else three(t(x - y - 2), t(x - y - 1), t(x - y)) if x > y else three(l(y - x - 2), l(y - x - 1), l(y - x))
        if mode == 5:
            z, k = 2 * x - y, x - (y >> 1)
            return two(t(k - 1), t(k)) if z >= 0 and z % 2 == 0 else three(t(k - 2) if k > 1 else l(0) if k == 0 else t(-1), t(k - 1), t(k)) if z > 0 else three(l(0), t(-1), t(0)) if z == -1 else three(l(y - 1), l(y - 2), l(y - 3))
        if mode == 6:
            z, k = 2 * y - x, y - (x >> 1)
            return two(l(k - 1), l(k)) if z >= 0 and z % 2 == 0 else three(l(k - 2) if k > 1 else t(0) if k == 0 else l(-1), l(k - 1), l(k)) if z > 0 else three(l(0), t(-1), t(0)) if z == -1 else three(t(x - 1), t(x - 2), t(x - 3))
        if mode == 7:
            z = x + (y >> 1)
            return two(t(z), t(z + 1)) if y % 2 == 0 else three(t(z), t(z + 1), t(z + 2))
        z, k = x + 2 * y, y + (x >> 1)
        return l(3) if z > 5 else three(l(2), l(3), l(3)) if z == 5 else two(l(k), l(k + 1)) if z % 2 == 0 else three(l(k), l(k + 1), l(k + 2))

    needs = {0: "lack IN (1, 3)", 1: "lack IN (2, 3)", 3: "lack IN (1, 3)", 4: "lack > 0", 5: "lack > 0", 6: "lack > 0", 7: "lack IN (1, 3)", 8: "lack IN (2, 3)"}
    modes = ", ".join(f"CASE WHEN NOT ({needs[m]}) THEN array_to_string([{', '.join(at(m, x, y) for y in range(4) for x in range(4))}], ',') END AS m{m}" for m in needs)
    return f"WITH {_BORDER_SQL} SELECT vec_id, g, {modes} FROM n"


@_query(_intra_sql())
def intra_4x4(spark: SparkSession, d: str) -> DataFrame:
    n = _border(spark, d)
    return n.select("vec_id", "g", *[B.joined(B.intra_4x4(m, F.col("top"), F.col("left"), F.col("corner"))).alias(f"m{m}") for m in (0, 1, 3, 4, 5, 6, 7, 8)])


@_query(f"WITH {_BORDER_SQL} SELECT vec_id, g, array_to_string(list_transform(range(1, 17), lambda i: greatest(least(b[i] + (b[17 - i] - 128) * 2, 255), 0)), ',') AS block FROM n")
def reconstruct(spark: SparkSession, d: str) -> DataFrame:
    n = _border(spark, d).withColumn("r", F.transform(F.reverse("b"), lambda v: (v - 128) * 2))
    return n.select("vec_id", "g", B.joined(B.reconstructed(F.col("b"), F.col("r"))).alias("block"))


def _edge_sql() -> str:
    clip = lambda v, lo, hi: f"greatest(least({v}, {hi}), {lo})"
    byte = lambda v: clip(v, 0, 255)
    zeros = [0] * B.FIRST_INDEX
    steps = f"""{_blocks_sql(8, 16)}, a AS (SELECT vec_id, g, list_transform(b, lambda v: greatest(least(v + 100, 255), 0)) AS p, CAST((vec_id + g * 3) % 52 AS INTEGER) AS qp, CAST(vec_id % 5 AS INTEGER) AS bs FROM x),
t AS (SELECT *, p[2] AS p2, p[3] AS p1, p[4] AS p0, p[5] AS q0, p[6] AS q1, p[7] AS q2, list_extract({zeros + B.ALPHA}, greatest(least(qp + 4, 51), 0) + 1) AS al, list_extract({zeros + B.BETA}, greatest(least(qp - 2, 51), 0) + 1) AS be,
  CASE bs WHEN 2 THEN list_extract({zeros + B.TC0[1]}, greatest(least(qp + 4, 51), 0) + 1) WHEN 3 THEN list_extract({zeros + B.TC0[2]}, greatest(least(qp + 4, 51), 0) + 1) ELSE list_extract({zeros + B.TC0[0]}, greatest(least(qp + 4, 51), 0) + 1) END AS tc0 FROM a),
u AS (SELECT *, abs(p2 - p0) < be AS np, abs(q2 - q0) < be AS nq, bs > 0 AND abs(p0 - q0) < al AND abs(p1 - p0) < be AND abs(q1 - q0) < be AS on_, abs(p0 - q0) < (al >> 2) + 2 AS sm FROM t),
w AS (SELECT *, tc0 + CAST(np AS INTEGER) + CAST(nq AS INTEGER) AS tc FROM u), v AS (SELECT *, {clip('(4 * (q0 - p0) + (p1 - q1) + 4) >> 3', '-tc', 'tc')} AS de FROM w)"""
    weak = ["p[1]", "p2", f"CASE WHEN np THEN {byte('p1 + ' + clip('(p2 + ((p0 + q0 + 1) >> 1) - 2 * p1) >> 1', '-tc0', 'tc0'))} ELSE p1 END", byte("p0 + de"), byte("q0 - de"), f"CASE WHEN nq THEN {byte('q1 + ' + clip('(q2 + ((p0 + q0 + 1) >> 1) - 2 * q1) >> 1', '-tc0', 'tc0'))} ELSE q1 END", "q2", "p[8]"]
    weak = [x.replace("p1 + greatest", "p1 + greatest") for x in weak]
    full = [
        "p[1]", "CASE WHEN sm AND np THEN (2*p[1]+3*p2+p1+p0+q0+4)>>3 ELSE p2 END", "CASE WHEN sm AND np THEN (p2+p1+p0+q0+2)>>2 ELSE p1 END", "CASE WHEN sm AND np THEN (p2+2*p1+2*p0+2*q0+q1+4)>>3 ELSE (2*p1+p0+q1+2)>>2 END",
        "CASE WHEN sm AND nq THEN (p1+2*p0+2*q0+2*q1+q2+4)>>3 ELSE (2*q1+q0+p1+2)>>2 END", "CASE WHEN sm AND nq THEN (p0+q0+q1+q2+2)>>2 ELSE q1 END", "CASE WHEN sm AND nq THEN (2*p[8]+3*q2+q1+q0+p0+4)>>3 ELSE q2 END", "p[8]",
    ]
    return f"WITH {steps} SELECT vec_id, g, array_to_string(CASE WHEN NOT on_ THEN p WHEN bs < 4 THEN [{', '.join(weak)}] ELSE [{', '.join(full)}] END, ',') AS edge FROM v"


@_query(_edge_sql())
def deblock_edge(spark: SparkSession, d: str) -> DataFrame:
    x = _blocks(spark, d, 8, 16).select("vec_id", "g", F.transform("b", lambda v: F.greatest(F.least(v + 100, F.lit(255)), F.lit(0))).alias("p"), F.expr("CAST((vec_id + g * 3) % 52 AS INT)").alias("qp"), F.expr("CAST(vec_id % 5 AS INT)").alias("bs"))
    return x.select("vec_id", "g", B.joined(B.edge_filtered(F.col("p"), F.col("qp"), F.lit(4), F.lit(-2), F.col("bs"))).alias("edge"))


@_query(f"WITH {_blocks_sql(4, 64)} SELECT vec_id, g, len(list_filter(b, lambda v: v <> 0)) > 0 AS coded FROM x")
def any_nonzero(spark: SparkSession, d: str) -> DataFrame:
    return _blocks(spark, d, 4, 64).select("vec_id", "g", B.countable(F.col("b")).alias("coded"))


@_query("WITH x AS (SELECT vec_id, list_transform(embedding, lambda e: CAST(e AS DOUBLE)) AS e FROM embeddings), o AS (SELECT vec_id, unnest(e) AS v, unnest(range(len(e))) AS i FROM x), r AS (SELECT vec_id, i, row_number() OVER (PARTITION BY vec_id ORDER BY v, i) - 1 AS k FROM o) SELECT vec_id, string_agg(k, ',' ORDER BY i) AS places FROM r GROUP BY vec_id")
def inverse_map(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "embeddings", "vec_id", "embedding")
    ordered = F.transform(F.array_sort(F.transform("embedding", lambda v, i: F.struct(v.cast("double").alias("v"), i.cast("bigint").alias("i")))), lambda s: s["i"])
    return e.select("vec_id", B.joined(B.inverse_map(ordered)).alias("places"))


# --- units of byte streams --------------------------------------------------------------------

_HEX = "'0123456789ABCDEF'"


@_query(f"WITH x AS (SELECT doc_id, (instr({_HEX}, substr(hex(encode(text)), 1, 1)) - 1) * 16 + instr({_HEX}, substr(hex(encode(text)), 2, 1)) - 1 AS b FROM documents WHERE length(text) > 0) SELECT doc_id, CAST(b >> 7 AS BIGINT) AS forbidden, CAST((b >> 5) & 3 AS BIGINT) AS ref_idc, CAST(b & 31 AS BIGINT) AS nal_type FROM x")
def nal_header(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents", "doc_id", "text").where("length(text) > 0").select("doc_id", F.encode("text", "UTF-8").alias("bytes"))
    return U.unit_headers(docs, "bytes").select("doc_id", "forbidden", "ref_idc", "nal_type")


@_query("""WITH x AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda u: rtrim(u, ' ')), lambda u: length(u) > 0) AS u FROM documents),
y AS (SELECT doc_id, unnest(u) AS unit, unnest(range(1, len(u) + 1)) AS i FROM x) SELECT doc_id, i - 1 AS unit_idx, CAST(strlen(unit) AS BIGINT) AS bytes, md5(unit) AS digest FROM y""")
def annexb_split(spark: SparkSession, d: str) -> DataFrame:
    units = U.split_units(read(spark, d, "documents", "doc_id", "text"), "text", "\n")
    return units.select("doc_id", "unit_idx", F.octet_length("unit").cast("bigint").alias("bytes"), F.md5(F.col("unit").cast("binary")).alias("digest"))


@_query("""WITH x AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda u: rtrim(u, ' ')), lambda u: length(u) > 0) AS u FROM documents)
SELECT doc_id, len(u) AS units, md5(array_to_string(list_transform(u, lambda v: '|' || v), '')) AS digest FROM x WHERE len(u) > 0""")
def annexb_join(spark: SparkSession, d: str) -> DataFrame:
    units = U.split_units(read(spark, d, "documents", "doc_id", "text"), "text", "\n")
    return U.join_units(units, ["doc_id"], "|").select("doc_id", "units", F.md5(F.col("stream").cast("binary")).alias("digest"))


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """The presentation timeline: order, duration, group of pictures and reorder occupancy of every sample."""
    g = _groups(stored_timed(spark, d, before=prefix(F.expr(_STARTS))))
    return T.presentation_timeline(g, "user_id", TIMESCALE).select("user_id", "pos", "idx", "event_id", "dts", "pts", "ticks", "duration_ns", "gop", "held")


# --- containers -------------------------------------------------------------------------------

_FILE_SQL = """f AS (SELECT user_id || '-' || strftime(ts, '%Y%m') AS path, event_id, ts, event_type, props, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k FROM events),
i AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY ts, event_id) - 1 AS idx, 100 + k % 7 * 10 AS delta, (k % 5 - 1) * 150 AS shift, event_type = 'signup' AS sync,
  CAST(5 + strlen(props) + CASE WHEN event_type = 'signup' THEN 5 ELSE 0 END AS BIGINT) AS size FROM f),
m AS (SELECT *, CAST(32 + COALESCE(sum(size) OVER (PARTITION BY path ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset",
  CAST(COALESCE(sum(delta) OVER (PARTITION BY path ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS dts FROM i)"""


def _files(spark: SparkSession, d: str) -> DataFrame:
    """An MP4 of the events of each user and month. A sign-up is a sync sample of a parameter set and an IDR slice, others hold a slice."""
    e = read(spark, d, "events", "user_id", "event_id", "ts", "event_type", "props")
    e = e.withColumn("file", F.concat_ws("-", "user_id", F.date_format("ts", "yyyyMM"))).withColumn("k", F.regexp_extract("props", "([0-9]+)", 1).cast("bigint"))
    e = e.withColumn("idx", (F.row_number().over(Window.partitionBy("file").orderBy("ts", "event_id")) - 1).cast("bigint"))
    sync = F.col("event_type") == "signup"
    slice_ = C.big_endian("1 + octet_length(props)", 4)
    data = f"CASE WHEN event_type = 'signup' THEN concat({C.big_endian('1', 4)}, unhex('67'), {slice_}, unhex('65'), CAST(props AS BINARY)) ELSE concat({slice_}, unhex('41'), CAST(props AS BINARY)) END"
    rows = e.select("file", "idx", (100 + F.col("k") % 7 * 10).cast("bigint").alias("delta"), ((F.col("k") % 5 - 1) * 150).cast("bigint").alias("shift"), sync.alias("sync"), F.expr(data).alias("data"))
    return stored(C.mux(rows, "file", TIMESCALE, 640, 480), "files")


@_query(f"""WITH {_FILE_SQL} SELECT path || '#0' AS track, idx AS sample_idx, "offset", size, dts, dts + shift AS pts, delta AS duration, CAST(1 AS BIGINT) AS description_index, sync AS is_sync FROM m""")
def container_samples(spark: SparkSession, d: str) -> DataFrame:
    return C.samples(C.tracks(C.boxes(_files(spark, d))))


@_query(f"""WITH {_FILE_SQL}, q AS (SELECT *, dts + shift AS pts FROM m) SELECT path || '#0' AS track, idx, pts, row_number() OVER w - 1 AS pos,
CASE WHEN lead(pts) OVER w - pts > 0 THEN lead(pts) OVER w - pts ELSE delta END * 1000000000 // {TIMESCALE} AS duration_ns, sync AS is_sync, "offset", size FROM q WINDOW w AS (PARTITION BY path ORDER BY pts, idx)""")
def container_timeline(spark: SparkSession, d: str) -> DataFrame:
    s = C.samples(C.tracks(C.boxes(_files(spark, d)))).withColumnRenamed("sample_idx", "idx").withColumnRenamed("duration", "delta")
    p = T.presentation_timeline(stored(s, "samples"), "track", TIMESCALE)
    return p.select("track", "idx", "pts", "pos", "duration_ns", "is_sync", "offset", "size")


@_query(f"""WITH {_FILE_SQL} SELECT path, CAST(0 AS INTEGER) AS trak, CAST(1 AS BIGINT) AS track_id, 'vide' AS handler, CAST({TIMESCALE} AS BIGINT) AS timescale, CAST(sum(delta) AS BIGINT) AS duration,
CAST(640 AS BIGINT) AS width, CAST(480 AS BIGINT) AS height, CAST(1 AS BIGINT) AS entries, 'avc1' AS format FROM m GROUP BY path""")
def container_tracks(spark: SparkSession, d: str) -> DataFrame:
    return C.tracks(C.boxes(_files(spark, d))).select("path", "trak", "track_id", "handler", "timescale", "duration", "width", "height", "entries", "format")


@_query(f"""WITH {_FILE_SQL}, u AS (SELECT path, idx, CAST(0 AS BIGINT) AS unit_idx, 3 AS r, 7 AS t, 1 AS b FROM m WHERE sync UNION ALL SELECT path, idx, CASE WHEN sync THEN 1 ELSE 0 END, CASE WHEN sync THEN 3 ELSE 2 END, CASE WHEN sync THEN 5 ELSE 1 END, 1 + strlen(props) FROM m)
SELECT path || '#0' AS track, idx AS sample_idx, CAST(unit_idx AS BIGINT) AS unit_idx, CAST(r AS BIGINT) AS ref_idc, CAST(t AS BIGINT) AS nal_type, CAST(b AS BIGINT) AS bytes, CAST(NULL AS VARCHAR) AS error FROM u""")
def container_units(spark: SparkSession, d: str) -> DataFrame:
    files = _files(spark, d)
    t = C.tracks(C.boxes(files))
    return C.units(files, C.samples(t), C.length_sizes(t))


#: The boxes of a file by what they hold: (path of the box, bytes of its payload; n samples, c chunks, st steps of the chunk table, s sync samples). A table's payload has eight bytes before its rows.
_BOX_TREE = {
    "/moov/mvhd": "100", "/moov/trak/tkhd": "84", "/moov/trak/mdia/mdhd": "24", "/moov/trak/mdia/hdlr": "25", "/moov/trak/mdia/minf/stbl/stsd": "8 + 8 + 78 + 8 + 5", "/moov/trak/mdia/minf/stbl/stts": "8 + 8 * n",
    "/moov/trak/mdia/minf/stbl/ctts": "8 + 8 * n", "/moov/trak/mdia/minf/stbl/stsc": "8 + 12 * st", "/moov/trak/mdia/minf/stbl/stsz": "12 + 4 * n", "/moov/trak/mdia/minf/stbl/stco": "8 + 4 * c", "/moov/trak/mdia/minf/stbl/stss": "8 + 4 * s",
}


def _boxes_sql() -> str:
    """Every box of the written files: sizes from the leaves up, offsets in the order of writing."""
    order = ["/moov", "/moov/mvhd", "/moov/trak", "/moov/trak/tkhd", "/moov/trak/mdia", "/moov/trak/mdia/mdhd", "/moov/trak/mdia/hdlr", "/moov/trak/mdia/minf", "/moov/trak/mdia/minf/stbl", *[k for k in _BOX_TREE if "/stbl/" in k]]
    size = {k: f"(8 + {v})" for k, v in _BOX_TREE.items()}
    for k in sorted((k for k in order if k not in size), key=lambda k: -k.count("/")):
        size[k] = "(8 + " + " + ".join(size[x] for x in order if x.rpartition("/")[0] == k) + ")"
    rows, at = ["('/ftyp', 0, 24)", "('/mdat', 24, media + 8)"], "media + 32"
    for k in order:
        rows.append(f"('{k}', {at}, {size[k]})")
        at += " + " + ("8" if k not in _BOX_TREE else size[k])
    return "[" + ", ".join(f"{{'b': {r[1:-1].split(', ', 2)[0]}, 'o': CAST({r[1:-1].split(', ', 2)[1]} AS BIGINT), 's': CAST({r[1:-1].split(', ', 2)[2]} AS BIGINT)}}" for r in rows) + "]"


def _boxes_query() -> str:
    return f"""WITH {_FILE_SQL}, q AS (SELECT path, count(*) AS n, CAST(sum(size) AS BIGINT) AS media, (count(*) + 2) // 3 AS c, CASE WHEN count(*) % 3 = 0 OR count(*) < 3 THEN 1 ELSE 2 END AS st, count(*) FILTER (WHERE sync) AS s FROM m GROUP BY path),
u AS (SELECT path, unnest({_boxes_sql()}) AS x FROM q)
SELECT path, CAST(CASE WHEN x.b LIKE '/moov/trak%' THEN 0 ELSE -1 END AS INTEGER) AS trak, x.b AS box_path, CAST(length(x.b) - length(replace(x.b, '/', '')) - 1 AS INTEGER) AS depth, right(x.b, 4) AS type, x.o AS "offset", x.s AS size, CAST(NULL AS VARCHAR) AS error FROM u"""


@_query(_boxes_query())
def container_boxes(spark: SparkSession, d: str) -> DataFrame:
    """Every box, at every depth."""
    return C.boxes(_files(spark, d)).select("path", "trak", "box_path", "depth", "type", "offset", "size", "error")


@_query(f"""WITH {_FILE_SQL} SELECT DISTINCT path, 'isom' AS major, CAST(512 AS BIGINT) AS minor, 'isom,mp42' AS compatible, CAST(NULL AS VARCHAR) AS error FROM m""")
def container_brands(spark: SparkSession, d: str) -> DataFrame:
    return C.brands(C.boxes(_files(spark, d))).withColumn("compatible", F.array_join("compatible", ","))


@_query(f"""WITH {_FILE_SQL} SELECT DISTINCT path, CAST(1 AS BIGINT) AS description_index, 'avc1' AS format, CAST(640 AS BIGINT) AS width, CAST(480 AS BIGINT) AS height, 'avcC' AS config_type, CAST(5 AS BIGINT) AS config_bytes, CAST(NULL AS VARCHAR) AS error FROM m""")
def container_decoders(spark: SparkSession, d: str) -> DataFrame:
    t = C.decoders(C.tracks(C.boxes(_files(spark, d))))
    return t.select("path", "description_index", "format", "width", "height", "config_type", F.length("config").cast("bigint").alias("config_bytes"), "error")


@_query(f"""WITH {_FILE_SQL}, c AS (SELECT path, count(*) AS n FROM m GROUP BY path)
SELECT path, CASE n % 6 WHEN 0 THEN 'stts box has a zero count' WHEN 1 THEN 'stsc box does not begin at the first chunk' WHEN 2 THEN 'timescale is zero' WHEN 3 THEN 'stsz box has a wrong length' WHEN 4 THEN 'track has no handler' END AS error FROM c""")
def container_errors(spark: SparkSession, d: str) -> DataFrame:
    """Files of which five in six are broken, each by its number of samples."""
    f = _files(spark, d)
    e = read(spark, d, "events", "user_id", "ts").select(F.concat_ws("-", "user_id", F.date_format("ts", "yyyyMM")).alias("path")).groupBy("path").count()
    kind = lambda k: k.encode().hex().upper()
    # what stands behind a box's name, and what takes its place
    breaks = [(kind("stts") + "0{8}.{8}", "0{8}[1-9]|00000001", "00000000"), (kind("stsc") + "0{8}.{8}", "00000001", "00000002"), (kind("mdhd") + "0{24}", ".{8}", "00000000"), (kind("stsz") + "0{16}", ".{8}", "00FFFFFF"), (kind("hdlr") + "0{16}", kind("vide"), "00000000")]
    broken = F.hex("content")
    for k, (before, there, instead) in enumerate(breaks):
        broken = F.when(F.col("count") % 6 == k, F.regexp_replace(F.hex("content"), f"({before})(?:{there})", f"$1{instead}")).otherwise(broken)
    files = f.join(e, "path").select("path", F.unhex(broken).alias("content"))
    return C.tracks(C.boxes(stored(files, "broken"))).select("path", C.track_error().alias("error"))


# --- parameter sets -----------------------------------------------------------------------------


_SPS_SQL = """x AS (SELECT *, p_partkey % 3 = 0 AS high, p_partkey // 3 AS h, p_partkey % 4 AS kind FROM part),
y AS (SELECT *, CASE WHEN high THEN h % 4 ELSE 1 END AS chroma, high AND h % 4 = 3 AND h // 4 % 2 = 1 AS planes FROM x)"""


@_query(f"""WITH {_SPS_SQL} SELECT p_partkey, CAST(p_partkey % 32 AS BIGINT) AS sps_id, CAST(CASE WHEN high THEN 100 ELSE 66 END AS BIGINT) AS profile, CAST(p_size AS BIGINT) AS level, 4 + p_partkey % 9 AS log2_max_frame_num,
CASE WHEN kind = 3 THEN 0 ELSE kind END AS poc_type, CASE WHEN kind IN (0, 3) THEN 4 + p_partkey % 7 ELSE 0 END AS log2_max_poc, p_partkey % 5 AS max_refs, true AS frame_mbs_only, 16 * (1 + p_partkey % 120) AS coded_width, 16 * (1 + p_partkey % 70) AS coded_height,
16 * (1 + p_partkey % 120) - CASE WHEN chroma IN (1, 2) THEN 2 ELSE 1 END * (p_partkey % 4) AS width, 16 * (1 + p_partkey % 70) - CASE WHEN chroma = 1 THEN 2 ELSE 1 END * (p_partkey % 3) AS height,
CAST(chroma AS BIGINT) AS chroma_format, CAST(CASE WHEN high THEN 8 + h % 3 ELSE 8 END AS BIGINT) AS bit_depth, planes AS separate_planes, kind = 1 AND p_partkey // 4 % 2 = 1 AS poc_always_zero, CAST(NULL AS VARCHAR) AS error FROM y""")
def sequence_sets(spark: SparkSession, d: str) -> DataFrame:
    """Sequence sets of parts: two profiles, all chroma formats, depths of 8 to 10, scaling lists, and all three kinds of picture order."""
    h = "p_partkey div 3"
    lists = f"CASE WHEN {h} % 5 = 0 THEN concat('11', repeat('1', 16), repeat('0', CASE WHEN {h} % 4 = 3 THEN 11 ELSE 7 END)) ELSE '0' END"
    high = f"concat({S.ue(f'{h} % 4')}, CASE WHEN {h} % 4 = 3 THEN {S.fixed(f'{h} div 4 % 2', 1)} ELSE '' END, {S.ue(f'{h} % 3')}, {S.ue('0')}, '0', {lists})"
    cycle = f"concat({S.ue('p_partkey % 3')}, repeat({S.se('(p_partkey % 9 - 4)')}, CAST(p_partkey % 3 AS INT)))"
    order = f"CASE p_partkey % 4 WHEN 1 THEN concat({S.ue('1')}, {S.fixed('p_partkey div 4 % 2', 1)}, {S.se('(p_partkey % 7 - 3)')}, {S.se('2')}, {cycle}) WHEN 2 THEN {S.ue('2')} ELSE concat({S.ue('0')}, {S.ue('p_partkey % 7')}) END"
    bits = [S.fixed("CASE WHEN p_partkey % 3 = 0 THEN 100 ELSE 66 END", 8), S.fixed("0", 8), S.fixed("p_size", 8), S.ue("p_partkey % 32"), f"CASE WHEN p_partkey % 3 = 0 THEN {high} ELSE '' END"]
    bits += [S.ue("p_partkey % 9"), order, S.ue("p_partkey % 5"), "'0'", S.ue("p_partkey % 120"), S.ue("p_partkey % 70"), "'1'", "'1'", "'1'", S.ue("0"), S.ue("p_partkey % 4"), S.ue("0"), S.ue("p_partkey % 3"), "'0'"]
    units = read(spark, d, "part", "p_partkey", "p_size").selectExpr("p_partkey", f"concat(unhex('67'), {S.payload(f'concat({', '.join(bits)})')}) AS unit")
    return P.parsed(units, "p_partkey", "unit", "sps")


@_query("""SELECT p_partkey, p_partkey % 256 AS pps_id, p_partkey % 32 AS sps_id, p_partkey % 2 = 1 AS cabac, CAST(CASE WHEN p_partkey % 11 = 0 THEN 2 ELSE 1 END AS BIGINT) AS slice_groups, 1 + p_partkey % 4 AS refs_l0, 1 + p_partkey % 3 AS refs_l1, p_partkey % 5 = 0 AS weighted_pred,
p_partkey % 3 AS weighted_bipred, CAST(p_size AS BIGINT) AS init_qp, 26 + p_partkey % 7 - 3 AS init_qs, p_partkey % 25 - 12 AS chroma_qp_offset, p_partkey % 7 <> 0 AS deblocking_control, p_partkey % 2 = 0 AS constrained_intra,
p_partkey % 3 = 1 AS bottom_order, p_partkey % 4 = 3 AS redundant_counts, CAST(NULL AS VARCHAR) AS error FROM part""")
def picture_sets(spark: SparkSession, d: str) -> DataFrame:
    """Picture sets of parts; one in eleven has two slice groups, of each kind of map in turn."""
    flag = lambda test: f"CASE WHEN {test} THEN '1' ELSE '0' END"
    kinds = [f"concat({S.ue('0')}, {S.ue('3')}, {S.ue('5')})", S.ue("1"), f"concat({S.ue('2')}, {S.ue('4')}, {S.ue('9')})", *[f"concat({S.ue(k)}, '1', {S.ue('6')})" for k in "345"], f"concat({S.ue('6')}, {S.ue('3')}, '0110')"]
    groups = f"CASE WHEN p_partkey % 11 > 0 THEN {S.ue('0')} ELSE concat({S.ue('1')}, CASE p_partkey div 11 % 7 {' '.join(f'WHEN {k} THEN {x}' for k, x in enumerate(kinds))} END) END"
    bits = [S.ue("p_partkey % 256"), S.ue("p_partkey % 32"), S.fixed("p_partkey % 2", 1), flag("p_partkey % 3 = 1"), groups, S.ue("p_partkey % 4"), S.ue("p_partkey % 3"), flag("p_partkey % 5 = 0"), S.fixed("p_partkey % 3", 2)]
    bits += [S.se("(p_size - 26)"), S.se("(p_partkey % 7 - 3)"), S.se("(p_partkey % 25 - 12)"), flag("p_partkey % 7 <> 0"), S.fixed("1 - p_partkey % 2", 1), flag("p_partkey % 4 = 3")]
    units = read(spark, d, "part", "p_partkey", "p_size").selectExpr("p_partkey", f"concat(unhex('68'), {S.payload(f'concat({', '.join(bits)})')}) AS unit")
    return P.parsed(units, "p_partkey", "unit", "pps")


# --- streams ------------------------------------------------------------------------------------


@_query("""WITH s AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS idx FROM events),
g AS (SELECT *, last_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS) OVER w AS set_id, last_value(CASE WHEN event_type = 'signup' THEN idx END IGNORE NULLS) OVER w AS start FROM s WINDOW w AS (PARTITION BY user_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT user_id, event_id, set_id, concat_ws(',', """ + ", ".join(f"CASE WHEN idx - {k} >= COALESCE(start, 1) THEN CAST(lag(event_id, {k}) OVER (PARTITION BY user_id ORDER BY idx) AS VARCHAR) END" for k in range(1, 5)) + ") AS refs FROM g")
def stream_decoder_state(spark: SparkSession, d: str) -> DataFrame:
    return D.decoder_rows(spark, d)


# --- units as bytes ---------------------------------------------------------------------------

_ZERO, _ONE = "decode(unhex('00'), 'UTF-8')", "decode(unhex('01'), 'UTF-8')"


def _streams(spark: SparkSession, d: str) -> DataFrame:
    """Each document's lines as units behind start codes, four bytes for the first and three for the others; an A before each line but in every tenth document."""
    docs = read(spark, d, "documents", "doc_id", "text")
    mark = "CASE WHEN doc_id % 10 = 0 THEN '' ELSE 'A' END"
    return docs.selectExpr("doc_id", f"encode(concat({_ZERO}, {_ZERO}, {_ZERO}, {_ONE}, {mark}, replace(text, '\n', concat({_ZERO}, {_ZERO}, {_ONE}, {mark}))), 'UTF-8') AS stream")


_LINES_SQL = f"""l AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda u: CASE WHEN doc_id % 10 = 0 THEN '' ELSE 'A' END || u), lambda u: length(u) > 0) AS u FROM documents),
c AS (SELECT doc_id, u, list_transform(u, lambda v: (instr({_HEX}, substr(hex(encode(v)), 1, 1)) - 1) * 16 + instr({_HEX}, substr(hex(encode(v)), 2, 1)) - 1) AS b FROM l),
e AS (SELECT doc_id, u, b, CASE WHEN u IS NULL THEN 'stream is null' WHEN len(u) = 0 THEN 'stream has no units' ELSE
  list_extract(list_filter(list_transform(b, lambda x: CASE WHEN x >= 128 THEN 'forbidden bit is set' WHEN x % 32 = 0 THEN 'unit type is zero' END), lambda x: x IS NOT NULL), 1) END AS error FROM c)"""


@_query(f"""WITH {_LINES_SQL}, g AS (SELECT doc_id, unnest(u) AS unit, unnest(b) AS b, unnest(range(len(u))) AS i FROM e WHERE error IS NULL)
SELECT doc_id, i AS unit_idx, CAST(strlen(unit) AS BIGINT) AS bytes, CAST(b >> 5 & 3 AS BIGINT) AS ref_idc, CAST(b & 31 AS BIGINT) AS nal_type, CAST(NULL AS VARCHAR) AS error FROM g
UNION ALL SELECT doc_id, NULL, NULL, NULL, NULL, error FROM e WHERE error IS NOT NULL""")
def annexb_units(spark: SparkSession, d: str) -> DataFrame:
    units = U.unit_headers(U.split_bytes(_streams(spark, d), ["doc_id"], "stream"), "unit")
    return units.select("doc_id", "unit_idx", F.octet_length("unit").cast("bigint").alias("bytes"), "ref_idc", "nal_type", "error")


@_query(f"""WITH {_LINES_SQL} SELECT doc_id, len(u) AS units, md5(array_to_string(list_transform(u, lambda v: '00000001' || hex(encode(v))), '')) AS digest FROM e WHERE error IS NULL""")
def annexb_stream(spark: SparkSession, d: str) -> DataFrame:
    units = U.split_bytes(_streams(spark, d), ["doc_id"], "stream").where("error IS NULL")
    return U.join_bytes(units, ["doc_id"]).select("doc_id", "units", F.md5(F.hex("stream").cast("binary")).alias("digest"))


@_query(f"""WITH x AS (SELECT doc_id, CASE WHEN length(text) > 0 THEN (instr({_HEX}, substr(hex(encode(text)), 1, 1)) - 1) * 16 + instr({_HEX}, substr(hex(encode(text)), 2, 1)) - 1 END AS b FROM documents)
SELECT doc_id, CASE WHEN b IS NULL THEN 'unit is empty' WHEN b >= 128 THEN 'forbidden bit is set' WHEN b % 32 = 0 THEN 'unit type is zero' END AS error FROM x""")
def nal_validity(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents", "doc_id", "text").select("doc_id", F.encode("text", "UTF-8").alias("bytes"))
    return U.unit_headers(docs, "bytes").select("doc_id", U.header_error().alias("error"))


_CONFIG_ERROR = "CASE WHEN p_partkey % 11 = 0 THEN 'configuration of version 2' WHEN p_partkey % 4 = 2 THEN 'length of 3 bytes' WHEN p_partkey % 13 = 0 THEN 'parameter set is empty or cut short' END"


@_query(f"""WITH x AS (SELECT *, {_CONFIG_ERROR} AS error FROM part) SELECT p_partkey, CASE WHEN error IS NULL THEN p_partkey % 256 END AS profile, CASE WHEN error IS NULL THEN CAST(p_size AS BIGINT) END AS level,
CASE WHEN error IS NULL THEN p_partkey % 4 + 1 END AS length_size, CASE WHEN error IS NULL THEN '67' || md5(p_name) END AS sequence_set, CASE WHEN error IS NULL THEN p_partkey % 3 END AS pictures, CASE WHEN error IS NULL THEN 'FF' END AS trailing, error FROM x""")
def avc_configs(spark: SparkSession, d: str) -> DataFrame:
    u = C.big_endian
    sps = "concat(unhex('67'), unhex(md5(p_name)))"
    body = f"concat({u('CASE WHEN p_partkey % 11 = 0 THEN 2 ELSE 1 END', 1)}, {u('p_partkey', 1)}, unhex('00'), {u('p_size', 1)}, {u('252 + p_partkey % 4', 1)}, unhex('E1'), {u('CASE WHEN p_partkey % 13 = 0 THEN 9999 ELSE 17 END', 2)}, {sps}, {u('p_partkey % 3', 1)}, unhex(repeat('000268AA', CAST(p_partkey % 3 AS INT))), unhex('FF'))"
    rows = read(spark, d, "part", "p_partkey", "p_size", "p_name").selectExpr("p_partkey", f"{body} AS data")
    c = U.configurations(rows, ["p_partkey"], "data")
    return c.select("p_partkey", "profile", "level", "length_size", F.concat(F.lit("67"), F.lower(F.hex(F.substring(F.get("sequence_sets", F.lit(0)), 2, 16)))).alias("sequence_set"), F.when(F.col("error").isNull(), F.size("picture_sets")).cast("bigint").alias("pictures"), F.hex("trailing").alias("trailing"), "error")


# --- slices and the sets that they refer to -----------------------------------------------------


def _slice_units(spark: SparkSession, d: str, *carried: str) -> DataFrame:
    """Units of a track a user. Configuration sets stand at sample -1; a sign-up brings new ones behind its IDR slice, other events hold a slice of any type, some with explicit weights and some for arithmetic coding.

    Set ids are by user; what a set says is by version, 0 at first and then the sign-up's idx; a slice is written by the version in force. carried columns of the samples come along; configuration sets have nulls there.
    """
    e = samples(spark, d, since=latest(F.expr("CASE WHEN event_type = 'signup' THEN 0 END")), version=latest(F.expr("CASE WHEN event_type = 'signup' THEN event_id END")))
    e = stored(e.selectExpr("user_id", "idx", "k", "event_type = 'signup' AS idr", "coalesce(version, 0) AS v", *carried), "slices")
    sps_bits = [S.fixed("66", 8), S.fixed("0", 8), S.fixed("30", 8), S.ue("user_id % 4"), S.ue("v % 9"), S.ue("0"), S.ue("v % 7"), S.ue("4"), "'0'", S.ue("19"), S.ue("9"), "'1'", "'1'", "'0'", "'0'"]
    pps_bits = [S.ue("user_id % 8"), S.ue("user_id % 4"), S.fixed("v % 2", 1), "'0'", S.ue("0"), S.ue("1"), S.ue("0"), S.fixed("CASE WHEN v % 5 = 0 THEN 1 ELSE 0 END", 1), S.fixed("v % 3", 2), S.se("(v % 13 - 6)"), S.se("0"), S.se("0"), "'1'", "'0'", "'0'"]
    kind = "(CASE WHEN idr THEN 2 ELSE k % 5 END)"  # P, B, I, SP, SI
    inter = f"({kind} IN (0, 1, 3))"
    moves = lambda test, idc, value: f"CASE WHEN {test} THEN concat('1', {S.ue(idc)}, {S.ue(value)}, {S.ue('3')}) ELSE '0' END"
    luma = f"CASE WHEN i % 2 = 0 THEN concat('1', {S.se('(k % 9 - 4)')}, {S.se('2')}) ELSE '0' END"
    chroma = f"CASE WHEN i = 0 AND k % 2 = 0 THEN concat('1', {S.se('1')}, {S.se('(-1)')}, {S.se('2')}, {S.se('(-2)')}) ELSE '0' END"
    entries = lambda n: f"array_join(transform(sequence(0, CAST({n} AS INT) - 1), i -> concat({luma}, {chroma})), '')"
    weighted = f"((v % 5 = 0 AND {kind} IN (0, 3)) OR (v % 3 = 1 AND {kind} = 1))"
    slice_bits = [
        S.ue("k % 50"), S.ue(f"(CASE WHEN idr THEN 7 ELSE {kind} + k % 2 * 5 END)"), S.ue("user_id % 8"), f"right(lpad(bin(idx % 16), 64, '0'), CAST(4 + v % 9 AS INT))",
        f"CASE WHEN idr THEN {S.ue('k % 7')} ELSE '' END", "right(lpad(bin(idx % 16), 64, '0'), CAST(4 + v % 7 AS INT))",
        f"CASE WHEN {kind} = 1 THEN {S.fixed('k % 2', 1)} ELSE '' END",
        f"CASE WHEN {inter} THEN concat('1', {S.ue('k % 4')}, CASE WHEN {kind} = 1 THEN {S.ue('k % 3')} ELSE '' END, {moves('k % 2 = 1', '0', 'k % 5')}, CASE WHEN {kind} = 1 THEN {moves('k % 7 = 1', '1', '3')} ELSE '' END) ELSE '' END",
        f"CASE WHEN {weighted} THEN concat({S.ue('k % 6')}, {S.ue('k % 4')}, {entries('(k % 4 + 1)')}, CASE WHEN {kind} = 1 THEN {entries('(k % 3 + 1)')} ELSE '' END) ELSE '' END",
        f"CASE WHEN idr THEN concat('0', {S.fixed('k % 2', 1)}) WHEN k % 4 = 0 THEN concat('1', {S.ue('1')}, {S.ue('k % 3')}, {S.ue('0')}) ELSE '0' END",
        f"CASE WHEN {inter} AND v % 2 = 1 THEN {S.ue('k % 3')} ELSE '' END", S.se("(k % 9 - 4)"), f"CASE WHEN {kind} = 3 THEN '1' ELSE '' END", f"CASE WHEN {kind} IN (3, 4) THEN {S.se('(k % 5 - 2)')} ELSE '' END",
        S.ue("k % 3"), f"CASE WHEN k % 3 <> 1 THEN concat({S.se('(k % 7 - 3)')}, {S.se('0')}) ELSE '' END", "CASE WHEN k % 4 < 2 THEN '' WHEN k % 4 = 2 THEN '0000' ELSE '10110001000000001' END",
    ]
    # an outer explode, as for a plain one Spark adds a filter that makes the sets of every row
    made = lambda head, bits: f"concat({head}, {S.payload(f'concat({', '.join(bits)})')})"
    sets = lambda rows, at: rows.select("user_id", F.lit(-1).cast("bigint").alias("sample_idx") if at is None else F.col(at).alias("sample_idx"), F.expr(f"array({made("unhex('67')", sps_bits)}, {made("unhex('68')", pps_bits)})").alias("u"), *carried).select("user_id", "sample_idx", F.posexplode_outer("u").alias("unit_idx", "unit"), *carried)
    kinds = dict(e.dtypes)
    first = sets(e.select("user_id").distinct().withColumns({"v": F.lit(0).cast("bigint")} | {c: F.lit(None).cast(kinds[c]) for c in carried}), None)
    inband = sets(e.where("idr"), "idx").withColumn("unit_idx", F.col("unit_idx") + 1)
    slices = e.selectExpr("user_id", "idx AS sample_idx", "0 AS unit_idx", f"{made("CASE WHEN idr THEN unhex('65') ELSE unhex('41') END", slice_bits)} AS unit", *carried)
    return stored(first.unionByName(inband).unionByName(slices).withColumn("unit_idx", F.col("unit_idx").cast("bigint")), "units")


_SLICE_SQL = f"""{SAMPLES_SQL}, v AS (SELECT user_id, idx, k, event_type = 'signup' AS idr, COALESCE(last_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS) OVER w, 0) AS v,
  COALESCE(last_value(CASE WHEN event_type = 'signup' THEN idx END IGNORE NULLS) OVER w, -1) AS since FROM s WINDOW w AS (PARTITION BY user_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""


@_query(f"""WITH {_SLICE_SQL}, t AS (SELECT *, CASE WHEN idr THEN 2 ELSE k % 5 END AS t FROM v), w AS (SELECT *, t IN (0, 1, 3) AS inter, (v % 5 = 0 AND t IN (0, 3)) OR (v % 3 = 1 AND t = 1) AS weighted, k % 4 + 1 AS n0, CASE WHEN t = 1 THEN k % 3 + 1 ELSE 0 END AS n1 FROM t)
SELECT user_id, idx AS sample_idx, user_id % 8 AS pps_id, user_id % 4 AS sps_id, k % 50 AS first_mb, list_extract(['P', 'B', 'I', 'SP', 'SI'], CAST(t + 1 AS INTEGER)) AS slice_type, idr OR k % 2 = 1 AS all_same_type, idx % 16 AS frame_num, idx % 16 AS poc_lsb, CASE WHEN idr THEN k % 7 ELSE 0 END AS idr_pic_id,
t = 1 AND k % 2 = 1 AS direct_spatial, CASE WHEN inter THEN n0 ELSE 2 END AS active_l0, CASE WHEN t = 1 THEN n1 ELSE 1 END AS active_l1, CAST(CASE WHEN inter AND k % 2 = 1 THEN 1 ELSE 0 END + CASE WHEN t = 1 AND k % 7 = 1 THEN 1 ELSE 0 END AS BIGINT) AS modifications,
CAST(CASE WHEN weighted THEN n0 + n1 ELSE 0 END AS BIGINT) AS weights, CAST(CASE WHEN weighted THEN ((n0 + 1) // 2 + (n1 + 1) // 2) * (k % 9 - 4) + (n0 // 2 + n1 // 2) * (1 << (k % 6)) ELSE 0 END AS BIGINT) AS luma_sum,
CAST(CASE WHEN weighted THEN (n0 + n1) * (1 << (k % 4)) + CASE WHEN k % 2 = 0 THEN CASE WHEN t = 1 THEN 2 ELSE 1 END * (1 - (1 << (k % 4))) ELSE 0 END ELSE 0 END AS BIGINT) AS cb_sum,
CAST(CASE WHEN NOT idr AND k % 4 = 0 THEN 1 ELSE 0 END AS BIGINT) AS marking, CASE WHEN inter AND v % 2 = 1 THEN k % 3 ELSE 0 END AS cabac_init, 26 + v % 13 - 6 + k % 9 - 4 AS qp, CASE WHEN t IN (3, 4) THEN 26 + k % 5 - 2 ELSE 0 END AS qs,
k % 3 AS deblocking_off, CASE WHEN k % 3 <> 1 THEN 2 * (k % 7 - 3) ELSE 0 END AS alpha_offset, k % 4 >= 2 AS has_data, CAST(NULL AS VARCHAR) AS error FROM w""")
def slice_headers(spark: SparkSession, d: str) -> DataFrame:
    h = P.slice_headers(_slice_units(spark, d), "user_id")
    size, total = lambda c: F.size(c).cast("bigint").alias(c), lambda f: F.aggregate("weights", F.lit(0).cast("bigint"), lambda a, w: a + w[f])
    h = h.withColumns({"luma_sum": F.when(F.col("error").isNull(), total("luma")), "cb_sum": F.when(F.col("error").isNull(), total("cb"))})
    return h.select("user_id", "sample_idx", "pps_id", "sps_id", "first_mb", "slice_type", "all_same_type", "frame_num", "poc_lsb", "idr_pic_id", "direct_spatial", "active_l0", "active_l1", size("modifications"), size("weights"), "luma_sum", "cb_sum", size("marking"), "cabac_init", "qp", "qs", "deblocking_off", "alpha_offset", "has_data", "error")


@_query(f"WITH {_SLICE_SQL} SELECT user_id, idx AS sample_idx, user_id % 8 AS pps_id, since AS set_sample FROM v")
def slice_sets_asof(spark: SparkSession, d: str) -> DataFrame:
    found = P.parsed_units(_slice_units(spark, d), ["user_id", "sample_idx"], "unit").select("user_id", "sample_idx", "kind", "pps_id", "error")
    found = stored(found.where(F.col("kind") != P.SPS_UNIT), "parsed")
    pps = found.where((F.col("kind") == P.PPS_UNIT) & F.col("error").isNull())
    slices = found.where(F.col("kind") != P.PPS_UNIT).select("user_id", "sample_idx", "pps_id")
    return P.in_force(slices, pps, "user_id", "pps_id").select("user_id", "sample_idx", "pps_id", F.col("set").alias("set_sample"))


@_query(f"WITH {_SLICE_SQL} SELECT user_id, idx AS sample_idx, CAST(0 AS BIGINT) AS unit_idx, CAST(CASE WHEN idr THEN 5 ELSE 1 END AS BIGINT) AS nal_type FROM v")
def first_slices(spark: SparkSession, d: str) -> DataFrame:
    return U.first_slices(U.unit_headers(_slice_units(spark, d), "unit"), ["user_id", "sample_idx"])


# --- sets that lack, gates, buffers ---------------------------------------------------------------


def _sps_units(spark: SparkSession, d: str) -> DataFrame:
    """Sequence sets of parts: some interlaced, of other chroma formats or depths, some cropped beyond their size."""
    part = read(spark, d, "part", "p_partkey", "p_size")
    bits = [S.fixed("100", 8), S.fixed("0", 8), S.fixed("p_size", 8), S.ue("p_partkey % 32"), S.ue("p_partkey % 3"), S.ue("CASE WHEN p_partkey % 5 = 0 THEN 2 ELSE 0 END"), S.ue("0"), "'00'", S.ue("0"), S.ue("2"), S.ue("p_partkey % 5"), "'0'", S.ue("p_partkey % 12"), S.ue("3"), S.fixed("CASE WHEN p_partkey % 7 = 0 THEN 0 ELSE 1 END", 1)]
    bits += ["CASE WHEN p_partkey % 7 = 0 THEN '0' ELSE '' END", "'1'", "'1'", S.ue("CASE WHEN p_partkey % 13 = 0 THEN 200 ELSE 0 END"), S.ue("0"), S.ue("0"), S.ue("0"), "'0'"]
    return part.selectExpr("p_partkey", f"concat(unhex(CASE WHEN p_partkey % 17 = 0 THEN '68' ELSE '67' END), {S.payload(f'concat({', '.join(bits)})')}) AS unit")


@_query("""SELECT p_partkey, CASE WHEN p_partkey % 17 = 0 THEN 'unit of type 8' WHEN p_partkey % 13 = 0 AND (CASE WHEN p_partkey % 3 = 0 THEN 1 ELSE 2 END) * 200 >= 16 * (1 + p_partkey % 12) THEN 'crop exceeds the picture' WHEN p_partkey % 7 = 0 THEN 'interlaced' WHEN p_partkey % 3 <> 1 THEN 'chroma format' WHEN p_partkey % 5 = 0 THEN 'bit depth' END AS reason FROM part""")
def profile_gate(spark: SparkSession, d: str) -> DataFrame:
    return P.parsed(_sps_units(spark, d), "p_partkey", "unit", "sps").select("p_partkey", P.unsupported().alias("reason"))


@_query("""WITH s AS (SELECT DISTINCT p_partkey % 32 AS id FROM part WHERE p_size % 4 = 1 AND p_partkey % 32 < 20) SELECT p_partkey, p_partkey % 256 AS pps_id, p_partkey % 32 AS sps_id FROM part WHERE p_partkey % 32 NOT IN (SELECT id FROM s)""")
def orphan_sets(spark: SparkSession, d: str) -> DataFrame:
    sps = sequence_sets(spark, d).join(read(spark, d, "part", "p_partkey", "p_size"), "p_partkey").where("p_size % 4 = 1 AND sps_id < 20").select("sps_id").distinct()
    return P.orphans(picture_sets(spark, d), sps, []).select("p_partkey", "pps_id", "sps_id")


@_query("""WITH o AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS r FROM orders), l AS (SELECT o_custkey, list(struct_pack(id := o_orderkey, n := o_orderkey % 16, long := o_orderstatus = 'F', k := o_orderkey % 3) ORDER BY o_orderkey) AS l FROM o WHERE r <= 5 GROUP BY o_custkey),
a AS (SELECT o_custkey, l, list_filter(l, lambda p: NOT p.long AND p.n = (9 - o_custkey % 8 - 1 + 16) % 16)[1] AS t FROM l), b AS (SELECT o_custkey, CASE WHEN t IS NOT NULL THEN list_concat([t], list_filter(l, lambda p: p.id <> t.id)) END AS l FROM a),
c AS (SELECT o_custkey, l, list_filter(l, lambda p: p.long AND p.k = o_custkey % 3)[1] AS t FROM b), e AS (SELECT o_custkey, CASE WHEN t IS NOT NULL AND l IS NOT NULL THEN list_concat([l[1], t], list_filter(l[2:], lambda p: p.id <> t.id)) END AS l FROM c)
SELECT o_custkey, array_to_string(list_transform(l, lambda p: p.id), ',') AS list, CAST(CASE WHEN l IS NOT NULL THEN list_position(list_transform(l, lambda p: p.id), list_max(list_transform(l, lambda p: p.id))) - 1 END AS BIGINT) AS newest FROM e""")
def modified_refs(spark: SparkSession, d: str) -> DataFrame:
    """The five newest orders of each customer as pictures, after a short-term and a long-term modification."""
    o = read(spark, d, "orders", "o_custkey", "o_orderkey", "o_orderstatus").withColumnRenamed("o_orderkey", "idx")
    p = T.newest(o, "o_custkey", 5).selectExpr("o_custkey", "struct(idx AS id, idx % 16 AS frame_num, o_orderstatus = 'F' AS long, idx % 3 AS long_idx) AS p")
    lists = p.groupBy("o_custkey").agg(F.array_sort(F.collect_list("p")).alias("pictures"))
    made = lists.withColumn("list", R.modified_list("pictures", "array(named_struct('idc', 0, 'value', o_custkey % 8), named_struct('idc', 2, 'value', o_custkey % 3))", "9", "16"))
    made = made.withColumn("ids", F.expr("transform(list, p -> p.id)"))
    return made.select("o_custkey", B.joined(F.col("ids")).alias("list"), R.place_in_list("ids", "array_max(ids)").alias("newest"))


def _marking_sql() -> str:
    """Pictures one after another, by recursion: the buffer is a list of structs (p, n, l, k), and each of two operations at most is a list expression."""
    first = lambda held, test: f"list_position(list_transform({held}, lambda x: {test}), true)"

    def without(held: str, test: str) -> str:
        at = first(held, test)
        return f"CASE WHEN COALESCE({at}, 0) = 0 THEN {held} ELSE list_concat({held}[:{at} - 1], {held}[{at} + 1:]) END"

    number = lambda a: f"(e.n - {a} - 1 + 16) % 16"
    picture = lambda long, k: f"{{'p': e.event_id, 'n': e.n, 'l': {long}, 'k': {k}}}"
    short = lambda a: f"NOT x.l AND x.n = {number(a)}"
    index = lambda a: f"x.l AND x.k = {a}"
    plus = lambda held, new: f"list_append({held}, {new})"
    freed = without("b.held", index("e.k % 4"))
    lacks = f"COALESCE({first(freed, short('e.k % 2'))}, 0) = 0"
    made_long = f"list_transform({freed}, lambda x, i: CASE WHEN i = {first(freed, short('e.k % 2'))} THEN {{'p': x.p, 'n': x.n, 'l': true, 'k': e.k % 4}} ELSE x END)"
    longs = "len(list_filter(b.held, lambda x: x.l))"
    # room for one more: the oldest short-term pictures go
    room = f"list_filter(b.held, lambda x, i: x.l OR len(list_filter(b.held[:i], lambda y: NOT y.l)) > len(b.held) - 3)"
    cases = [
        ("e.idr", f"[{picture('e.k % 2 = 1', '0')}]", "NULL"),
        ("e.k % 9 = 1", plus(without("b.held", short("e.k % 3")), picture("false", "0")), "NULL"),
        ("e.k % 9 = 2", f"CASE WHEN {lacks} THEN b.held ELSE {plus(made_long, picture('false', '0'))} END", f"CASE WHEN {lacks} THEN 'no short-term picture ' || {number('e.k % 2')} END"),
        ("e.k % 9 = 3", plus(without("b.held", index("e.k % 4")), picture("false", "0")), "NULL"),
        ("e.k % 9 = 4", plus("list_filter(b.held, lambda x: NOT x.l OR x.k < e.k % 3)", picture("false", "0")), "NULL"),
        ("e.k % 9 = 5", plus(without("b.held", index("e.k % 4")), picture("true", "e.k % 4")), "NULL"),
        ("e.k % 9 = 6", plus(without(f"({without('b.held', short('0'))})", short("1")), picture("false", "0")), "NULL"),
        ("e.k % 9 = 7", f"[{picture('false', '0')}]", "NULL"),
        (f"len(b.held) >= 4 AND {longs} >= 4", "b.held", "'buffer is full of long-term pictures'"),
        ("len(b.held) >= 4", plus(room, picture("false", "0")), "NULL"),
    ]
    held = " ".join(f"WHEN {test} THEN {new}" for test, new, _ in cases)
    error = " ".join(f"WHEN {test} THEN {why}" for test, _, why in cases)
    kind = "STRUCT(p BIGINT, n BIGINT, l BOOLEAN, k BIGINT)[]"
    return f"""WITH RECURSIVE e AS (SELECT user_id, event_id, COALESCE(event_type = 'signup', false) AS idr, event_id % 16 AS n, COALESCE(TRY_CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT), 0) AS k, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
b(user_id, i, event_id, seen, held, error) AS (SELECT DISTINCT user_id, CAST(0 AS BIGINT), CAST(NULL AS BIGINT), CAST([] AS {kind}), CAST([] AS {kind}), CAST(NULL AS VARCHAR) FROM events
  UNION ALL SELECT e.user_id, e.i, e.event_id, b.held, CAST(CASE {held} ELSE {plus('b.held', picture('false', '0'))} END AS {kind}), CAST(CASE {error} END AS VARCHAR) FROM b JOIN e ON e.user_id = b.user_id AND e.i = b.i + 1)
SELECT CAST(user_id AS VARCHAR) AS track, event_id AS sample, array_to_string(list_transform(seen, lambda x: x.p || ':' || x.n || CASE WHEN x.l THEN 'L' || x.k ELSE '' END), ',') AS held, error FROM b WHERE i > 0"""


@_query(_marking_sql())
def dpb_marking(spark: SparkSession, d: str) -> DataFrame:
    """The events as reference pictures of a track a user: a sign-up is an IDR picture, numbers in props choose the operations."""
    return R.buffers(D.marked_events(spark, d), "track", ["ts", "sample"], "sample", F.date_trunc("day", F.col("ts")))


# --- interpolation and partitions over whole tables -----------------------------------------------

_WINDOW_SQL = """w AS (SELECT vec_id, unnest(range(9)) AS w, list_transform(embedding, lambda v: (CAST(floor(CAST(v AS DOUBLE) * 128) AS BIGINT) & 255)) AS b FROM embeddings),
x AS (SELECT vec_id, CAST(w AS INTEGER) AS w, list_transform(range(36), lambda i: b[(w // 3 + i // 6) * 8 + w % 3 + i % 6 + 1]) AS s FROM w)"""
_TAP_SQL = lambda places: "(" + " + ".join(f"{t} * s[{p + 1}]" for t, p in zip(B.TAPS, places, strict=True)) + ")"
_CLIP_SQL = lambda v: f"CAST(greatest(least({v}, 255), 0) AS BIGINT)"
_CENTRE_SQL = " + ".join(f"{t} * {_TAP_SQL([6 * r + c for c in range(6)])}" for r, t in enumerate(B.TAPS))


@_query(f"""WITH {_WINDOW_SQL}, y AS (SELECT *, {_CLIP_SQL(f'({_TAP_SQL([12, 13, 14, 15, 16, 17])} + 16) >> 5')} AS r FROM x)
SELECT vec_id, w, s[15] AS "full", r AS "right", {_CLIP_SQL(f'({_TAP_SQL([2, 8, 14, 20, 26, 32])} + 16) >> 5')} AS below, {_CLIP_SQL(f'({_CENTRE_SQL} + 512) >> 10')} AS centre, (s[15] + r + 1) >> 1 AS quarter FROM y""")
def luma_half_samples(spark: SparkSession, d: str) -> DataFrame:
    """Every vector as an 8x8 picture; all its 6x6 windows."""
    b = read(spark, d, "embeddings", "vec_id", "embedding").select("vec_id", F.transform(B.quantised(F.col("embedding"), 128), lambda v: v.bitwiseAND(F.lit(255))).alias("b"))
    w = b.select("vec_id", "b", F.explode(F.sequence(F.lit(0), F.lit(8))).alias("w"))
    x = w.select("vec_id", "w", F.expr("transform(sequence(0, 35), i -> b[CAST((w div 3 + i div 6) * 8 + w % 3 + i % 6 AS INT)])").alias("s"))
    return x.select("vec_id", "w", *[c.alias(n) for n, c in B.half_samples(F.col("s")).items()])


_SHAPES_SQL = "[[8, 8], [8, 4], [4, 8], [4, 4]]"


@_query(f"""WITH p AS (SELECT p_partkey, p_partkey % 6 AS raw, p_size AS z FROM part),
h AS (SELECT p_partkey, CAST(i % (16 // w) * w AS BIGINT) AS x, CAST(i // (16 // w) * h AS BIGINT) AS y, CAST(w AS BIGINT) AS width, CAST(h AS BIGINT) AS height FROM (SELECT p_partkey, CASE raw WHEN 2 THEN 8 ELSE 16 END AS w, CASE raw WHEN 1 THEN 8 ELSE 16 END AS h, unnest(range(CASE raw WHEN 0 THEN 1 ELSE 2 END)) AS i FROM p WHERE raw < 3)),
q AS (SELECT p_partkey, q, list_extract({_SHAPES_SQL}, CAST((z + q) % 4 AS INTEGER) + 1) AS s FROM (SELECT *, unnest(range(4)) AS q FROM p WHERE raw IN (3, 4))),
e AS (SELECT p_partkey, q, s, unnest(range(64 // (s[1] * s[2]))) AS i FROM q)
SELECT * FROM h UNION ALL SELECT p_partkey, CAST(q % 2 * 8 + i % (8 // s[1]) * s[1] AS BIGINT), CAST(q // 2 * 8 + i // (8 // s[1]) * s[2] AS BIGINT), CAST(s[1] AS BIGINT), CAST(s[2] AS BIGINT) FROM e""")
def macroblock_partitions(spark: SparkSession, d: str) -> DataFrame:
    x = read(spark, d, "part", "p_partkey", "p_size").select("p_partkey", (F.col("p_partkey") % 6).alias("raw"), F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: (F.col("p_size") + i) % 4).alias("sub"))
    return x.select("p_partkey", F.explode(B.inter_partitions(F.col("raw"), F.col("sub"))).alias("p")).select("p_partkey", "p.*")


@_query(f"WITH {SAMPLES_SQL} SELECT event_id, lag(k) OVER (PARTITION BY user_id ORDER BY idx) AS previous FROM s")
def previous_carry(spark: SparkSession, d: str) -> DataFrame:
    return samples(spark, d, previous=preceding(F.col("k"))).select("event_id", "previous")


@_query("SELECT l_orderkey, CAST(sum(CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END) AS BIGINT) AS intra, CAST(sum(CASE WHEN l_quantity >= 25 THEN 1 ELSE 0 END) AS BIGINT) AS coded FROM lineitem GROUP BY l_orderkey")
def block_counts(spark: SparkSession, d: str) -> DataFrame:
    return N.conditional_counts(read(spark, d, "lineitem", "l_orderkey", "l_returnflag", "l_quantity"), ["l_orderkey"], {"intra": F.col("l_returnflag") == "A", "coded": F.col("l_quantity") >= 25})


@_query("SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS line, l_partkey FROM lineitem JOIN part ON p_partkey = l_partkey WHERE NOT l_linenumber - 1 < p_size % 5")
def address_range(spark: SparkSession, d: str) -> DataFrame:
    x = N.described(read(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_partkey"), "l_partkey", read(spark, d, "part", "p_partkey", "p_size"), "p_partkey")
    x = x.selectExpr("l_orderkey", "CAST(l_linenumber AS BIGINT) AS line", "l_partkey", "l_linenumber - 1 AS address", "p_size % 5 AS total")
    return N.out_of_range(x, "address", "total").select("l_orderkey", "line", "l_partkey")


from framelake.plans import media as _media  # noqa: E402, F401  its queries register themselves
