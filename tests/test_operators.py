"""Operators against plain windows and known values."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from framelake.functions import arithmetic as A
from framelake.functions import blocks as B
from framelake.operators import parameter_sets as P
from framelake.operators import references as R
from framelake.operators import relations as N
from framelake.operators import scan as S
from framelake.operators import units as U
from framelake.plans import catalogue
from framelake.streaming import decoding


@pytest.fixture(scope="module")
def track(spark):
    r = random.Random(5)
    rows = [(r.choice("abb"), i, r.randint(-5, 9) if r.random() < 0.8 else None) for i in range(400)]
    return spark.createDataFrame(rows, "t string, i bigint, v bigint").repartition(3)


def scanned(df, chunk):
    return S.scan(df, ["t"], ["i"], chunk, s=S.prefix(F.col("v")), n=S.index(), nx=S.following(F.col("i")), pv=S.preceding(F.col("v")), la=S.latest(F.col("v")), mx=S.running_max(F.col("v"))).select("i", "s", "n", "nx", "pv", "la", "mx")


def windowed(df):
    w = Window.partitionBy("t").orderBy("i")
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = F.coalesce(F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return df.select("i", before.alias("s"), (F.row_number().over(w) - 1).cast("bigint").alias("n"), F.lead("i").over(w).alias("nx"), F.lag("v").over(w).alias("pv"), F.last("v", True).over(upto).alias("la"), F.max("v").over(upto).alias("mx"))


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("size", [1, 7, 1000])
def test_scans_equal_plain_windows(track, size):
    assert rows_of(scanned(track, F.floor(F.col("i") / size))) == rows_of(windowed(track))


def test_scans_keep_nulls(spark):
    rows = [("a", 1, 5), ("a", None, 7), (None, 3, 2), (None, None, 4), (None, 9, None), ("b", None, None), ("", 2, 1), ("", 4, 1)]
    d = spark.createDataFrame(rows, "t string, i bigint, v bigint")
    assert rows_of(scanned(d, F.floor(F.col("i") / 2))) == rows_of(windowed(d))
    assert scanned(d.limit(0), F.col("i")).count() == 0


def test_scans_do_not_multiply(spark, sf):
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert plan(catalogue.queries()["gop_id"](spark, sf)).count("FileScan") <= 2
    assert plan(catalogue.queries()["pts_order"](spark, sf)).count("FileScan") <= 2
    assert plan(catalogue.flagship(spark, sf)).count("FileScan") <= 2


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


def test_known_values(spark):
    row = spark.createDataFrame([(20, -15, 26)], "m bigint, n bigint, q bigint")
    state, mps = A.context_state("m", "n", "q")
    assert tuple(row.select(state, mps).first()) == (46, 0)
    lit = lambda xs: F.array(*[F.lit(x).cast("bigint") for x in xs])
    assert one(spark, B.strong_edge(lit([100] * 4 + [110] * 4))) == [100, 101, 103, 104, 106, 108, 109, 110]
    assert one(spark, B.inverse_4x4(lit([640] + [0] * 15))) == [10] * 16
    assert one(spark, A.chroma_qp("51", "0")) == 39
    assert one(spark, A.neighbour_total("3", "6")) == 5
    assert one(spark, A.mask_scale("128", 5, 11)) == 0x7800
    assert one(spark, A.align("17", 8)) == 24
    assert [one(spark, c) for c in A.bt601("16", "128", "128").values()] == [0, 0, 0]
    assert one(spark, A.weighted_pair("100", "200", "32", "32", "0", "5")) == 150
    assert one(spark, A.median3("5", "1", "3")) == 3
    assert [one(spark, A.signed_golomb(str(k))) for k in range(5)] == [0, 1, -1, 2, -2]


def test_reference_lists(spark):
    rows = [(1, 10, False, 1, 0, 0), (1, 11, True, 0, 0, 0), (1, 12, False, 2, 4, 0)]
    d = spark.createDataFrame(rows, "g int, id bigint, long boolean, frame_num bigint, poc bigint, long_idx bigint")
    p = [r.id for r in sorted(R.list_p(d, "g", "id", 3, 16).collect(), key=lambda r: r.place)]
    assert p == [12, 10, 11]
    b = R.lists_b(d, "g", "id", 2).first()
    assert (b.l0, b.l1) == ([10, 12, 11], [12, 10, 11])
    same = R.lists_b(d.where("long or poc = 0"), "g", "id", 2).first()
    assert (same.l0, same.l1) == ([10, 11], [11, 10])


def test_units_round_trip(spark):
    d = spark.createDataFrame([(1, "a \n\nb\n c"), (2, ""), (3, None)], "k int, s string")
    u = U.split_units(d, "s", "\n")
    assert sorted(map(tuple, u.collect())) == [(1, 0, "a"), (1, 1, "b"), (1, 2, " c")]
    assert [tuple(r) for r in U.join_units(u, ["k"], "\n").collect()] == [(1, 3, "\na\nb\n c")]


def test_decoder_state_over_shuffled_files(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet")
    events.repartition(20, "event_id").write.parquet(f"{tmp_path}/events.parquet")
    out = decoding.decoder_rows(spark, str(tmp_path), slice_rows=max(1, events.count() // 3)).collect()
    truth, state = [], {}
    for r in sorted(events.collect(), key=lambda r: (r.ts, r.event_id)):
        current, held = state.get(r.user_id, (None, []))
        if r.event_type == "signup":
            current, held = r.event_id, []
        truth.append((r.user_id, r.event_id, current, ",".join(map(str, held))))
        state[r.user_id] = (current, [r.event_id, *held][:4])
    assert sorted(map(tuple, out), key=str) == sorted(truth, key=str)


def test_annexb_and_lengths():
    assert U.cut_annexb(b"\0\0\0\1\x67a\0\0\0\0\1\x68b\0\0\1\0\0\1\x65c\0\0") == [b"\x67a", b"\x68b", b"\x65c"]
    for bad in (b"", b"\x67", b"x\0\0\1\x67", b"\0\0\1", b"\0\0\1\x87", b"\0\0\1\x60"):
        with pytest.raises(P.Malformed):
            U.cut_annexb(bad)
    for size in (1, 2, 4):
        assert U.cut_lengths((2).to_bytes(size, "big") + b"\x65a", size) == [b"\x65a"]
        for bad in ((0).to_bytes(size, "big"), (9).to_bytes(size, "big") + b"\x65", b"\1" * (size - 1) or b"\2\x65"):
            with pytest.raises(P.Malformed):
                U.cut_lengths(bad, size)
    with pytest.raises(P.Malformed):
        U.cut_lengths(b"\0\0\1\x65", 3)


def test_split_bytes_has_a_row_for_each_bad_stream(spark):
    d = spark.createDataFrame([(1, b"\0\0\1\x65a"), (2, None), (3, b"zz"), (None, b"\0\0\1\x41")], "k bigint, s binary")
    rows = sorted(((r.k, r.unit_idx, r.error is None) for r in U.split_bytes(d, ["k"], "s").collect()), key=str)
    assert rows == sorted([(1, 0, True), (2, None, False), (3, None, False), (None, 0, True)], key=str)


def test_emulation_bytes():
    assert P.unescaped(b"\0\0\3\1\0\0\3\0\0\3\3x") == b"\0\0\1\0\0\0\0\3x"
    for bad in (b"\0\0\3", b"\0\0\3\4"):
        with pytest.raises(P.Malformed):
            P.unescaped(bad)
    r = P.Bits(b"\x67\xa0")
    assert (r.u(1), r.more(), r.u(1), r.more(), r.u(6)) == (1, True, 0, False, 32)


def test_configurations(spark):
    good = bytes([1, 66, 0, 30, 0xFF, 0xE1, 0, 2, 0x67, 9, 1, 0, 1, 0x68, 7, 7])
    d = spark.createDataFrame([(1, good), (2, b"\2" + good[1:]), (3, good[:9]), (4, None), (5, good[:10])], "k bigint, c binary")
    rows = {r.k: r for r in U.configurations(d, ["k"], "c").collect()}
    assert (rows[1].length_size, rows[1].sequence_sets, rows[1].picture_sets, rows[1].trailing) == (4, [b"\x67\x09"], [b"\x68"], b"\7\7")
    assert all(rows[k].error and rows[k].profile is None for k in (2, 3, 4, 5))
    sets = U.seeded_sets(U.configurations(d, ["k"], "c").withColumn("track", F.col("k")), "track").collect()
    assert sorted((r.track, r.sample_idx, r.unit_idx, r.unit) for r in sets) == [(1, -1, 0, b"\x67\x09"), (1, -1, 1, b"\x68")]


def replay(events, max_refs=4, largest=16):
    """The buffer before each picture, by the rules as the standard words them."""
    out, tracks = {}, {}
    for sample, track, n, idr, is_long, adaptive, operations in events:
        dpb = tracks.setdefault(track, [])
        out[sample] = ",".join(f"{p['id']}:{p['n']}" + (f"L{p['k']}" if p["k"] is not None else "") for p in dpb)
        new, backup, failed = {"id": sample, "n": n, "k": None}, [dict(p) for p in dpb], False
        short = lambda x: [p for p in dpb if p["k"] is None and p["n"] == x][:1]  # noqa: B023, E731
        of_long = lambda x: [p for p in dpb if p["k"] == x][:1]  # noqa: B023, E731
        if idr:
            dpb.clear()
            new["k"] = 0 if is_long else None
        elif adaptive:
            for op, a, b in operations:
                target = (n - (a + 1)) % largest
                gone = {1: lambda: short(target), 2: lambda: of_long(a), 3: lambda: of_long(b), 4: lambda: [p for p in dpb if p["k"] is not None and p["k"] >= a], 5: lambda: list(dpb), 6: lambda: of_long(a)}[op]()  # noqa: B023
                for p in gone:
                    dpb.remove(p)
                if op == 3:
                    if not short(target):
                        failed = True
                        break
                    short(target)[0]["k"] = b
                if op == 6:
                    new["k"] = a
        else:
            while len(dpb) >= max_refs and not failed:
                old = [p for p in dpb if p["k"] is None]
                failed = not old
                if old:
                    dpb.remove(old[0])
        if failed:
            dpb[:] = backup
        else:
            dpb.append(new)
    return out


def test_marking_over_slices(spark, sf):
    events = spark.read.parquet(f"{sf}/events.parquet")
    out = decoding.marking_rows(spark, sf, slice_rows=max(1, events.count() // 3)).collect()
    k = F.coalesce(F.regexp_extract("props", "([0-9]+)", 1).cast("bigint"), F.lit(0)).alias("k")
    rows = []
    for r in sorted(events.select("user_id", "event_id", "ts", "event_type", k).collect(), key=lambda r: (r.ts, r.event_id)):
        ops = {1: [(1, r.k % 3, 0)], 2: [(3, r.k % 2, r.k % 4)], 3: [(2, r.k % 4, 0)], 4: [(4, r.k % 3, 0)], 5: [(6, r.k % 4, 0)], 6: [(1, 0, 0), (1, 1, 0)], 7: [(5, 0, 0)]}.get(r.k % 9, [])
        rows.append((r.event_id, str(r.user_id), r.event_id % 16, r.event_type == "signup", r.k % 2 == 1, bool(ops), ops))
    assert {r.sample: r.held for r in out} == replay(rows)
    assert len(out) == len(rows)


def test_marking_operations():
    held = [(1, 3, False, 0), (2, 4, False, 0), (3, 5, True, 1)]
    step = lambda ops, n=6: R.marked(held, 9, n, False, False, True, ops, 16, 4)
    assert [p[0] for p in step([(1, 0, 0)])[0]] == [1, 2, 3, 9]  # number 5 is long-term by now
    assert [p[0] for p in step([(1, 1, 0)])[0]] == [1, 3, 9]
    assert [p[0] for p in step([(2, 1, 0)])[0]] == [1, 2, 9]
    assert step([(3, 2, 1)])[0] == [(1, 3, True, 1), (2, 4, False, 0), (9, 6, False, 0)]
    assert step([(3, 9, 1)]) == (held, "no short-term picture 12")
    assert [p[0] for p in step([(4, 1, 0)])[0]] == [1, 2, 9] and [p[0] for p in step([(4, 2, 0)])[0]] == [1, 2, 3, 9]
    assert step([(5, 0, 0), (6, 2, 0)])[0] == [(9, 6, True, 2)]
    assert R.marked(held, 9, 0, True, True, False, [], 16, 4) == ([(9, 0, True, 0)], None)
    assert [p[0] for p in R.marked(held, 9, 6, False, False, False, [], 16, 3)[0]] == [2, 3, 9]
    full = [(1, 3, True, 0)]
    assert R.marked(full, 9, 6, False, False, False, [], 16, 1) == (full, "buffer is full of long-term pictures")


def test_list_modifications(spark):
    d = spark.sql("SELECT array(named_struct('id', 1, 'frame_num', 8, 'long', false, 'long_idx', 0), named_struct('id', 2, 'frame_num', 7, 'long', false, 'long_idx', 0), named_struct('id', 3, 'frame_num', 1, 'long', true, 'long_idx', 2)) AS p")
    ids = lambda ops: d.select(R.modified_list("p", ops, "9", "16").alias("l")).selectExpr("transform(l, x -> x.id) AS i").first().i
    op = lambda idc, value: f"named_struct('idc', {idc}, 'value', {value})"
    assert ids("CAST(array() AS ARRAY<STRUCT<idc: INT, value: INT>>)") == [1, 2, 3]
    assert ids(f"array({op(0, 1)})") == [2, 1, 3]
    assert ids(f"array({op(2, 2)}, {op(0, 0)})") == [3, 1, 2]
    assert ids(f"array({op(0, 0)}, {op(1, 15)})") == [1, 1, 2, 3]  # a picture that stands before the place stays there
    assert ids(f"array({op(0, 4)})") is None


def test_stored_tables_can_be_cleared(spark):
    import os

    from framelake.sources import storage

    storage.clear_stored(spark)
    df = storage.stored(spark.range(3), "kept")
    path = storage._written[0].removeprefix("file://")
    assert df.count() == 3 and os.path.isdir(path)
    assert storage.clear_stored(spark) == 1 and not os.path.exists(path)


def test_relations(spark):
    a = spark.createDataFrame([(1, 5, 1), (1, 7, 2), (None, 3, 1)], "k bigint, v bigint, t bigint")
    b = spark.createDataFrame([(1,), (1,), (None,)], "m bigint")
    assert sorted(map(tuple, N.last_writes(a, ["k"], "v", ["t"]).collect()), key=str) == [(1, 7), (None, 3)]
    assert sorted((r.v, r.f) for r in N.flagged(a, "k", b, "m", "f").collect()) == [(3, False), (5, True), (7, True)]
    assert [r.v for r in N.dangling(a, "k", b, "m").collect()] == [3]
    assert [tuple(r) for r in N.duplicates(b, ["m"]).collect()] == [(1, 2)]
    assert sorted((r.v, r.p) for r in N.with_neighbours(a.where("k = 1"), "k", "t", "v", {"p": 1}).collect()) == [(5, None), (7, 5)]
    assert sorted(r.v for r in N.out_of_range(a.withColumn("total", F.lit(2)), "t", "total").collect()) == [7]
    assert N.top(a.limit(0), ["k"], ["v"], 2).count() == 0


def test_taps_over_chunks(spark, monkeypatch):
    r = random.Random(2)
    rows = [(t, i, r.randint(0, 255)) for t, n in (("a", 40), ("b", 1), ("c", 2), ("d", 11), (None, 9)) for i in range(n)]
    df = spark.createDataFrame(rows, "t string, i bigint, v bigint")
    taps, values = (1, -5, 20, 20, -5, 1), {}
    for t, i, v in rows:
        values.setdefault(t, {})[i] = v
    want = set()
    for t, of in values.items():
        for i in of:
            total = sum(w * of[min(max(i + o, 0), len(of) - 1)] for o, w in zip(range(-2, 4), taps, strict=True))
            want.add((t, i, min(max(total + 16 >> 5, 0), 255)))
    for size in (4, 5, 1 << 16):
        monkeypatch.setattr(R, "TAP_CHUNK", size)
        out = R.six_tap(df, "t", "i", "v", taps)
        assert {(x.t, x.i, x["sample"]) for x in out.collect()} == want and out.count() == len(rows)
    plan = R.six_tap(df, "t", "i", "v", taps)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_slice_header_plan_and_lacking_sets(spark, sf):
    units = catalogue._slice_units(spark, sf)
    plan = P.slice_headers(units, "user_id")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and plan.count("FileScan") <= 6 and plan.count("Exchange hashpartitioning") <= 8
    some = units.where("sample_idx <= 3")
    whole = P.slice_headers(some, "user_id")
    assert whole.where("error IS NOT NULL").count() == 0
    no_pps = P.slice_headers(some.where("substring(unit, 1, 1) <> unhex('68')"), "user_id")
    assert {r.error for r in no_pps.collect()} == {"picture set is missing"}
    no_sps = P.slice_headers(some.where("substring(unit, 1, 1) <> unhex('67')"), "user_id")
    assert {r.error for r in no_sps.collect()} == {"sequence set is missing"}
    cut = P.slice_headers(some.withColumn("unit", F.expr("CASE WHEN substring(unit, 1, 1) IN (unhex('41'), unhex('65')) THEN substring(unit, 1, 3) ELSE unit END")), "user_id")
    rows = cut.collect()
    assert len(rows) == whole.count() and all(r.error and r.qp is None for r in rows)
    assert P.slice_headers(units.limit(0), "user_id").count() == 0


def test_neighbours_in_one_exchange(spark):
    r = random.Random(6)
    rows = [(p, a, r.randint(0, 9) if r.random() < 0.9 else None) for p in ("x", "y", None) for a in [*range(30), 4, None] if r.random() < 0.8]
    out = N.with_neighbours(spark.createDataFrame(rows, "p string, a int, v int"), "p", "a", "v", {"l": 1, "t": 7})
    assert out._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    best = {}
    for p, a, v in rows:
        if p is not None and a is not None and v is not None:
            best[p, a] = max(v, best.get((p, a), v))
    want = [(p, a, v, *[best.get((p, a - s)) if a is not None and p is not None else None for s in (1, 7)]) for p, a, v in rows]
    assert sorted(map(tuple, out.collect()), key=str) == sorted(want, key=str)


def test_sets_go_through_scans_as_bytes(spark, sf):
    plan = P.slice_headers(catalogue._slice_units(spark, sf), "user_id")._jdf.queryExecution().executedPlan().toString()
    assert "chroma_qp_offset" not in plan and "log2_max_poc" not in plan
    assert P._set_fields.cache_info().maxsize


def test_codes_of_any_length_and_payloads(spark):
    from framelake.functions import bitstrings as S

    payload = S.payload("bits")
    assert "aggregate" not in payload  # no loop over octets
    r = random.Random(4)
    rows = [("".join(r.choice("0001") if k % 3 else r.choice(("00000000", "00000011", "1")) for _ in range(r.randint(0, 60))),) for k in range(300)] + [("0" * n,) for n in range(200)] + [(None,)]
    for bits, made in spark.createDataFrame(rows, "bits string").selectExpr("bits", f"{payload} AS made").collect():
        if bits is None:
            assert made is None
            continue
        whole = bits + "1" + "0" * (-(len(bits) + 1) % 8)
        want, zeros = bytearray(), 0
        for o in int(whole, 2).to_bytes(len(whole) // 8, "big"):
            if zeros == 2 and o <= 3:
                want.append(3)
                zeros = 0
            want.append(o)
            zeros = zeros + 1 if o == 0 else 0
        assert bytes(made) == bytes(want) and P.unescaped(bytes(made)) == int(whole, 2).to_bytes(len(whole) // 8, "big")
    for n in range(64):
        for tail in (0, (1 << n) - 1):
            bits = "101" + "0" * n + "1" + (f"{tail:0{n}b}" if n else "")
            body = int(bits + "0" * (-len(bits) % 8), 2).to_bytes((len(bits) + 7) // 8, "big")
            reader = P.Bits(b"\x67")
            reader.body, reader.end = body, len(bits)
            assert (reader.u(3), reader.ue(), reader.at) == (5, (1 << n) - 1 + tail, len(bits))
    for zeros, error in ((63, "unit is cut short"), (64, "code is too long"), (80, "code is too long")):
        reader = P.Bits(b"\x67")
        reader.body = bytes(zeros // 8) + b"\x01" * bool(zeros % 8)
        reader.end = 8 * len(reader.body)
        with pytest.raises(P.Malformed, match=error):
            reader.ue()


def test_sets_asof_parse_units_once(spark, sf):
    plan = catalogue.slice_sets_asof(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "MapIn" not in plan and "ArrowEvalPython" not in plan  # units are parsed before, once for sets and slices
