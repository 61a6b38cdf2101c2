"""Token alignment, whitening and URL filters against brute force, SQL, and their edge cases."""

import hashlib
import os
import random
from collections import Counter, defaultdict
from fractions import Fraction

import duckdb
import numpy as np
import pytest
import sentencepiece
from test_tokens_and_vectors import BYTES, PIECES, odd_texts

import __spark_entry__ as entry
from framelake.llm import token_alignment as A
from framelake.llm import url_filter as U
from framelake.llm import whitening as W


# --- token alignment


def plain_alignment(texts):
    """The contract read literally, text by text, with the libraries."""
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(BYTES)
    lib.encode_special_tokens = True
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    chars = A.byte_alphabet()
    found = []
    for t in texts:
        want = (" " + t).encode() if t else b""
        a = lib.encode(" " + t, add_special_tokens=False).ids if t else []
        b = sp.encode(t) if t else []
        a_bytes = [bytes(chars[c] for c in lib.id_to_token(i)) for i in a]
        b_bytes = [bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if not t or b"".join(a_bytes) != want or b"".join(b_bytes) != want:
            found.append(None)
            continue
        ends_a, ends_b = np.cumsum([len(x) for x in a_bytes]).tolist(), np.cumsum([len(x) for x in b_bytes]).tolist()
        cuts = sorted(set(ends_a) & set(ends_b))
        group = lambda ids, ends, lo, hi: ",".join(str(i) for i, e in zip(ids, ends, strict=True) if lo < e <= hi)
        links, j = [], 0
        for i, raw, e in zip(a, a_bytes, ends_a, strict=True):
            s = e - len(raw)
            while ends_b[j] <= s:
                j += 1
            k = j
            while k < len(b) and ends_b[k] - len(b_bytes[k]) < e:
                links.append((i, b[k]))
                k += 1
        text = None
        if len(a) < 3000:
            text = ";".join(f"{group(a, ends_a, lo, hi)}|{group(b, ends_b, lo, hi)}" for lo, hi in zip([0, *cuts], cuts, strict=False))
        found.append((len(a), len(b), len(cuts), links, text and hashlib.sha256(text.encode()).hexdigest()))
    docs = Counter(p for f in found if f for p in set(f[3]))
    best = defaultdict(int)
    for (a, _), n in docs.items():
        best[a] = max(best[a], n)
    out = []
    for f in found:
        links = f[3] if f else []
        sums = (sum(docs[p] == best[p[0]] for p in links), sum(docs[p] for p in links))
        out.append((*f[:3], len(links), *sums, f[4]) if f else (0, 0, 0, 0, 0, 0, ""))
    return out, docs


@pytest.mark.parametrize("block", [(1 << 16, 1 << 21), (7, 1 << 21), (1 << 16, 50)])
def test_alignment_equals_the_libraries(spark, sf, block):
    texts = odd_texts(150) + ["naïve — x▁y", "▁", "a▁", "<|endoftext|> </s><s>", "it's  the\n\n cat's\t8 8", None, ""]
    texts += [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").limit(60).collect()]
    docs = spark.createDataFrame([(k, t, "x", 1) for k, t in enumerate(texts)], "doc_id bigint, text string, block string, n_a int").repartition(3, "doc_id")
    want, pairs = plain_alignment(texts)
    out, scores = A.align(docs, BYTES, PIECES, block_docs=block[0], block_links=block[1])  # blocks of few documents or few links give the same rows
    got = {r.doc_id: (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in out.collect()}
    assert len(got) == len(texts)
    for k, w in enumerate(want):
        assert got[k][:6] == w[:6], (k, texts[k])
        assert w[6] is None or got[k][6] == w[6], texts[k]
    assert {(r.a, r.b): r.n_docs for r in scores.collect()} == dict(pairs)
    assert sum(r.n_links for r in scores.collect()) == sum(w[3] for w in want)


def test_alignment_of_odd_tables(spark):
    docs = spark.createDataFrame([(None, "one two"), (1, "one two"), (1, "one two"), (2, None), (3, ""), (None, None)], "doc_id bigint, text string")
    out, scores = A.align(docs, BYTES, PIECES)
    rows = sorted((r.doc_id or 0, r.n_links, r.count_sum, r.n_best, r.groups_sha256 != "") for r in out.collect())
    assert rows == [(0, 0, 0, 0, False), (0, 2, 6, 2, True), (1, 2, 6, 2, True), (1, 2, 6, 2, True), (2, 0, 0, 0, False), (3, 0, 0, 0, False)]
    assert {r.n_docs for r in scores.collect()} == {3}
    assert A.align(docs.limit(0), BYTES, PIECES)[0].count() == 0


def test_bitmaps_and_planes():
    r = random.Random(5)
    for n, most in ((1, 1), (1, 65535), (40, 50), (3000, 65535), (9000, 12_000), (65536, 65535)):
        offsets = np.array(sorted(r.sample(range(most + 1), min(n, most + 1))), dtype=np.uint16)
        assert (A.unpack_bitmap(A.pack_bitmap(offsets)) == offsets).all()
    assert len(A.pack_bitmap(np.arange(65536).astype(np.uint16))) == 8195
    times = {(p, d): r.choice([1, 1, 1, 2, 3, 5, 300]) for p in range(20) for d in r.sample(range(60), 9)}
    keys = np.array([(p << 16) | d for (p, d), n in times.items() for _ in range(n)], dtype=np.int64)
    back = Counter()
    for pairs, plane, ends, offsets in A.block_postings(keys):
        for p, s, e in zip(pairs.tolist(), [0, *ends[:-1].tolist()], ends.tolist(), strict=True):
            for d in offsets[s:e].tolist():
                back[p, d] += 1 << plane if plane >= 0 else 1
    assert back == times and not list(A.block_postings(np.zeros(0, dtype=np.int64)))


# --- whitening


def plain_whitening(vectors):
    """(n, deviations, covariance) with fractions."""
    x = [tuple((256 * n) // d for n, d in map(float.as_integer_ratio, v)) for v in vectors]
    fit = sorted(set(x))
    n, dim = len(fit), len(fit[0])
    sums = [sum(v[i] for v in fit) for i in range(dim)]
    cov = np.array([[float(Fraction(n * sum(v[i] * v[j] for v in fit) - sums[i] * sums[j], n * n)) for j in range(dim)] for i in range(dim)])
    return n, sums, x, [sum((n * c - s) ** 2 for c, s in zip(v, sums, strict=True)) for v in x], cov


@pytest.mark.parametrize(("dim", "scale"), [(7, 1.0), (3, 1e-3), (2, 1.0), (5, 1e9), (4, 3e13), (1, 1.0)])
def test_whitening_equals_fractions(spark, dim, scale):
    r = np.random.default_rng(dim)
    vectors = (r.normal(size=(150, dim)) * scale * np.arange(1, dim + 1)).tolist()
    vectors += vectors[:40]
    rows = spark.createDataFrame(list(enumerate(vectors)), "vec_id bigint, embedding array<double>").repartition(5)
    n, sums, x, deviation, cov = plain_whitening(vectors)
    out = W.whiten(rows).collect()
    assert len(out) == len(vectors) * min(4, dim)
    values, axes = np.linalg.eigh(cov)
    values, axes = values[::-1], axes[:, ::-1]
    white = (np.array([[float(Fraction(n * c - s, n)) for c, s in zip(v, sums, strict=True)] for v in x]) @ axes) / np.sqrt(values)
    sign = {}
    for row in out:
        assert row.n == n and row.deviation_text == str(deviation[row.vec_id])
        assert row.deviation == (deviation[row.vec_id] if deviation[row.vec_id] < 1 << 63 else None)
        want = white[row.vec_id, row.component - 1]
        assert abs(abs(row.whitened) - abs(want)) < 1e-7
        if abs(want) > 1e-3:
            assert sign.setdefault(row.component, row.whitened * want > 0) == (row.whitened * want > 0)
        assert abs(row.explained - values[row.component - 1] / np.trace(cov)) < 1e-9 and row.identity_error < 1e-9
    one = {}
    for row in out:
        one.setdefault(tuple(x[row.vec_id]), {})[row.component] = row.whitened
    m = np.array([[v[c] for c in sorted(v)] for v in one.values()])
    assert np.abs(np.cov(m.T, bias=True).reshape(len(m[0]), -1) - np.eye(len(m[0]))).max() < 1e-8 and np.abs(m.mean(axis=0)).max() < 1e-8


def test_bit_planes_give_exact_products():
    r = np.random.default_rng(2)
    for bits in (1, 3, 9, 20, 64):
        x = r.integers(0, 1 << 63, (130, 5), dtype=np.uint64) >> np.uint64(64 - bits) if bits < 64 else r.integers(0, 1 << 64, (130, 5), dtype=np.uint64)
        counts = W.scatter_counts(W.bit_planes(x, bits), 5, bits)
        for i in range(5):
            for j in range(i, 5):
                assert sum(int(c[i, j]) << (W.LIMB * k) for k, c in enumerate(counts)) == sum(int(a) * int(b) for a, b in zip(x[:, i], x[:, j], strict=True))


def test_whitening_of_odd_tables(spark):
    schema = "vec_id bigint, embedding array<double>, n int, x string"
    nan, inf = float("nan"), float("inf")
    bad = [(1, None, 1, "a"), (2, [], 1, "a"), (3, [None, 1.0], 1, "a"), (4, [nan, 1.0], 1, "a"), (5, [1.0, -inf], 1, "a")]
    assert W.whiten(spark.createDataFrame(bad, schema)).count() == 0
    same = spark.createDataFrame([*bad, (None, [1.0, 2.0], 1, "a"), (7, [1.0, 2.0], 1, "a")], schema)
    assert {(r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in W.whiten(same).collect()} == {(1, 0, None, 0.0, 0.0)}
    line = spark.createDataFrame([(k, [float(k), 2.0 * k, 5.0]) for k in range(9)] + [(k, [float(k % 3)]) for k in range(9)], "vec_id int, embedding array<float>")
    out = W.whiten(line).collect()
    assert Counter((r.n, r.component, r.whitened is None) for r in out) == {(9, 1, False): 9, (9, 2, True): 9, (9, 3, True): 9, (3, 1, False): 9}
    assert all(r.identity_error < 1e-12 for r in out) and {round(r.explained, 9) for r in out} == {0.0, 1.0}


# --- URL filters

ODD_URLS = [
    None, "", "no scheme", "http://", "http://net", "http://net/", "HTTP://A.NET/x", "https://example.net/en/", "https://example.net/EN/", "https://m.Example.net/en/1?x#y", "https://notexample.net/en/1", "http://x.example.com/de/1", "http://x.example.com/de",
    "http://org/fr/?a", "http://a.org/fr/#b", "http://a.org?/fr/", "http://adult-x.org/a?utm_source=f&b=2&a=1#c", "http://www.adult-x.org/a/?a=1&b=2&ref=9", "http://m.adult-x.org:80/a?b=2&a=1", "x://y://z/q", "http://a.org/\n/b", "http://user@a.org/c",
]


def plain_verdict(url, listed):
    rest = url.split("://", 1)[1] if url and "://" in url else None
    cut = lambda s, stops: s[: min([s.find(c) for c in stops if c in s], default=len(s))]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in cut(rest, "/?#")) if rest is not None else ""
    path = cut(rest[len(host) :], "?#") if rest is not None else ""
    fits = [r for r in U.RULES if (host == r[1] or host.endswith("." + r[1])) and path.startswith(r[2])]
    rule = max(fits, key=lambda r: len(r[1] + r[2]), default=None)
    return host, path, rule and rule[1] + rule[2], rule[0] if rule else "block" if url in listed else "allow"


def test_url_rules_and_list(spark):
    listed_urls = {"http://adult-x.org/a?utm_source=f&b=2&a=1#c", "http://www.adult-x.org/a/?a=1&b=2&ref=9", "http://m.adult-x.org:80/a?b=2&a=1"}
    pages = spark.createDataFrame([(k, u, "a", "b", 1) for k, u in enumerate(ODD_URLS)] + [(None, ODD_URLS[16], "", "", 1), (None, None, "", "", 1)], "page_id bigint, url string, host string, block string, bit int")
    listed = spark.createDataFrame([("adult-x.org/a?a=1&b=2",), (None,), ("other.org/",)] * 2, "canonical string")
    rows = U.judge(pages, listed).collect()
    assert len(rows) == len(ODD_URLS) + 2
    for r in rows:
        if r.page_id is not None:
            assert (r.host, r.path, r.rule, r.verdict) == plain_verdict(ODD_URLS[r.page_id], listed_urls), ODD_URLS[r.page_id]
    assert Counter(r.verdict for r in rows if r.page_id is None) == {"block": 1, "allow": 1}
    assert all(r.verdict != "block" or r.rule for r in U.judge(pages, listed.limit(0)).collect())
    assert U.judge(pages.limit(0), listed).count() == 0
    with pytest.raises(ValueError, match="rules"):
        U.matched_rule(U.F.lit(""), U.F.lit(""), [("block", "a", "")] * (U.MOST_RULES + 1))


def test_bloom_filter_misses_nothing_and_passes_little_else(spark, monkeypatch):
    rows = spark.range(40_000).selectExpr("concat('u', id) as canonical", "id")
    listed = rows.where("id < 20000")
    for most in (U.BROADCAST_BYTES, 0):  # with and without a broadcast
        monkeypatch.setattr(U, "BROADCAST_BYTES", most)
        bloom, blocks = U.blocked_bloom(listed, "canonical", 20_000)
        out = U._may_be_listed(rows, "canonical", bloom, blocks, "may").selectExpr("sum(int(may and id < 20000)) as hits", "sum(int(may and id >= 20000)) as false_hits", "count(*) as n").first()
        assert out.n == 40_000 and out.hits == 20_000 and out.false_hits < 200
        pages = rows.selectExpr("id as page_id", "concat('http://', canonical, '/') as url")
        judged = U.judge(pages, listed)
        assert {(r.verdict, r["count"]) for r in judged.groupBy("verdict").count().collect()} == {("block", 20_000), ("allow", 20_000)}
        assert judged.where("passed_filter and not listed").count() == out.false_hits  # the exact join removes them
        plan = judged._jdf.queryExecution().toString()
        assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan


def test_url_query_equals_sql(spark, sf):
    con = duckdb.connect()
    for f in os.listdir(sf):
        con.sql(f"create view {f.split('.')[0]} as select * from '{sf}/{f}'")
    df = entry.queries()["op13_url_filter"](spark, sf)
    want = con.sql(f"select {', '.join(df.columns)} from ({entry.oracle_sql()['op13_url_filter']})").fetchall()
    assert sorted(map(tuple, df.collect()), key=str) == sorted(want, key=str)
    assert {v for *_, v in want} == {"allow", "block"}


def test_whitening_and_alignment_queries(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    n, _, _, deviation, cov = plain_whitening([[float(c) for c in r.embedding] for r in rows])
    got = entry.queries()["op12_whitening"](spark, sf).collect()
    want = {r.vec_id: d for r, d in zip(rows, deviation, strict=True)}
    assert len(got) == 4 * len(rows) and all(r.deviation == want[r.vec_id] and r.n == n and r.identity_error < 1e-9 for r in got)
    top = np.linalg.eigvalsh(cov)[::-1]
    assert all(abs(r.explained - top[r.component - 1] / top.sum()) < 1e-9 for r in got)
    docs = spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()
    aligned = {r.doc_id: r for r in entry.queries()["op11_token_alignment"](spark, sf).collect()}
    for r, w in zip(docs, plain_alignment([r.text for r in docs])[0], strict=True):
        x = aligned[r.doc_id]
        assert (x.n_a, x.n_b, x.n_groups, x.n_links, x.n_best, x.count_sum) == w[:6] and (w[6] is None or w[6] == x.groups_sha256)
