"""Language ID, near-dedup, substring dedup, mixing, sharding against brute force, and their edge cases."""

import collections
import random
import re
import zlib

import pytest

from framelake.llm import common as C
from framelake.llm import language_id as L
from framelake.llm import mixing as M
from framelake.llm import near_dedup as N
from framelake.llm import sharding as H
from framelake.llm import substring_dedup as D

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, k int, t string, size int, spans string, component_id int"


def docs_of(spark, rows):
    """Rows (doc_id, text[, lang, source]) with extra columns whose names clash with inner ones."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else None, r[3] if len(r) > 3 else None, None if r[1] is None else len(r[1]), 1, "x", 2, "y", 3) for r in rows]
    return spark.createDataFrame(full, SCHEMA)


def words(text):
    return [w.translate({i: i + 32 for i in range(65, 91)}) for w in WORD.findall(text or "")]


def prose(r, n):
    return " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(2, 7))) for _ in range(n))


def test_word_hashes():
    for text in ["", " ", "A a", "b\tc\x0bd", "é È é", "x" * 600_000 + " y", "ab " * 300_000, "a b c"]:
        w, h = words(text), C.word_hashes(text).tolist()
        assert len(w) == len(h)
        assert len(set(zip(w, h, strict=True))) == len(set(w)) == len(set(h))


def test_language_accuracy(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = L.op1_language_id(spark, sf).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in out if r.held_out]
    assert len(out) == docs.count() and held
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in out)
    assert sum(r.lang == r.lang_pred for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in out)


def test_language_edges(spark):
    rows = [(1, "the cat and the dog", "en"), (2, "der hund und die katze", "de"), (3, None, "en"), (4, "", None), (5, "12 34 !", "de"), (6, "the dog", None), (6, "the dog", None), (7, "the cat " * 50_000, None)]
    docs = docs_of(spark, rows)
    out = {r.doc_id: (r.lang_pred, r.score) for r in L.identify(docs, L.learn(docs)).collect()}
    assert [out[k][0] for k in (1, 2, 3, 4, 5, 6, 7)] == ["en", "de", "und", "und", "und", "en", "en"]
    assert out[3][1] == 0
    assert L.identify(docs.limit(0), {}).count() == 0
    assert {r.lang_pred for r in L.identify(docs, {}).collect()} == {"und"}


def test_language_equals_plain_distances(spark, sf):
    """Profiles and out-of-place distances counted letter by letter."""

    def grams(text):
        letters = "".join(c.lower()[0] if c.isalpha() else " " for c in text or "")
        padded = " " + " ".join(letters.split()) + " "
        return collections.Counter(padded[i : i + n] for n in (1, 2, 3) for i in range(len(padded) - n + 1) if padded[i : i + n].strip()) if letters.strip() else {}

    def code(g):  # ties go by this number
        return sum((0 if c == " " else ord(c)) << 18 * (len(g) - 1 - i) for i, c in enumerate(g)) | {1: 1 << 60, 2: 1 << 61, 3: 0}[len(g)]

    top = lambda counts: sorted(counts, key=lambda g: (-counts[g], code(g)))[: L.PROFILE]
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang")
    learned = {}
    for r in docs.where(~L.held_out()).collect():
        if r.lang is not None and r.text is not None:
            learned.setdefault(r.lang, collections.Counter()).update(grams(r.text))
    places = {k: {g: i for i, g in enumerate(top(c))} for k, c in learned.items()}
    out = {r.doc_id: r for r in L.op1_language_id(spark, sf).collect()}
    for r in docs.collect():
        own = top(grams(r.text))
        far = {k: sum(min(abs(p[g] - i), L.PROFILE) if g in p else L.PROFILE for i, g in enumerate(own)) for k, p in places.items()}
        best = min(sorted(far), key=far.get) if own else "und"
        assert out[r.doc_id].lang_pred == best
        assert out[r.doc_id].score == (pytest.approx(1 - far[best] / (L.PROFILE * len(own))) if own else 0)


def test_language_ties_go_to_the_first_name(spark):
    docs = docs_of(spark, [(1, "abab", "y"), (2, "abab", "x"), (3, "abab", None)])
    assert {r.lang_pred for r in L.identify(docs, L.learn(docs)).collect()} == {"x"}


def brute_groups(rows, percent=75):
    sets, parent = {}, {}
    for k, t in rows:
        w = words(t)
        sets[k] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
        parent[k] = k

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {k: (len(sets[k]), find(k)) for k in keys}


def near_rows(seed=3):
    r, rows, k = random.Random(seed), [], 0
    for _ in range(12):
        base = prose(r, r.randint(3, 150)).split()
        for _ in range(r.randint(1, 12)):
            own = list(base)
            for _ in range(r.randint(0, 6)):
                own[r.randrange(len(own))] = prose(r, 1)
            rows.append((k, " ".join(own) if r.random() < 0.8 else "  ".join(own).upper()))
            k += 1
    return [*rows, (k, None), (k + 1, ""), (k + 2, " \n"), (k + 3, "one"), (k + 4, "ONE"), (k + 5, prose(r, 20_000))]


def test_near_duplicates_equal_brute_force(spark):
    rows = near_rows()
    out = N.near_duplicates(docs_of(spark, rows)).collect()
    truth = brute_groups(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in out} == truth
    assert all(r.kept == (r.doc_id == r.component_id) for r in out)


def test_near_duplicates_edges(spark):
    rows = [(5, "a b c d e f"), (5, "a b c d e f"), (None, "a b c d e f"), (7, "A b C d e f"), (8, None)]
    out = sorted(map(tuple, N.near_duplicates(docs_of(spark, rows)).collect()), key=str)
    assert out == sorted([(5, 2, 5, True), (5, 2, 5, True), (7, 2, 5, False), (8, 0, 8, True), (None, 2, 5, False)], key=str)
    assert N.near_duplicates(docs_of(spark, rows).limit(0)).count() == 0


def test_near_duplicates_versions_of_a_key(spark):
    """Rows that repeat a key with other texts are documents of their own: none of their links is lost."""
    r = random.Random(12)
    a, b = prose(r, 60), prose(r, 60)
    near = lambda t: t + " zzz"
    rows = [(5, a), (5, b), (7, near(a)), (9, near(b)), (11, prose(r, 60))]
    out = sorted((x.doc_id, x.component_id, x.kept) for x in N.near_duplicates(docs_of(spark, rows)).collect())
    assert out == [(5, 5, True), (5, 5, True), (7, 5, False), (9, 5, False), (11, 11, True)]


def test_signature_estimates_similarity():
    import numpy as np

    r = np.random.default_rng(1)
    off = []
    for _ in range(100):
        x = r.integers(0, 1 << 63, 300, dtype=np.uint64)
        j = int(r.integers(150, 290))
        y = np.concatenate([x[:j], r.integers(0, 1 << 63, 300 - j, dtype=np.uint64)])
        off.append(float((N.min_max_signature(x, 112) == N.min_max_signature(y, 112)).mean()) - j / (600 - j))
    assert abs(float(np.mean(off))) < 0.02 and float(np.std(off)) < 0.06


def repeated_windows(rows, n=50):
    """(doc, position) of each n-word window that a document with a smaller key has."""
    first, out = {}, []
    for k, t in sorted((k, t) for k, t in rows if k is not None and t):
        w, own = words(t), set()
        for i in range(len(w) - n + 1):
            g = tuple(w[i : i + n])
            (out.append((k, i)) if g in first else own.add(g))
        for g in own:
            first.setdefault(g, k)
    return out


def passage_rows(seed=9):
    r = random.Random(seed)
    shared = [prose(r, n) for n in (51, 60, 120, 55)]
    line = prose(r, 13)
    rows = []
    for k in range(60):
        parts = [prose(r, r.randint(20, 120))]
        if k % 2:
            parts.append(line)
        if k % 3 == 0:
            parts.insert(r.randint(0, len(parts)), r.choice(shared))
        rows.append((k, r.choice(["\n", " "]).join([*parts, prose(r, 30)])))
    return [*rows, (60, None), (61, ""), (62, "short"), (63, rows[4][1]), (64, prose(r, 20_000) + " " + shared[2]), (65, (line + "\n") * 12), (66, (line + "\n") * 12)]


def test_repeats_equal_brute_force(spark):
    rows = passage_rows()
    found = {r.doc_id: [(s.lo, s.hi) for s in r.spans] for r in D.repeated_spans(docs_of(spark, rows)).collect()}
    truth = repeated_windows(rows)
    assert truth
    for k, i in truth:
        assert any(lo <= i and i + 50 <= hi for lo, hi in found.get(k, [])), (k, i)
    assert set(found) == {k for k, _ in truth}  # clean documents are left alone
    cleaned = D.remove_repeats(docs_of(spark, rows))
    assert cleaned.columns == docs_of(spark, []).columns
    out = {r.doc_id: r.text for r in cleaned.collect()}
    assert not repeated_windows([(k, t) for k, t in out.items() if k not in found])
    gone = {k for k, _ in rows if k not in out}
    assert gone == {63, 66}
    assert all(out[k] == t for k, t in rows if k not in found)


def test_repeats_edges(spark):
    r = random.Random(2)
    p = prose(r, 70)
    rows = [(1, p), (1, p), (None, p), (2, None)]
    assert D.repeated_spans(docs_of(spark, rows)).count() == 0
    assert sorted(str(x.doc_id) for x in D.remove_repeats(docs_of(spark, rows)).collect()) == ["1", "1", "2", "None"]
    assert D.remove_repeats(docs_of(spark, rows).limit(0)).count() == 0
    edited = p.split()
    edited[35] = "zzz"
    near = D.repeated_spans(docs_of(spark, [(1, p), (2, " ".join(edited))]), window=30).collect()
    assert [(r.doc_id, r.removed_words) for r in near] == [(2, 70)]


def test_repeats_of_versions(spark):
    r = random.Random(5)
    p, q = prose(r, 70), prose(r, 80)
    rows = [(1, p + " " + q), (3, p + " one"), (3, q + " two"), (None, p)]
    out = D.repeated_spans(docs_of(spark, rows)).collect()
    assert sorted((x.doc_id, x.removed_words) for x in out) == [(3, 70), (3, 80)]
    docs = docs_of(spark, rows).select("doc_id", "text")
    assert sorted((str(x.doc_id), x.text) for x in D.remove_repeats(docs).collect()) == sorted([("1", rows[0][1]), ("3", "one"), ("3", "two"), ("None", p)])


def test_passages_of_lines_that_fill_buckets(spark):
    """Similar, not equal, passages made of lines that many documents hold: recall is measured, and equal ones are all found."""
    r = random.Random(21)
    lines = [prose(r, 26) for _ in range(14)]
    rows = [(k, "\n".join([prose(r, 30), lines[k % 14], prose(r, 30)])) for k in range(140)]
    pairs = []
    for k in range(140, 200, 2):
        passage = " ".join(r.sample(lines, 3)).split()
        changed = list(passage)
        if k % 4:
            changed[r.randint(5, 70)] = "zz"
        for own, words_ in ((k, passage), (k + 1, changed)):
            rows.append((own, " ".join([prose(r, 40), *words_, prose(r, 40)])))
        pairs.append((k, k + 1, k % 4 == 0))
    spans = {x.doc_id: x.removed_words for x in D.repeated_spans(docs_of(spark, rows)).collect()}
    assert all(spans.get(b, 0) >= 50 for _, b, equal in pairs if equal)
    near = [spans.get(b, 0) >= 50 for _, b, equal in pairs if not equal]
    assert sum(near) >= 0.9 * len(near), sum(near)


def near_passages(seed):
    """Two texts that share a passage of 50 to 80 words with a Jaccard similarity of 0.75 or more; its first and last words are equal."""
    r = random.Random(seed)
    while True:
        p = prose(r, r.randint(50, 80)).split()
        q = list(p)
        for _ in range(r.randint(1, 2)):
            i = r.randint(1, len(q) - 2)
            q[i : i + r.randint(0, 2)] = prose(r, r.randint(0, 2)).split() if r.random() < 0.8 else [q[i]] * 2
        x, y = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (p, q)]
        if p != q and len(q) >= 50 and p[-1] == q[-1] and 4 * len(x & y) >= 3 * len(x | y):
            return [" ".join([prose(r, 60), *w, prose(r, 60)]) for w in (p, q)]


def share(texts):
    """Whether two texts share a bucket, and the spans of the second that repeat."""
    both = [(w, D.shingles(w)) for w in map(C.word_hashes, texts)]
    return len(set(D.bucket_keys(texts[0])) & set(D.bucket_keys(texts[1]))) > 0, D.repeats(*both[0], *both[1])


def test_near_passages_meet_and_are_found():
    met, found = zip(*[share(near_passages(seed)) for seed in range(600)], strict=True)
    assert all(met)
    # the passage starts at word 60 of both; an edge behind an edit stays where the rest is long enough
    right = sum(any(lo < 70 and hi - lo >= 50 for lo, hi in spans) for spans in found)
    assert right >= 0.99 * len(found), right


def jaccard(p, q):
    g = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    return len(g(p) & g(q)) / len(g(p) | g(q))


@pytest.mark.parametrize(("size", "more"), [(80, 10), (80, 11), (80, 12), (80, 15), (90, 14), (98, 20), (200, 40), (60, 8)])
def test_long_edits_up_to_the_similarity(size, more):
    """One insertion, deletion or change of as many words as the similarity allows."""
    r = random.Random(size * more)
    for k in range(30):
        p = ["".join(r.choices("abcdefghijkl", k=7)) for _ in range(size)]
        new = ["".join(r.choices("mnopqrst", k=7)) for _ in range(more)]
        at = r.randint(size // 3, size - size // 3)
        q = [*p[:at], *new, *p[at:]] if k % 3 else [*p[:at], *new[: more // 2], *p[at + more // 2 :]]
        if jaccard(p, q) < 0.75:
            continue
        texts = [" ".join([prose(r, r.randint(0, 60)), *w, prose(r, r.randint(1, 60))]) for w in ((p, q) if k % 2 else (q, p))]
        met, spans = share(texts)
        assert met and sum(hi - lo for lo, hi in spans) >= 50


def test_recall_by_similarity():
    """Near passages with one to three edits of any length: nine in ten at least are found in each band of similarity."""
    r, found = random.Random(12), collections.defaultdict(list)
    for _ in range(1500):
        p = ["".join(r.choices("abcdefghijkl", k=6)) for _ in range(r.randint(50, 120))]
        q = list(p)
        for _ in range(r.randint(1, 3)):
            at, cut, new = r.randint(0, len(q)), r.choice([0, 0, 1, 2, 9]), r.choice([0, 1, 1, 3, 8, 14])
            q[at : at + cut] = ["".join(r.choices("mnopqrst", k=6)) for _ in range(new)]
        j = jaccard(p, q)
        if j < 0.75 or len(q) < 50 or p == q:
            continue
        met, spans = share([" ".join([prose(r, 30), *w, prose(r, 30)]) for w in (p, q)])
        found["0.75" if j < 0.8 else "0.8" if j < 0.9 else "0.9"].append(met and sum(hi - lo for lo, hi in spans) >= 45)
    assert set(found) == {"0.75", "0.8", "0.9"} and all(len(x) > 40 and sum(x) >= 0.9 * len(x) for x in found.values()), {k: (sum(x), len(x)) for k, x in found.items()}


@pytest.mark.parametrize("at", [1, 3, 4, 20, 46, 48])
def test_passage_edited_near_its_edge(at):
    r = random.Random(at)
    p = prose(r, 50).split()
    q = [*p[:at], "zzzzzzzz", *p[at + 1 :]]
    met, spans = share([" ".join([prose(r, 60), *w, prose(r, 60)]) for w in (p, q)])
    assert met and spans == [(60, 110)]


def brute_targets(sizes):
    order = sorted((s for s in sizes if s is not None), key=str) + ([None] if None in sizes else [])
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    goal, done = 1.5 * sum(sizes.values()), {}
    while True:
        rest = [s for s in order if s not in done]
        level = (goal - sum(done.values())) / sum(weight[s] for s in rest) if rest else 0
        over = [s for s in rest if level * weight[s] > 2 * sizes[s]]
        if not over:
            return done | {s: level * weight[s] for s in rest}
        done |= {s: 2.0 * sizes[s] for s in over}


def mix_rows():
    r = random.Random(4)
    rows = [(k, prose(r, r.randint(1, 60)), None, r.choice(["a", "b", "b", "b", "c", "Z", None])) for k in range(300)]
    return [*rows, (300, None, None, "a"), (301, "", None, "q"), (302, prose(r, 5000), None, "b"), (303, "x y", None, "d"), (303, "x y", None, "d"), (None, "x y z", None, "d")]


def test_mixing_targets_and_draws(spark):
    rows = mix_rows()
    docs = docs_of(spark, rows)
    out = M.mixing_plan(docs).collect()
    assert len(out) == len(rows)
    sizes, taken = collections.Counter(), collections.Counter()
    for _, t, _, s in rows:
        sizes[s] += len(words(t))
    truth = brute_targets(dict(sizes))
    by_key = {k: s for k, _, _, s in rows}
    for r in out:
        s = by_key[r.doc_id]
        taken[s] += r.taken
        assert r.source_size == sizes[s] and r.target == pytest.approx(truth[s]) and 0 <= r.taken <= 2 * r.size
        assert sum(p.words for p in r.pieces) == r.taken
    assert all(abs(taken[s] - truth[s]) <= 0.5 for s in truth)
    again = M.mixing_plan(docs.repartition(7)).collect()
    assert sorted(map(str, again)) == sorted(map(str, out))
    mixed = M.mix(docs)
    assert mixed.columns == docs.columns
    assert sum(len(words(r.text)) for r in mixed.collect()) == sum(taken.values())
    assert M.mixing_plan(docs.limit(0)).count() == 0 and M.mix(docs.limit(0)).count() == 0
    empty = M.mixing_plan(docs_of(spark, [(1, None), (2, "")])).collect()
    assert [(r.size, r.target, r.taken) for r in empty] == [(0, 0.0, 0)] * 2


def test_mixing_rows_without_keys_and_equal_rows(spark):
    """Rows that have no key are spread over shards, each with its own text; equal rows are taken as often as their plans say."""
    r = random.Random(12)
    rows = [(None, prose(r, 30), None, "a") for _ in range(60)] + [(7, "same words here", None, "b")] * 90 + [(None, None, None, "a")] * 5
    docs = docs_of(spark, rows)
    plan = M.mixing_plan(docs, carried=("text",)).collect()
    assert len(plan) == len(rows) and len({p.shard for x in plan if x.doc_id is None for p in x.pieces}) > 1
    assert len({p.place for x in plan if x.doc_id is None for p in x.pieces}) > 60
    truth = collections.Counter()
    for x in plan:
        for p in x.pieces:
            truth[x.doc_id, x.text if p.words == x.size else " ".join(WORD.findall(x.text)[: p.words])] += 1
    mixed = M.mix(docs)
    assert collections.Counter((x.doc_id, x.text) for x in mixed.collect()) == truth and truth[7, "same words here"] > 90
    assert collections.Counter((x.doc_id, x.text) for x in M.mix(docs.repartition(9)).collect()) == truth
    assert "collect_list" not in mixed._jdf.queryExecution().executedPlan().toString()


def test_tree_keeps_quotas(spark):
    q = spark.createDataFrame([(1, 500), (2, 0), (3, 37), (4, 1)], "rank int, quota bigint")
    got = M.split_quotas(q, 8).collect()
    by_rank, by_shard = collections.Counter(), collections.Counter()
    for r in got:
        by_rank[r["rank"]] += r.n
        by_shard[r.shard] += r.n
        assert r.n >= 0
    assert by_rank == {1: 500, 2: 0, 3: 37, 4: 1}
    assert len(by_shard) == 8 and max(by_shard.values()) - min(by_shard.values()) <= 3


def test_hypergeometric_draws(spark):
    """Inversion at a grid of u gives the distribution."""
    from math import comb

    n = 4000
    draw = M.hypergeometric("20L", "8L", "6L", "u")
    got = collections.Counter(r[0] for r in spark.range(n).selectExpr(f"(id + 0.5D) / {n} AS u").selectExpr(f"{draw} AS x").collect())
    for x in range(7):
        assert got[x] / n == pytest.approx(comb(8, x) * comb(12, 6 - x) / comb(20, 6), abs=1e-3)


@pytest.mark.parametrize("shards", [1, 5, 24])
def test_sharding(spark, shards):
    r = random.Random(8)
    rows = [(k, prose(r, r.randint(1, 80))) for k in range(1500)]
    rows += [(k, "same text here") for k in range(1500, 2300)] + [(2300, None), (2301, None), (2302, ""), (2302, ""), (None, "é"), (2303, prose(r, 3000))]
    out = H.shard_documents(docs_of(spark, rows), shards).collect()
    assert len(out) == len(rows)
    loads, slots, groups = collections.Counter(), collections.defaultdict(list), collections.defaultdict(set)
    texts = dict(rows)
    for x in out:
        t = texts[x.doc_id]
        assert x["size"] == 8 + len((t or "").encode()) and x.text_crc32 == (None if t is None else zlib.crc32(t.encode()))
        loads[x.shard] += x["size"]
        slots[x.shard].append(x.slot)
        groups[t].add(x.shard)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(g) == 1 for g in groups.values())
    assert set(loads) == set(range(shards))
    group = 800 * 22  # the largest group may be more than a shard's share
    rest = sorted(loads.values())[:-1] if group > sum(loads.values()) / shards else sorted(loads.values())
    assert max(loads.values()) <= max(group, 1.05 * sum(loads.values()) / shards + 30)
    assert not rest or rest[-1] - rest[0] <= 0.05 * sum(loads.values()) / shards + 30
    assert H.shard_documents(docs_of(spark, rows).limit(0), shards).count() == 0


@pytest.mark.parametrize("shards", [3, 24])
def test_sharding_against_one_heap(spark, shards):
    """The tree of schedules is as even as one longest-processing-time schedule over all groups, but for a small group's size."""
    import heapq

    r = random.Random(3)
    rows = [(k, prose(r, r.choice([1, 5, 30, 200]))) for k in range(900)] + [(900 + k, f"copy {k % 20}") for k in range(300)]
    groups = collections.Counter()
    for _, t in rows:
        groups[t] += 8 + len(t.encode())
    heap = [0] * shards
    for load in sorted(groups.values(), reverse=True):
        heapq.heapreplace(heap, heap[0] + load)
    out = collections.Counter()
    for x in H.shard_documents(docs_of(spark, rows), shards).collect():
        out[x.shard] += x["size"]
    assert sum(out.values()) == sum(heap)
    assert max(out.values()) <= max(heap) + max(16, sum(heap) // shards // 50)


def test_column_names_of_the_callers_are_kept(spark):
    r = random.Random(8)
    same = prose(r, 70)
    rows = [(k, f"{prose(r, 20)} {same}", "s", k, f"keep{k}", "a", "b", "c", "d") for k in range(3)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, `__size` bigint, `__row` string, `__spans` string, `__cut` string, h string, `__k` string")
    mixed = M.mix(docs)
    assert mixed.columns == docs.columns and all(x["__row"] == f"keep{x.doc_id}" and x["__size"] == x.doc_id and x.h == "c" for x in mixed.collect())
    left = D.remove_repeats(docs).orderBy("doc_id").collect()
    assert [x["__row"] for x in left] == ["keep0", "keep1", "keep2"] and all((x["__spans"], x["__cut"], x.h, x["__k"]) == ("a", "b", "c", "d") for x in left)
    assert same in left[0].text and same not in left[1].text + left[2].text
