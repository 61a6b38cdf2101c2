"""The pipeline's stages against brute force."""

import hashlib
import struct
from collections import Counter

import public_tokenizers
import sentencepiece
from test_text_operators import brute_groups, brute_targets, repeated_windows, words

import corpus_pipeline as P


def similar_before(text, left, others, n=50):
    """Whether some window of n or more words that text has lost is similar to a window of one of the others."""
    own = words(text)
    lost = next(i for i, (x, y) in enumerate(zip(own, [*words(left), None], strict=False)) if x != y)
    grams = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    for size in (n, n + 10, len(own) - len(words(left))):
        mine = grams(own[lost : lost + size])
        for other in map(words, others):
            if len(mine & grams(other)) < len(mine) // 2:
                continue
            for at in range(0, max(1, len(other) - size + 1)):
                theirs = grams(other[at : at + size])
                if 100 * len(mine & theirs) >= 60 * len(mine | theirs):
                    return True
    return False


def test_stages(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, seen = docs.dtypes, {}
    for k, (name, stage) in enumerate(P.STAGES):
        stage(spark, docs, sf).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        seen[k] = docs.collect()
        if k < 4:
            assert docs.dtypes == columns, name
    before = spark.read.parquet(f"{sf}/documents.parquet").collect()
    lettered = {r.doc_id for r in before if any(c.isalpha() for c in r.text or "")}
    assert {r.doc_id for r in seen[0]} == lettered
    groups = brute_groups([(r.doc_id, r.text) for r in seen[0]])
    assert {r.doc_id for r in seen[1]} == {k for k, (_, c) in groups.items() if k == c}
    hit = {k for k, _ in repeated_windows([(r.doc_id, r.text) for r in seen[1]])}
    old = {r.doc_id: r.text for r in seen[1]}
    assert all(r.n_chars == len(r.text) for r in seen[2])
    assert all(len(words(r.text)) < len(words(old[r.doc_id])) for r in seen[2] if r.doc_id in hit)
    for r in seen[2]:  # what else is cut is similar to a passage of a document with a smaller key
        if r.doc_id not in hit and r.text != old[r.doc_id]:
            assert similar_before(old[r.doc_id], r.text, [old[k] for k in old if k < r.doc_id])
    sizes, taken = Counter(), Counter()
    for r in seen[2]:
        sizes[r.source] += len(words(r.text))
    for r in seen[3]:
        taken[r.source] += len(words(r.text))
    truth = brute_targets(dict(sizes))
    assert all(abs(taken[s] - t) <= 0.5 for s, t in truth.items())
    assert max(Counter(r.doc_id for r in seen[3]).values()) <= 2
    lib = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    digest = lambda t: hashlib.sha256(struct.pack(f"<{len(i := lib.encode(t, add_bos=True, add_eos=True))}I", *i)).hexdigest()
    assert Counter((r.doc_id, digest(r.text)) for r in seen[3]) == Counter((r.doc_id, r.ids_sha256) for r in seen[4])


def test_run(spark, sf):
    rows = P.run(spark, sf).collect()
    assert rows and all(len(r.ids) == r.n_tokens >= 2 for r in rows)


def test_stages_take_odd_rows(spark):
    """Nulls in any column, empty and very long texts, repeated rows and keys, columns that clash, and an empty table."""
    long = "der hund und die katze laufen durch den wald " * 4000
    other = " ".join(f"the{k} dog and the{k} cat" for k in range(40))
    passage = " ".join(f"and the house{k} of the man" for k in range(12))
    rows = [
        (None, other, "en", "a"),
        (None, other + " more", "en", None),
        (1, long, "de", "a"),
        (1, long, "de", "a"),
        (1, " ".join(f"the dog{k} runs with" for k in range(20)) + " " + passage, None, "b"),
        (2, None, "en", "b"),
        (3, "", None, None),
        (None, None, None, None),
        (4, "the cat sleeps " + passage + " " + " ".join(f"in a house{k} of" for k in range(20, 40)), "en", "b"),
        (5, "12 34", "de", "a"),
    ]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, k int, size string, component_id int, spans string, rank int, __k string"
    docs = spark.createDataFrame([(*r, None if r[1] is None else len(r[1]), 1, "x", 2, "y", 3, "z") for r in rows], schema)
    out, seen = docs, []
    for name, stage in P.STAGES:
        out = P.materialize(stage(spark, out, ""), "odd")
        seen.append(out.collect())
        if name != P.STAGES[-1][0]:
            assert out.dtypes == docs.dtypes, name
    texts = [r[1] for r in rows]
    assert sorted(r.text for r in seen[0]) == sorted(t for t in texts if t and any(c.isalpha() for c in t))
    stay = sorted((str(r.doc_id), r.text) for r in seen[1])
    assert stay[:3] == sorted([("1", long), ("1", texts[4]), ("4", texts[8])]) and len(stay) == 4 and stay[3][1] in texts[:2]
    kept = {(r.doc_id, r.text[:12]): r.text for r in seen[2]}
    assert kept[(1, texts[4][:12])] == texts[4] and passage not in kept[(4, texts[8][:12])] and len(seen[2]) == 4
    assert {r.doc_id for r in seen[3]} <= {None, 1, 4} and all(r.n_tokens >= 2 for r in seen[4])
    empty = docs.limit(0)
    for name, stage in P.STAGES:
        empty = P.materialize(stage(spark, empty, ""), "empty")
        assert empty.count() == 0, name
