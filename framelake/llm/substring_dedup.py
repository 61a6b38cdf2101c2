"""Substring deduplication by MinHash banding of paragraphs.

A paragraph is any WINDOW neighbouring words of a document, so that a repeated passage is found
wherever it stands, inside a line or across lines. A paragraph's set is its word shingles; its signature
has, for each of its parts of part_width() neighbouring shingles, the minimum and the maximum under one permutation and the
minimum under another, sliding along the text. The three values of a part are a band, so a paragraph of 50 words has 33 bands.
Two paragraphs of a Jaccard similarity of 0.75 that differ by changed, inserted, deleted or doubled words have an equal
part between two edits, and so share a band for certain. Neighbouring paragraphs share most bands: a document
enters about one bucket for three words.

In each bucket, every document is paired with the bucket's smallest, a star. Each pair's texts are
aligned by their shingles, and passages of at least WINDOW words, from the first to the last equal word, with an exact Jaccard
similarity of 0.75 or more are repeats: the document with the larger key loses them. A bucket is settled by a document if the
part that brought it there lies in a repeat with the star. All documents of a bucket that is not settled by one of them
(a short line that many texts hold can fill a bucket) meet again in two ways: in buckets of equal paragraphs, by
the hashes of all their paragraphs that hold such a part, where stars can't fail (of an equal paragraph that no bucket has settled, some part is in a bucket that is not); and, for paragraphs that are only similar, in narrower buckets of the first one's key with a
minimum over the shingles next to the part, on either side and under several permutations. No bucket is paired with itself. What can be missed is
a similar, not equal, paragraph of two documents if all buckets that they share, narrower ones too, have a star unlike both: a
paragraph of nothing but lines that fill buckets. A bucket that a good part of all documents enter is found in a sample and sorted in many tasks, each with a
star of its own; these stars then meet in the bucket. Connected components over verified pairs name the
cluster of each removal.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from framelake.llm.common import WORD, bounded_batches, connected_components, discard, frugal, materialize, slide, table, unused, word_hashes

#: Words of a shingle and of a paragraph, similarity in hundredths.
SHINGLE, WINDOW, PERCENT = 5, 50, 75
#: Minima on each side of a part that narrow a bucket which is not settled.
NARROW = 3
#: Documents that are sampled for buckets with many documents, documents in the sample that make a bucket one, and tasks that such a bucket is dealt to.
SAMPLED, HOT, SALTS = 4096, 32, 64

_random = np.random.default_rng(977)
_FACTORS = _random.integers(0, 1 << 31, 2 + NARROW, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_MASKS = _random.integers(0, 1 << 32, 2 + NARROW, dtype=np.uint32)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def shingles(words: np.ndarray, n: int = SHINGLE, at: np.ndarray | None = None) -> np.ndarray:
    """Hashes of the n-word shingles in order, or of those that begin at the given places, from the words' hashes."""
    if len(words) < n:
        return np.zeros(0, dtype=np.uint64)
    out = words[: len(words) - n + 1].copy() if at is None else words[at]
    for k in range(1, n):
        out *= _MIX
        out ^= out >> np.uint64(29)
        out += words[k : len(words) - n + 1 + k] if at is None else words[at + k]
    out ^= out >> np.uint64(32)
    out *= np.uint64(0xD6E8FEB86659FD93)
    return out


def part_width(window: int = WINDOW, percent: int = PERCENT, n: int = SHINGLE) -> int:
    """Shingles that two paragraphs of the given similarity or more have in one equal run, whatever words are edited.

    Of the union of both sets at least percent is shared. An edit between two runs costs 2n-3 shingles or more
    (a doubled word; an inserted or deleted one costs 2n-1, a changed one 2n), so k edits need that many shared shingles
    for each, and the longest of k + 1 runs has at least its share of them.
    """
    width = window - n + 1
    least = -(-percent * width // 100)
    out = least
    if percent < 100:
        for k in range(1, width + 1):
            need = max(least, -(-k * (2 * n - 3) * percent // (100 - percent)))
            out = min(out, -(-need // (k + 1)))
    return max(1, out)


def part_keys(s: np.ndarray, window: int = WINDOW, percent: int = PERCENT, n: int = SHINGLE) -> np.ndarray:
    """The bucket key of the part that begins at each shingle; none for a text that is shorter than a paragraph."""
    if len(s) < window - n + 1:
        return np.zeros(0, dtype=np.int64)
    width = part_width(window, percent, n)
    x = (s >> np.uint64(32)).astype(np.uint32)
    first, second = [(x ^ m) * f for m, f in zip(_MASKS[:2], _FACTORS[:2], strict=True)]
    key = np.ones(len(s) - width + 1, dtype=np.uint64)
    for v in (slide(first, width, np.minimum), slide(first, width, np.maximum), slide(second, width, np.minimum)):
        key = (key ^ v.astype(np.uint64)) * _MIX
        key ^= key >> np.uint64(31)
    return key.view(np.int64)


def bucket_keys(text: str | None, window: int = WINDOW, percent: int = PERCENT, n: int = SHINGLE) -> np.ndarray:
    """The distinct bucket keys of all paragraphs of the whole text; none for a shorter text."""
    return np.unique(part_keys(shingles(word_hashes(text), n), window, percent, n))


def narrower_keys(text: str | None, buckets: np.ndarray, window: int = WINDOW, percent: int = PERCENT, n: int = SHINGLE) -> np.ndarray:
    """For each part of the text in one of the buckets: its key with each of NARROW minima over the shingles on its left, and on its right.

    A paragraph's shingles that a part leaves stand at least half on one side of it, so that half of their number is looked at on either.
    """
    s = shingles(word_hashes(text), n)
    keys = part_keys(s, window, percent, n)
    if not len(keys):
        return keys
    width = part_width(window, percent, n)
    side = max(1, (window - n + 1 - width + 1) // 2)
    at = np.flatnonzero(_among(keys, np.sort(buckets)))
    at = at[np.concatenate([[True], keys[at[1:]] != keys[at[:-1]]])] if len(at) else at
    x = (s >> np.uint64(32)).astype(np.uint32)
    out = [np.zeros(0, dtype=np.int64)]
    for k in range(NARROW):
        low = slide((x ^ _MASKS[2 + k]) * _FACTORS[2 + k], side, np.minimum)
        for place, places in ((1, at - side), (2, at + width)):
            here = (places >= 0) & (places < len(low))
            made = (keys[at[here]].view(np.uint64) ^ (low[places[here]].astype(np.uint64) + np.uint64((2 * k + place) << 32))) * _MIX
            out.append((made ^ (made >> np.uint64(31))).view(np.int64))
    return np.unique(np.concatenate(out))


def unsettled(keys_a: np.ndarray, keys_b: np.ndarray, spans: list[tuple[int, int]], window: int = WINDOW, percent: int = PERCENT, n: int = SHINGLE) -> np.ndarray:
    """The distinct keys of parts of b that a (whose keys are sorted) has as well, if one of these parts lies in no span of b by a shingle or more."""
    at = np.flatnonzero(_among(keys_b, keys_a))
    words, open_ = part_width(window, percent, n) + n - 1, np.ones(len(at), dtype=bool)
    for lo, hi in spans:
        open_ &= ~((np.minimum(at + words, hi) - np.maximum(at, lo)) >= n)
    return np.unique(keys_b[at[open_]])


def _among(keys: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which keys are among the known ones, which are sorted."""
    if not len(known):
        return np.zeros(len(keys), dtype=bool)
    return known[np.minimum(np.searchsorted(known, keys), len(known) - 1)] == keys


def paragraph_hashes(text: str | None, buckets: np.ndarray, window: int = WINDOW, percent: int = PERCENT, n: int = SHINGLE) -> np.ndarray:
    """The distinct hashes of the paragraphs of the whole text that hold a part in one of the buckets, each of its words in order."""
    words = word_hashes(text)
    hit = _among(part_keys(shingles(words, n), window, percent, n), np.sort(buckets))
    if not hit.any():
        return np.zeros(0, dtype=np.int64)
    held = slide(hit.astype(np.uint8), window - n + 2 - part_width(window, percent, n), np.maximum)
    return np.unique(shingles(words, window, np.flatnonzero(held))).view(np.int64)


def _equal_ends(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Where equal words behind an edit end, as words of a and of b from the edge of a run outwards; no edit comes first.

    An edit changes as many words as it takes out, or puts in or takes out any number, or replaces up to three words by another number of them.
    """
    m = min(len(a), len(b))
    same = np.concatenate([a[:m] == b[:m], [False]])
    out = [(0, 0)] + [(k, k) for k in (np.flatnonzero(same[:-1] & ~same[1:]) + 1).tolist()]
    shifts = [(i, 0) for i in range(1, len(a))] + [(0, j) for j in range(1, len(b))] + [(i, j) for i in range(1, 4) for j in range(1, 4) if i != j]
    for i, j in shifts:
        if i < len(a) and j < len(b) and a[i] == b[j]:
            m = min(len(a) - i, len(b) - j)
            k = int(np.concatenate([a[i : i + m] == b[j : j + m], [False]]).argmin())
            out.append((i + k, j + k))
    return out


def _feasible(shared: list[int], gaps: list[float], per_gap: float) -> list[tuple[int, int]]:
    """Stretches (from, to) between gaps that no similar passage can hold.

    A passage of stretches needs per_gap shared shingles for each one that a gap takes. A gap can be in one only if the best
    run of stretches that ends before it and the best one that begins behind it have enough.
    """
    left, right = [float(shared[0])], [float(shared[-1])]
    for s, g in zip(shared[1:], gaps, strict=True):
        left.append(s + max(0.0, left[-1] - per_gap * g))
    for s, g in zip(shared[-2::-1], gaps[::-1], strict=True):
        right.append(s + max(0.0, right[-1] - per_gap * g))
    right.reverse()
    cuts = [k + 1 for k, g in enumerate(gaps) if left[k] + right[k + 1] < per_gap * g]
    return list(zip([0, *cuts], [*cuts, len(shared)], strict=True))


def repeats(words_a: np.ndarray, a: np.ndarray, words_b: np.ndarray, b: np.ndarray, window: int = WINDOW, percent: int = PERCENT, n: int = SHINGLE) -> list[tuple[int, int]]:
    """Word spans (from, to) of the second text that repeat in the first, given both texts' word hashes and shingles.

    Shingles of b that a has make stretches along diagonals. Stretches are joined over gaps of any length that the similarity allows, and a
    passage counts if it has window words and the exact Jaccard similarity of its set and that of the span of a
    that it lies on suffices; else fewer stretches are tried, the longest row of them first. Where a few words
    lack, the passage goes on over an edit near its edge, behind which are too few equal words for a shingle.
    """
    if not len(a) or not len(b):
        return []
    least = -(-percent * (window - n + 1) // 100)
    order = np.argsort(a, kind="stable")
    sorted_a = a[order]
    at = np.minimum(np.searchsorted(sorted_a, b), len(a) - 1)
    there = np.flatnonzero(sorted_a[at] == b)
    if len(there) < least:
        return []
    places = order[at[there]]
    # a shingle that a has several times goes on with its left neighbour's place where it can, else with its right one's
    several = np.flatnonzero(np.searchsorted(sorted_a, b[there], side="right") - at[there] > 1).tolist()
    for k in several:
        if k and there[k] - there[k - 1] == 1 and (p := places[k - 1] + 1) < len(a) and a[p] == b[there[k]]:
            places[k] = p
    for k in reversed(several):
        if k + 1 < len(there) and there[k + 1] - there[k] == 1 and (p := places[k + 1] - 1) >= 0 and places[k] != p and a[p] == b[there[k]]:
            if not (k and there[k] - there[k - 1] == 1 and places[k] == places[k - 1] + 1):
                places[k] = p
    steps_b, steps_a = np.diff(there), np.diff(places)
    broken = np.flatnonzero((steps_b != 1) | (steps_a != 1))
    starts, ends = np.concatenate([[0], broken + 1]), np.concatenate([broken + 1, [len(there)]])
    # shingles of both texts between two stretches; none can be joined to one that stands before it in a
    gaps = np.where(steps_a[broken] > 0, steps_a[broken] + steps_b[broken] - 2.0, np.inf)
    per_gap = percent / (100 - percent) if percent < 100 else np.inf
    # words that an edit near an edge can lie away from a run that is too short without what is behind it
    reach = window * (100 - percent) // max(percent, 1) + 1

    def similar(a0: int, a1: int, b0: int, b1: int) -> bool:
        x, y = np.unique(a[a0 : a1 - n + 1]), np.unique(b[b0 : b1 - n + 1])
        both = len(np.intersect1d(x, y, assume_unique=True))
        return 100 * both >= percent * (len(x) + len(y) - both)

    def passage(lo: int, hi: int) -> tuple[int, int] | None:
        a0, a1, b0, b1 = int(places[lo]), int(places[hi - 1]) + n, int(there[lo]), int(there[hi - 1]) + n
        if b1 - b0 >= window:
            return (b0, b1) if similar(a0, a1, b0, b1) else None
        left = _equal_ends(words_a[max(0, a0 - reach) : a0][::-1], words_b[max(0, b0 - reach) : b0][::-1])
        right = _equal_ends(words_a[a1 : a1 + reach], words_b[b1 : b1 + reach])
        longer = [(i + j + k + m, a0 - i, a1 + k, b0 - j, b1 + m) for i, j in left for k, m in right if b1 - b0 + j + m >= window]
        for _, *span in sorted(longer):
            if similar(*span):
                return span[2], span[3]
        return None

    rows = [(0, 1)] if len(starts) == 1 else _feasible((ends - starts).tolist(), gaps.tolist(), per_gap)
    out = []
    for first, last in rows:
        lo, hi = int(starts[first]), int(ends[last - 1])
        if hi - lo < least or there[hi - 1] + n - there[lo] < least + n - 1:
            continue
        if found := passage(lo, hi):
            out.append(found)
            continue
        i = first
        while i < last:
            shared = np.cumsum(ends[i:last] - starts[i:last])
            in_a, in_b = places[ends[i:last] - 1] - places[starts[i]] + 1, there[ends[i:last] - 1] - there[starts[i]] + 1
            may = np.flatnonzero((100 * shared >= percent * (in_a + in_b - shared)) & (in_b >= least))
            end = next((int(k) for k in may[::-1] if (found := passage(int(starts[i]), int(ends[i + k])))), None)
            if end is not None:
                out.append(found)
                i += end
            i += 1
    return out


def without_spans(text: str, spans: list[tuple[int, int]]) -> str:
    """text without the words of the spans and the white space behind each of these words."""
    ends = [m.start() for m in WORD.finditer(text)] + [len(text)]
    out, at = [], 0
    for lo, hi in spans:
        out.append(text[at : ends[lo]])
        at = ends[min(hi, len(ends) - 1)]
    return "".join(out) + text[at:]


def joined_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for lo, hi in sorted(spans):
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(hi, out[-1][1]))
        else:
            out.append((lo, hi))
    return out


def _verified(pairs: DataFrame, docs: DataFrame, window: int, percent: int, open_too: bool) -> DataFrame:
    """(a, b, h, spans, open): b's spans that repeat in a, and with open_too the buckets of both that these don't settle, for the pairs that have any; h tells versions of b apart."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        nothing = np.zeros(0, dtype=np.int64)
        last: tuple = (None, None, None, None)
        for batch in batches:
            out = []
            for a, b, h, ta, tb in batch.itertuples(index=False):
                if last[0] != ta:
                    words = word_hashes(ta)
                    s = shingles(words)
                    last = (ta, words, s, np.unique(part_keys(s, window, percent)) if open_too else nothing)
                words_b = word_hashes(tb)
                s = shingles(words_b)
                found = repeats(last[1], last[2], words_b, s, window, percent)
                left = unsettled(last[3], part_keys(s, window, percent), found, window, percent) if open_too else nothing
                if found or len(left):
                    out.append((a, b, h, [{"lo": lo, "hi": hi} for lo, hi in found], left))
            yield pd.DataFrame(out, columns=["a", "b", "h", "spans", "open"])

    # both joins read one exchange of the texts
    joined = pairs.join(docs.alias("y"), F.col("b") == F.col("y.k")).select("a", "b", F.col("y.t").alias("tb"))
    joined = joined.join(docs.alias("x"), F.col("a") == F.col("x.k")).select("a", "b", F.xxhash64("tb").alias("h"), F.col("x.t").alias("ta"), "tb")
    return joined.mapInPandas(frugal(run), "a bigint, b bigint, h bigint, spans array<struct<lo:int,hi:int>>, open array<bigint>")


def _keyed(docs: DataFrame, keys_of: Callable[..., np.ndarray], hot: np.ndarray) -> DataFrame:
    """(bucket, salt, k) for each key that keys_of() gives for a row of docs (k, t, and what else it takes); salt is -1 but for hot buckets."""
    given = [c for c in docs.columns if c != "k"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column("k").to_numpy()
            made = [keys_of(*row) for row in zip(*[batch.column(c).to_pylist() for c in given], strict=True)]
            bucket = np.concatenate([np.zeros(0, dtype=np.int64), *made])
            k = np.repeat(own, [len(x) for x in made])
            salt = np.full(len(k), -1, dtype=np.int32)
            if len(hot):
                many = np.isin(bucket, hot)
                salt[many] = (k[many].view(np.uint64) * _MIX >> np.uint64(40)).astype(np.int64) % SALTS
            for at in range(0, len(k), 1 << 17):
                yield pa.record_batch({"bucket": bucket[at : at + (1 << 17)], "salt": salt[at : at + (1 << 17)], "k": k[at : at + (1 << 17)]})

    return docs.mapInArrow(frugal(run), "bucket bigint, salt int, k bigint")


def _stars(docs: DataFrame, keys_of: Callable[..., np.ndarray], name: str) -> DataFrame:
    """(bucket, a, b), stored: a bucket's star, its smallest document, with each other one; in a hot bucket a star of the document's share, and these with the bucket's."""
    total = docs.count()
    sample = docs if total <= SAMPLED else docs.where(F.pmod(F.xxhash64(F.lit("sample"), F.col("k")), F.lit(total // SAMPLED)) == 0)
    counted = _keyed(sample, keys_of, np.zeros(0, dtype=np.int64)).groupBy("bucket").count().where(F.col("count") >= HOT)
    hot = np.array(sorted(r[0] for r in counted.orderBy(F.desc("count"), "bucket").limit(4096).collect()), dtype=np.int64) if total > HOT else np.zeros(0, dtype=np.int64)
    # the running first value needs no buffer: a bucket streams by, however many documents it has
    so_far = lambda *by: Window.partitionBy(*by).orderBy("k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    starred = _keyed(docs, keys_of, hot).withColumn("star", F.first("k").over(so_far("bucket", "salt")))
    first = materialize(starred.where("k <> star OR salt >= 0"), name)
    tops = first.where("k = star").select("bucket", "k").withColumn("star", F.first("k").over(so_far("bucket")))
    out = first.where("k <> star").select("bucket", F.col("star").alias("a"), F.col("k").alias("b")).union(tops.where("k <> star").select("bucket", F.col("star").alias("a"), F.col("k").alias("b")))
    out.stored_at = first.stored_at
    return out


def repeated_spans(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, percent: int = PERCENT) -> DataFrame:
    """(key, h, spans, removed_words, cluster_id) for each document that loses something.

    spans are disjoint word positions (from, to) to remove; h is xxhash64 of the text that they
    belong to; cluster_id is the smallest key that repeats connect. A passage stays in the smallest key that holds it. Rows that
    repeat a key are versions of one document and not compared to each other. Rows with a null key, a null text or
    fewer words than a paragraph lose nothing.
    """
    bounded_batches(docs.sparkSession)
    rows = docs.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key).cast("bigint").alias("k"), F.col(text).alias("t"))
    hits = _stars(rows, lambda t: bucket_keys(t, window, percent), "hits")
    pairs = materialize(hits.select("a", "b").distinct(), "pairs")
    found = materialize(_verified(pairs, rows, window, percent, True), "repeats")
    # documents of buckets that one of them does not settle
    open_ = found.select(F.explode("open").alias("bucket")).distinct()
    mixed = hits.join(open_, "bucket", "left_semi")
    mixed = materialize(mixed.select(F.col("b").alias("k"), "bucket").union(mixed.select("a", "bucket")).groupBy("k").agg(F.collect_set("bucket").alias("m")), "mixed")
    rest = materialize(rows.join(mixed, "k"), "rest")
    equal = _stars(rest.select("k", "t", "m"), lambda t, m: paragraph_hashes(t, np.array(m, dtype=np.int64), window, percent), "equal")
    near = _stars(rest.select("k", "t", "m"), lambda t, m: narrower_keys(t, np.array(m, dtype=np.int64), window, percent), "near")
    again = equal.select("a", "b").union(near.select("a", "b")).distinct()
    again = materialize(again.join(pairs, ["a", "b"], "left_anti"), "pairs")
    more = materialize(_verified(again, rest.select("k", "t"), window, percent, False), "repeats")
    every = found.union(more).where(F.size("spans") > 0)
    clusters = connected_components(every)
    discard(hits, pairs, mixed, rest, equal, near, again)

    @F.pandas_udf("array<struct<lo:int,hi:int>>")
    def union_of(lists: pd.Series) -> pd.Series:
        return pd.Series([[{"lo": lo, "hi": hi} for lo, hi in joined_spans([(s["lo"], s["hi"]) for s in x])] for x in lists])

    # a document has a span or a few for each document that it was compared to
    spans = every.groupBy("b", "h").agg(F.flatten(F.collect_set("spans")).alias("lists")).withColumn("spans", union_of("lists"))
    spans = spans.join(clusters, spans.b == clusters.node)
    total = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["hi"] - s["lo"])
    return spans.select(F.col("b").alias(key), "h", "spans", total.alias("removed_words"), F.col("component").alias("cluster_id"))


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, percent: int = PERCENT) -> DataFrame:
    """docs without their repeated passages; the columns stay.

    A document that loses all its words goes; every other row stays, and one without a repeat has
    its text as it was, nulls and empty texts included.
    """
    free = unused(docs, "k", "h", "spans", "cut")
    spans = materialize(repeated_spans(docs, key, text, window, percent), "spans").select(F.col(key).alias(free["k"]), F.col("h").alias(free["h"]), F.col("spans").alias(free["spans"]))

    @F.pandas_udf("string")
    def cut(texts: pd.Series, lists: pd.Series) -> pd.Series:
        return pd.Series([t if s is None or t is None else without_spans(t, [(x["lo"], x["hi"]) for x in s]) for t, s in zip(texts, lists, strict=True)])

    c = lambda name: F.col(f"`{name}`")
    joined = docs.join(spans, (c(key) == c(free["k"])) & (F.xxhash64(c(text)) == c(free["h"])), "left")
    joined = joined.withColumn(free["cut"], cut(c(text), c(free["spans"])))
    joined = joined.where(c(free["spans"]).isNull() | c(free["cut"]).rlike(r"[^\x20\x09-\x0D]"))
    return joined.select(*[F.when(c(free["spans"]).isNull(), c(x)).otherwise(c(free["cut"])).alias(x) if x == text else c(x) for x in docs.columns])


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    spans = repeated_spans(docs).select(F.col("doc_id").alias("k"), "h", "spans", "removed_words", "cluster_id")
    own = docs.select("doc_id", F.xxhash64("text").alias("own"))
    out = own.join(spans, (F.col("doc_id") == F.col("k")) & (F.col("own") == F.col("h")), "left")
    return out.select("doc_id", F.coalesce("removed_words", F.lit(0)).alias("removed_words"), "spans", F.coalesce("cluster_id", "doc_id").alias("cluster_id"))
