"""MinHash near-duplicate detection with min-max hashing.

A document's set is its distinct word shingles. Each permutation (a multiply-xor mix of the 64-bit
shingle hash) gives two signature values, the minimum and the maximum, so a signature of 2k values
takes k evaluations a shingle. Bands of the signature make buckets. Candidates are checked on full
shingle sets, and documents that verified links connect form a group.

No bucket is paired with itself. First every member of a bucket is compared to the bucket's
smallest document, a star, as many pairs as members. Groups are formed, and only where a bucket still spans
several groups are the members outside its largest group compared to the others: by size, which must
allow the similarity, and by an estimate from a longer signature (of these documents only), which must come within
four standard deviations of the threshold; this happens inside tasks, block by block, and the pairs that pass are
checked in full. Every two members of a bucket thus end in one group or have been compared.

Equal documents (the same set of shingles) are one class, found by a hash of the set; links are looked for between classes. Classes
have numbers of their own, so rows that repeat a key with other texts are documents of their own too.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.llm.common import bounded_batches, connected_components, discard, frugal, grouped_stream, materialize, table, word_hashes

#: Words of a shingle, similarity in hundredths, bands and signature values of a band. At 0.75, four
#: values in each of 28 bands miss a pair once in 40,000 times; at 0.8 once in 3 million.
SHINGLE, PERCENT, BANDS, ROWS = 5, 75, 28, 4
#: Values of the longer signature, a byte of each is kept; standard deviations of its estimate that are allowed for.
SKETCH, DEVIATIONS = 1024, 4
#: Members of a bucket that meet in a task.
BLOCK = 512
_ODD = np.uint64(0x9E3779B97F4A7C15)


def shingle_hashes(text: str | None, n: int = SHINGLE) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct n-word shingles; fewer words are one shingle; none without words.

    A shingle's hash is a polynomial of its words' hashes.
    """
    h = word_hashes(text)
    if not len(h):
        return h
    n = min(n, len(h))
    out = h[: len(h) - n + 1].copy()
    for k in range(1, n):
        out *= _ODD
        out ^= out >> np.uint64(29)
        out += h[k : len(h) - n + 1 + k]
    out ^= out >> np.uint64(32)
    out *= np.uint64(0xD6E8FEB86659FD93)
    return np.unique(out)


_random = np.random.default_rng(20240229)
_FACTORS = _random.integers(0, 1 << 31, 512, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_MASKS = _random.integers(0, 1 << 32, 512, dtype=np.uint32)


def min_max_signature(hashes: np.ndarray, values: int) -> np.ndarray:
    """values signature values of a non-empty set: minimum and maximum under values / 2 permutations, alternating.

    A permutation is x -> (x ^ mask) * odd factor on the high 32 bits of the shingle hashes.
    """
    k = values // 2
    x = (hashes >> np.uint64(32)).astype(np.uint32)
    low, high = np.full(k, 0xFFFFFFFF, dtype=np.uint32), np.zeros(k, dtype=np.uint32)
    for i in range(0, len(x), 512):  # a block stays in the processor's cache
        mixed = x[i : i + 512, None] ^ _MASKS[:k]
        mixed *= _FACTORS[:k]
        np.minimum(low, mixed.min(axis=0), out=low)
        np.maximum(high, mixed.max(axis=0), out=high)
    return np.stack([low, high], axis=1).reshape(-1)


def _band_hashes(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    h = np.arange(1, bands + 1, dtype=np.uint64) * _ODD
    for column in sig.reshape(bands, rows).T:
        h = (h ^ column) * _ODD
        h ^= h >> np.uint64(29)
    return h.view(np.int64)


def signatures(rows: DataFrame, n: int, bands: int, values: int) -> DataFrame:
    """(k, h, n_shingles, whole hash of the set, bands array) from rows (k, t); h is xxhash64 of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, whole, hashes = [], [], []
            for t in batch.column("t").to_pylist():
                s = shingle_hashes(t, n)
                sizes.append(len(s))
                if len(s):
                    whole.append(xxhash.xxh3_128_digest(s.tobytes()))
                    hashes.append(_band_hashes(min_max_signature(s, bands * values), bands, values))
                else:
                    whole.append(None)
            some = np.array(sizes, dtype=np.int64) > 0
            ends = np.concatenate([[0], np.cumsum(some) * bands]).astype(np.int32)
            flat = np.concatenate([np.zeros(0, dtype=np.int64), *hashes])
            yield pa.record_batch({"k": batch.column("k"), "h": batch.column("h"), "n_shingles": pa.array(sizes, pa.int64()), "whole": pa.array(whole, pa.binary()), "bands": pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))})

    return rows.select("k", F.xxhash64("t").alias("h"), "t").mapInArrow(frugal(run), "k bigint, h bigint, n_shingles bigint, whole binary, bands array<bigint>")


def _verified(pairs: DataFrame, docs: DataFrame, n: int, percent: int) -> DataFrame:
    """The pairs (a, b) of keys whose full sets have 100 * intersection >= percent * union."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last: tuple[int | None, np.ndarray] = (None, np.zeros(0, dtype=np.uint64))
        for batch in batches:
            keep = []
            for a, b, ta, tb in zip(batch["a"].tolist(), batch["b"].tolist(), batch["ta"], batch["tb"], strict=True):
                if last[0] != a:
                    last = (a, shingle_hashes(ta, n))
                hb = shingle_hashes(tb, n)
                both = len(np.intersect1d(last[1], hb, assume_unique=True))
                keep.append(100 * both >= percent * (len(last[1]) + len(hb) - both))
            yield batch.loc[keep, ["a", "b"]]

    ta = docs.select(F.col("k").alias("a"), F.col("t").alias("ta"))
    tb = docs.select(F.col("k").alias("b"), F.col("t").alias("tb"))
    return pairs.join(tb, "b").join(ta, "a").select("a", "b", "ta", "tb").mapInPandas(frugal(run), "a bigint, b bigint")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = SHINGLE, percent: int = PERCENT, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(key, n_shingles, component_id, kept) for every row of docs.

    component_id is the smallest key that links reach, kept says that it is the row's own. A null
    or empty text or one without words has no shingle and no link; a row with a null key is no
    link between others, has the component_id of an equal set (null without one), and kept false. Repeated rows are equal documents: both keep
    their row; rows that repeat a key with another text link by their own texts. Extra columns are ignored. Texts are compared whole.
    """
    bounded_batches(docs.sparkSession)
    rows_in = docs.select(F.col(key).cast("bigint").alias("k"), F.col(text).alias("t"))
    sig = materialize(signatures(rows_in, n, bands, rows), "signatures")
    # one document stands for a class of equal sets; its number holds once it is written
    classes = sig.where("whole is not null and k is not null").groupBy("whole").agg(F.min(F.struct("k", "h")).alias("head"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"))
    heads = materialize(classes.select(F.monotonically_increasing_id().alias("k"), "whole", F.col("head.k").alias("key"), F.col("head.h").alias("h"), "n", "bands"), "classes")
    buckets = heads.select("k", F.posexplode("bands").alias("band", "bucket")).select("k", "band", F.xxhash64("band", "bucket").alias("bucket"))
    shared = buckets.groupBy("bucket").agg(F.min("k").alias("star"), F.max("k").alias("last")).where("star < last").select("bucket", "star")
    members = materialize(buckets.join(shared, "bucket"), "members")
    info = heads.select("k", "n", "bands")
    wanted = heads.join(members.select("k").distinct(), "k", "left_semi").select(F.col("k").alias("c"), "key", "h")
    texts = rows_in.select(F.col("k").alias("key"), F.xxhash64("t").alias("h"), "t").join(wanted, ["key", "h"]).groupBy("key", "h", "c").agg(F.first("t").alias("t"))
    texts = materialize(texts.select(F.col("c").alias("k"), "t"), "texts")

    low = percent / 100
    least = low - DEVIATIONS * math.sqrt(low * (1 - low) / SKETCH)

    def possible(pairs: DataFrame) -> DataFrame:
        """Pairs whose sizes allow the similarity."""
        x, y = info.select(F.col("k").alias("a"), F.col("n").alias("na")), info.select(F.col("k").alias("b"), F.col("n").alias("nb"))
        return pairs.join(y, "b").join(x, "a").where(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")).select("a", "b")

    def compared(group: pd.DataFrame) -> pd.DataFrame | None:
        """Possible pairs of a block of outside members and a block of members."""
        x, y = group[group["outside"] & group["asking"]], group[~group["asking"]]
        if x.empty or y.empty:
            return None
        ax, ay = x["k"].to_numpy(), y["k"].to_numpy()
        nx, ny = x["n"].to_numpy()[:, None], y["n"].to_numpy()[None, :]
        may = (100 * np.minimum(nx, ny) >= percent * np.maximum(nx, ny)) & (x["g"].to_numpy()[:, None] != y["g"].to_numpy()[None, :])
        may &= ~y["outside"].to_numpy()[None, :] | (ax[:, None] < ay[None, :])  # two outside members meet once
        i, j = np.nonzero(may)
        sx, sy = (np.frombuffer(b"".join(s["sketch"]), dtype=np.uint8).reshape(len(s), -1) for s in (x, y))
        keep = [(sx[i[c : c + 4096]] == sy[j[c : c + 4096]]).mean(axis=1) >= least for c in range(0, len(i), 4096)]
        keep = np.concatenate(keep) if keep else np.zeros(0, dtype=bool)
        i, j = i[keep], j[keep]
        # a pair that meets in several buckets counts in the first band that it shares
        shared = np.stack(x["bands"])[i] == np.stack(y["bands"])[j]
        first = shared.argmax(axis=1) == group["band"].iloc[0]
        a, b = ax[i[first]], ay[j[first]]
        return pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)}) if len(a) else None

    def sketched(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"k": batch["k"], "sketch": [(min_max_signature(shingle_hashes(t, n), SKETCH) & 0xFF).astype(np.uint8).tobytes() for t in batch["t"]]})

    stars = members.where("k <> star").select(F.col("star").alias("a"), F.col("k").alias("b")).distinct()
    links = materialize(_verified(possible(stars), texts, n, percent), "links")
    first = connected_components(links)
    # buckets that still span several groups: the members outside the largest group meet the others
    grouped = members.join(first, members.k == first.node, "left").select("bucket", "band", "k", F.coalesce("component", "k").alias("g"))
    grouped = materialize(grouped, "grouped")
    sizes = grouped.groupBy("bucket", "g").agg(F.count("*").alias("n"))
    largest = sizes.groupBy("bucket").agg(F.max(F.struct("n", "g")).alias("top"), F.count("*").alias("groups")).where("groups > 1").select("bucket", F.col("top.g").alias("top"))
    open_ = grouped.join(largest, "bucket").withColumn("outside", F.col("g") != F.col("top"))
    blocks = open_.groupBy("bucket").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("nj"), F.ceil(F.sum(F.col("outside").cast("int")) / BLOCK).cast("int").alias("ni"))
    open_ = open_.join(blocks, "bucket").withColumn("own", F.hash("k"))
    asking = open_.where("outside").withColumn("i", F.pmod("own", "ni")).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("nj") - 1))).withColumn("asking", F.lit(True))
    asked = open_.withColumn("j", F.pmod("own", "nj")).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("ni") - 1))).withColumn("asking", F.lit(False))
    columns = ["bucket", "band", "i", "j", "k", "g", "outside", "asking"]
    longer = texts.join(open_.select("k").distinct(), "k", "left_semi").mapInPandas(frugal(sketched), "k bigint, sketch binary").join(info, "k")
    longer = materialize(longer, "sketches")
    met = asking.select(columns).union(asked.select(columns)).join(longer, "k")
    rest = grouped_stream(met, ["bucket", "i", "j"], compared, "a bigint, b bigint").distinct()
    rest = materialize(rest.join(stars, ["a", "b"], "left_anti"), "rest")
    more = materialize(_verified(rest, texts, n, percent), "links")
    found = connected_components(links.union(more))
    discard(members, texts, links, first, grouped, longer, rest, more)
    # a group takes the smallest key of all its classes
    grouped = found.join(heads, heads["k"] == found["node"]).select("whole", "component", "key")
    least_key = grouped.groupBy("component").agg(F.min("key").alias("component_id"))
    named = grouped.join(least_key, "component").select("whole", "component_id")
    of_class = heads.select("whole", "key").join(named, "whole", "left").select("whole", F.coalesce("component_id", "key").alias("c"))
    out = sig.select("k", "n_shingles", "whole").join(of_class, "whole", "left")
    component = F.coalesce("c", "k")
    return out.select(F.col("k").alias(key), "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("k"), F.lit(False)).alias("kept"))


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"))


_SETS = rf"""
words AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (SELECT doc_id, CASE WHEN w IS NULL OR len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
  ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) END AS s FROM words),
one AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
common AS (SELECT a.doc_id AS x, b.doc_id AS y, a.n AS nx, b.n AS ny, count(*) AS c FROM one a JOIN one b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM common WHERE 100 * c >= 75 * (nx + ny - c)),
edges AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach(node, r) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.y, q.r FROM reach q JOIN edges e ON e.x = q.node),
comp AS (SELECT node, min(r) AS c FROM reach GROUP BY node)
"""
ORACLE = f"""WITH RECURSIVE {_SETS}
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, c.c AS component_id, c.c = s.doc_id AS kept FROM sets s JOIN comp c ON c.node = s.doc_id"""
