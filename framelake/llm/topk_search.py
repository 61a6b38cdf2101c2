"""Exact top-k search by inner product with the threshold algorithm over sorted per-dimension lists.

Candidates are dealt to blocks by a hash of their id. In a block every dimension has a list of the
rows in the order of that component. A query walks all lists from its own good end (the top for a
positive weight, the bottom for a negative one), scores each row when it first meets it, and stops
once its k-th score beats the threshold: the score of a row made of the components at the current
depth, which no unseen row can exceed. The best k of each block meet in a ranking by query. Queries
are dealt to blocks as well, so a task holds a block of either kind, whatever the table's size.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from framelake.llm.common import bounded_batches, materialize, table

#: Rows of a block of candidates and of queries.
CANDIDATES, QUERIES = 4096, 4096
#: Depth of the first look at the threshold; it doubles from one look to the next.
FIRST_DEPTH = 16
#: Up to this size of components, sums of their products are exact in doubles (of 64 dimensions; checked for more).
LARGEST = 1 << 22
#: Scores are given as 64-bit integers; what is beyond is given as the largest or the smallest one, and ranks by all its digits.
MOST = (1 << 63) - 1


def usable(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, v array<double>) of the rows that take part."""
    x = F.col(vector).cast("array<double>")
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = vectors.where(F.col(key).isNotNull() & F.col(vector).isNotNull())
    return rows.where(F.when(F.size(x) > 0, finite).otherwise(False)).select(F.col(key).cast("bigint").alias("id"), x.alias("v"))


def quantized(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows of floor(256 * x) as doubles, whether a row is wide: its integers are too large for exact sums in doubles)."""
    with np.errstate(over="ignore"):
        q = np.floor(v * 256.0)
    return q, np.abs(q).max(axis=1, initial=0) > LARGEST / max(1.0, (v.shape[1] / 64) ** 0.5)


def _integers(v: np.ndarray) -> list[list[int]]:
    """floor(256 * x) of rows of doubles of any size, exactly."""
    return [[(256 * n) // d for n, d in map(float.as_integer_ratio, row)] for row in v.tolist()]


def _exact(v: np.ndarray) -> np.ndarray:
    """_integers() as an array of Python integers."""
    out = np.empty(v.shape, dtype=object)
    for i, row in enumerate(_integers(v)):
        out[i] = row
    return out


def order_key(score: int) -> bytes:
    """Bytes that sort as integers of any size do: sign, number of bytes, bytes; those below zero upside down."""
    raw = abs(score).to_bytes((abs(score).bit_length() + 7) // 8, "big")
    key = len(raw).to_bytes(4, "big") + raw
    return b"\1" + key if score >= 0 else b"\0" + bytes(255 - b for b in key)


def block_topk(v: np.ndarray, ids: np.ndarray, queries: np.ndarray, own: np.ndarray, k: int) -> list[list[tuple[int, int]]]:
    """For each query its (score, id), exactly, from vectors of doubles of any finite size: wide rows and queries go through the threshold algorithm in Python's integers."""
    (x, wide_x), (q, wide_q) = quantized(v), quantized(queries)
    out: list[list[tuple[int, int]]] = [[] for _ in own]

    def add(rows: np.ndarray, x: np.ndarray, at: np.ndarray, q: np.ndarray) -> None:
        if len(rows) and len(at):
            for i, (found, scores) in zip(at.tolist(), threshold_topk(x, ids[rows], q, own[at], k), strict=True):
                out[i] += zip(scores.tolist(), found.tolist(), strict=True)

    plain_x, plain_q, far_x, far_q = np.flatnonzero(~wide_x), np.flatnonzero(~wide_q), np.flatnonzero(wide_x), np.flatnonzero(wide_q)
    add(plain_x, x[plain_x], plain_q, q[plain_q])
    if len(far_x):
        add(far_x, _exact(v[far_x]), plain_q, _exact(queries[plain_q]))
    if len(far_q):
        add(np.arange(len(ids)), _exact(v), far_q, _exact(queries[far_q]))
    return [sorted(found, key=lambda s: (-s[0], s[1]))[:k] for found in out]


def threshold_topk(x: np.ndarray, ids: np.ndarray, queries: np.ndarray, own: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each query: (ids, scores) of the k rows of x with the highest inner product, ties to the smaller id, ids equal to own left out.

    Rows and queries are whole numbers, as doubles whose sums are exact or as Python's integers.
    """
    n, exact = len(x), x.dtype == object
    up = np.argsort(x, axis=0, kind="stable").astype(np.int32)
    down = up[::-1]
    low, high = np.take_along_axis(x, up, 0), np.take_along_axis(x, down, 0)
    depths = []
    d = FIRST_DEPTH
    while d < n:
        depths.append(d)
        d *= 2
    depths.append(n)
    plus, minus = np.maximum(queries, 0), np.minimum(queries, 0)
    limits = np.stack([plus @ high[d - 1] + minus @ low[d - 1] for d in depths], axis=1)
    out = []
    for q, me, limit in zip(queries, own.tolist(), limits, strict=True):
        falls = q >= 0
        seen = ids == me
        best_ids, best = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=x.dtype)
        at = 0
        for d, bound in zip(depths, limit.tolist(), strict=True):
            met = np.zeros(n, dtype=bool)
            met[np.where(falls, down[at:d], up[at:d]).ravel()] = True
            rows = np.flatnonzero(met & ~seen)
            seen |= met
            at = d
            s = x[rows] @ q
            if len(best) == k:
                good = (s >= best[-1]).astype(bool)
                rows, s = rows[good], s[good]
            best_ids, best = np.concatenate([best_ids, ids[rows]]), np.concatenate([best, s])
            first = sorted(range(len(best)), key=lambda i: (-best[i], best_ids[i]))[:k] if exact else np.lexsort((best_ids, -best))[:k]
            best_ids, best = best_ids[first], best[first]
            if len(best) == k and best[-1] > bound:  # an equal score could still come from a smaller id
                break
        out.append((best_ids, best if exact else best.astype(np.int64)))
    return out


def top_k(queries: DataFrame, candidates: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank from 1, key, score) of each query's k highest integer inner products.

    Components count as floor(256 * x), exactly for any finite x; rows rank by exact scores of any length, and a score beyond 64 bits is given as the largest or smallest long. Rows with a
    null key, a null or empty vector, or a null or non-finite component take
    no part, neither as query nor as candidate. A query meets the candidates of its own number of dimensions except rows with its
    key. Query rows that repeat a key with another vector are queries of their own under that key, equal ones are one; rows that repeat a candidate's are candidates of their own. Ties go to the smaller key. Fewer candidates than k give fewer rows.
    """
    bounded_batches(queries.sparkSession)
    q = materialize(usable(queries, key, vector).distinct(), "queries")
    c = materialize(usable(candidates, key, vector), "candidates")
    nq, nc = max(1, -(-q.count() // QUERIES)), max(1, -(-c.count() // CANDIDATES))
    q = q.select("id", "v", F.size("v").alias("dim"), F.pmod(F.xxhash64("id", "v"), F.lit(nq)).alias("qb")).withColumn("cb", F.explode(F.sequence(F.lit(0), F.lit(nc - 1)).cast("array<bigint>")))
    c = c.select("id", "v", F.size("v").alias("dim"), F.pmod(F.xxhash64("id"), F.lit(nc)).alias("cb")).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(nq - 1)).cast("array<bigint>")))
    q = q.withColumn("h", F.xxhash64("v"))
    columns = ["query_id", "h", "id", "score", "beyond"]

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({c: pd.Series(dtype="object" if c == "beyond" else "int64") for c in columns})
        found = block_topk(np.stack(right["v"]), right["id"].to_numpy(), np.stack(left["v"]), left["id"].to_numpy(), k)
        sizes = [len(f) for f in found]
        rows = [x for f in found for x in f]
        made = {"query_id": np.repeat(left["id"].to_numpy(), sizes), "h": np.repeat(left["h"].to_numpy(), sizes), "id": [i for _, i in rows], "score": [max(-MOST - 1, min(MOST, s)) for s, _ in rows]}
        return pd.DataFrame(made | {"beyond": pd.Series([order_key(s) if abs(s) >= MOST else None for s, _ in rows], dtype=object)}).astype({"id": "int64", "score": "int64"})

    by = ["dim", "qb", "cb"]
    met = q.groupBy(*by).cogroup(c.groupBy(*by)).applyInPandas(run, "query_id bigint, h bigint, id bigint, score bigint, beyond binary")
    best = Window.partitionBy("query_id", "h").orderBy(F.desc("score"), F.desc("beyond"), "id")
    return met.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(key), "score")


def op8_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings", "vec_id", "embedding")
    return top_k(vectors.where("vec_id % 50 = 0"), vectors, 5)


ORACLE = """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(r AS INTEGER) AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM s) WHERE r <= 5"""
