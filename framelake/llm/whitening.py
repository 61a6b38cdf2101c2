"""Embedding whitening by a bit-sliced scatter matrix.

Components count as integers x = floor(256 * c). Over the distinct vectors each dimension is shifted by its
smallest value, and its bits become planes: plane b of dimension i has a bit a row, packed into 64-bit
words. A sum of products of two dimensions is then a sum over pairs of planes of 2**(a + b) times the set bits of their AND, so
integers never round, however many rows there are. Tasks add up such counts by groups of powers of two, Spark
sums them over tasks, and the driver, which sees one matrix, not rows, puts them together as integers of any length.
The matrix is centred as integers too: n * sum(x y) - sum(x) * sum(y), which no shift changes, and only then
becomes doubles, for the eigenvectors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.llm.common import bounded_batches, discard, frugal, materialize, table

#: Components of a vector's whitened form, and the highest number of dimensions (the driver holds a matrix of it).
COMPONENTS, MOST_DIMENSIONS = 4, 4096
#: Rows that are packed at a time, and powers of two whose counts are added up as one 64-bit integer (below 2**40 rows).
PACKED_ROWS, LIMB = 4096, 16
_LONG = 1 << 63


def usable(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """(k, x array<bigint>) of the rows whose vector is not null or empty and has no null or non-finite component."""
    v = F.col(vector).cast("array<double>")
    good = F.when(F.size(v) > 0, F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))).otherwise(False)
    rows = vectors.select(F.col(key).alias("k"), F.when(good, v).alias("v")).where("v is not null")
    return rows.select("k", F.transform("v", lambda c: F.floor(c * 256.0)).alias("x"))


def bit_planes(shifted: np.ndarray, bits: int) -> np.ndarray:
    """(dimensions * bits, words) planes of non-negative 64-bit integers (rows, dimensions); plane d * bits + b has bit b of dimension d."""
    n, dim = shifted.shape
    words = -(-n // 64)
    out = np.zeros((dim, bits, words * 8), dtype=np.uint8)
    columns = np.ascontiguousarray(shifted.T)
    for b in range(bits):
        packed = np.packbits(((columns >> np.uint64(b)) & np.uint64(1)).astype(np.uint8), axis=1, bitorder="little")
        out[:, b, : packed.shape[1]] = packed
    return out.reshape(dim * bits, words * 8).view(np.uint64)


def limbs_of(bits: int) -> int:
    return (2 * bits - 2) // LIMB + 1


def scatter_counts(planes: np.ndarray, dim: int, bits: int) -> np.ndarray:
    """(limbs, dim, dim) integers, their sum weighted by 2**(LIMB * limb) the sums of products; only j >= i is filled."""
    out = np.zeros((limbs_of(bits), dim, dim), dtype=np.int64)
    for i in range(dim):
        rest = planes[i * bits :]
        for a in range(bits):
            own = planes[i * bits + a]
            if not own.any():
                continue
            met = np.bitwise_count(rest & own).sum(axis=1, dtype=np.int64).reshape(dim - i, bits)
            for b in range(bits):
                out[(a + b) // LIMB, i, i:] += met[:, b] << np.int64((a + b) % LIMB)
    return out


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    """The x of batches as (rows, dimensions) matrices of few rows and one number of dimensions."""
    for batch in batches:
        lists = batch.column("x")
        if not len(lists):
            continue
        flat, ends = lists.flatten().to_numpy(), np.asarray(lists.offsets) - lists.offsets[0].as_py()
        sizes = np.diff(ends)
        for dim in np.unique(sizes):
            at = np.flatnonzero(sizes == dim)
            for part in range(0, len(at), PACKED_ROWS):
                yield flat[ends[at[part : part + PACKED_ROWS], None] + np.arange(dim)]


@dataclass
class Whitening:
    """What the fit list of one number of dimensions gives: exact sums, and the leading components."""

    n: int
    sums: list[int]
    components: np.ndarray
    values: np.ndarray
    explained: np.ndarray
    identity_error: float

    def project(self, x: np.ndarray) -> tuple[list[int], np.ndarray]:
        """(exact deviation, whitened components) of integer rows."""
        most = max(abs(int(x.min())), abs(int(x.max()))) * self.n + max(map(abs, self.sums)) if x.size else 0
        if most < _LONG:
            centred = x * np.int64(self.n) - np.array(self.sums, dtype=np.int64)
            wide = centred if most * most * x.shape[1] < _LONG else centred.astype(object)
        else:
            centred = wide = x.astype(object) * self.n - np.array(self.sums, dtype=object)
        deviation = (wide * wide).sum(axis=1).tolist()
        true = (centred / self.n).astype(np.float64)  # rounded once, also for integers of any length
        with np.errstate(divide="ignore", invalid="ignore"):
            return deviation, (true @ self.components) / np.sqrt(self.values)


def solve(n: int, sums: list[int], products: list[list[int]], components: int) -> Whitening:
    """The leading components of n rows with these sums and sums of products, as integers. A component without variance has a value of 0."""
    dim = len(sums)
    centred = [[n * products[min(i, j)][max(i, j)] - sums[i] * sums[j] for j in range(dim)] for i in range(dim)]
    cov = np.array([[v / (n * n) for v in row] for row in centred])  # of integers: rounded once
    trace = sum(centred[i][i] for i in range(dim)) / (n * n)
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1][:components].copy(), vectors[:, ::-1][:, :components].copy()
    values[values <= dim * np.finfo(float).eps * max(trace, 0)] = 0
    signs = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])])
    vectors = vectors * signs
    some = values > 0
    u = vectors[:, some] / np.sqrt(values[some])
    error = float(np.abs(u.T @ cov @ u - np.eye(int(some.sum()))).max(initial=0.0))
    return Whitening(n, sums, vectors, values, values / trace if trace > 0 else np.zeros(len(values)), error)


def fit(x: DataFrame, components: int = COMPONENTS) -> dict[int, Whitening]:
    """By number of dimensions, the whitening of the distinct vectors of x (a column x array<bigint>). The driver sees a matrix a number of dimensions."""
    distinct = materialize(x.select("x").distinct(), "vectors")

    def bounds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low: dict[int, np.ndarray] = {}
        high: dict[int, np.ndarray] = {}
        count: dict[int, int] = {}
        for m in _each(batches):
            d = m.shape[1]
            low[d] = np.minimum(low[d], m.min(axis=0)) if d in low else m.min(axis=0)
            high[d] = np.maximum(high[d], m.max(axis=0)) if d in high else m.max(axis=0)
            count[d] = count.get(d, 0) + len(m)
        for d, n in count.items():
            yield pa.record_batch({"dim": np.full(d, d, dtype=np.int32), "i": np.arange(d, dtype=np.int32), "low": low[d], "high": high[d], "n": np.full(d, n, dtype=np.int64)})

    found = distinct.mapInArrow(frugal(bounds), "dim int, i int, low bigint, high bigint, n bigint").groupBy("dim", "i").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("n").alias("n"))
    shape: dict[int, tuple[list[int], int, int]] = {}
    rows = found.orderBy("dim", "i").collect()  # a row a dimension
    for d in sorted({r.dim for r in rows}):
        if d > MOST_DIMENSIONS:
            raise ValueError(f"vectors of {d} dimensions, at most {MOST_DIMENSIONS}")
        own = [r for r in rows if r.dim == d]
        shape[d] = ([r.low for r in own], max(1, *((r.high - r.low).bit_length() for r in own)), own[0].n)

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for m in _each(batches):
            d = m.shape[1]
            low, bits, _ = shape[d]
            shifted = m.view(np.uint64) - np.array(low, dtype=np.int64).view(np.uint64)  # modulo 2**64, so never too long
            planes = bit_planes(shifted, bits)
            ones = np.bitwise_count(planes).sum(axis=1, dtype=np.int64).reshape(d, bits)
            more = scatter_counts(planes, d, bits)
            held[d] = (held[d][0] + ones, held[d][1] + more) if d in held else (ones, more)
        for d, (ones, more) in held.items():
            yield _rows(d, *np.nonzero(ones), ones[np.nonzero(ones)], -1)
            for limb, part in enumerate(more):
                at = np.nonzero(part)
                yield _rows(d, *at, part[at], limb)

    def _rows(d: int, i: np.ndarray, j: np.ndarray, n: np.ndarray, limb: int) -> pa.RecordBatch:
        return pa.record_batch({"dim": np.full(len(i), d, dtype=np.int32), "limb": np.full(len(i), limb, dtype=np.int32), "i": i.astype(np.int32), "j": j.astype(np.int32), "n": n.astype(np.int64)})

    total = distinct.mapInArrow(frugal(counts), "dim int, limb int, i int, j int, n bigint").groupBy("dim", "limb", "i", "j").agg(F.sum("n").alias("n"))
    sums = {d: [0] * d for d in shape}
    products = {d: [[0] * d for _ in range(d)] for d in shape}
    for r in total.toLocalIterator():  # limb -1: set bits of plane j of dimension i
        if r.limb < 0:
            sums[r.dim][r.i] += r.n << r.j
        else:
            products[r.dim][r.i][r.j] += r.n << (LIMB * r.limb)
    discard(distinct)
    out = {}
    for d, (low, _, n) in shape.items():
        fitted = solve(n, sums[d], products[d], components)
        fitted.sums = [s + n * m for s, m in zip(sums[d], low, strict=True)]
        out[d] = fitted
    return out


def whiten(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """(key, component from 1, n, deviation, whitened, explained, identity_error, deviation_text) for each row that takes part and each of its leading components.

    Rows whose vector is null, empty or holds a null or non-finite component take no part. Each distinct integer vector counts once
    in the fit, rows that repeat it get its values; rows with a null key are rows like others. Vectors of another number of dimensions have a
    fit of their own. Fewer dimensions than components give fewer rows. A component without variance (equal vectors,
    or fewer vectors than dimensions) has explained 0 and a null whitened, and does not count in identity_error. deviation is null
    where it is beyond 64 bits, deviation_text has all its digits. A component of 2**55 or more counts as the largest long. Extra columns are ignored; no rows give none.
    """
    bounded_batches(vectors.sparkSession)
    rows = usable(vectors, key, vector)
    shared = vectors.sparkSession.sparkContext.broadcast(fit(rows, components))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.asarray(batch.column("x").value_lengths())
            for dim in np.unique(sizes):
                at = np.flatnonzero(sizes == dim)
                part = batch.take(pa.array(at))
                fitted: Whitening = shared.value[int(dim)]
                x = part.column("x").flatten().to_numpy().reshape(len(at), dim)
                deviation, white = fitted.project(x)
                m = len(fitted.values)
                each = np.repeat(np.arange(len(at)), m)
                yield pa.record_batch(
                    {
                        "k": part.column("k").take(pa.array(each)),
                        "component": np.tile(np.arange(1, m + 1, dtype=np.int32), len(at)),
                        "n": np.full(len(each), fitted.n, dtype=np.int64),
                        "deviation": pa.array([d if d < _LONG else None for d in deviation], pa.int64()).take(pa.array(each)),
                        "whitened": pa.array(white.reshape(-1), mask=np.tile(fitted.values == 0, len(at))),
                        "explained": np.tile(fitted.explained, len(at)),
                        "identity_error": np.full(len(each), fitted.identity_error),
                        "deviation_text": pa.array([str(d) for d in deviation], pa.string()).take(pa.array(each)),
                    }
                )

    kind = dict(rows.dtypes)["k"]
    out = rows.mapInArrow(frugal(run), f"k {kind}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double, deviation_text string")
    return out.withColumnRenamed("k", key)


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings", "vec_id", "embedding")).drop("deviation_text")
