"""What the corpus operators share: words, shared storage, connected components."""

from __future__ import annotations

import contextlib
import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import reduce
from typing import TYPE_CHECKING

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

if TYPE_CHECKING:
    import pandas as pd

#: A word is a run of anything but the space and the six ASCII white-space controls.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
WORD = re.compile(WORD_PATTERN)

_LOWER = {i: i + 32 for i in range(65, 91)}


def lower_ascii(text: str) -> str:
    """Lower-case A-Z and nothing else."""
    return text.lower() if text.isascii() else text.translate(_LOWER)


#: For word_hashes(): a random odd number a byte (A-Z as a-z, white space 0), a base and its inverse modulo 2**64.
_BYTES = np.random.default_rng(7).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTES[65:91] = _BYTES[97:123]
_SPACES = np.zeros(256, dtype=bool)
_SPACES[[9, 10, 11, 12, 13, 32]] = True
_BYTES[_SPACES] = 0
_BASE = 0x5851F42D4C957F2D
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}
#: Bytes hashed at a time; a longer text is cut at white space.
_PART = 1 << 18


def _power_table(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, _PART + 4096)
        have = np.full(size, base, dtype=np.uint64)
        have[0] = 1
        have = _powers[base] = np.multiply.accumulate(have)
    return have


def slide(a: np.ndarray, width: int, pick: np.ufunc) -> np.ndarray:
    """pick (minimum or maximum) over each window of width neighbours."""
    done = 1
    while done * 2 <= width:
        a = pick(a[:-done], a[done:])
        done *= 2
    return pick(a[: len(a) - (width - done)], a[width - done :]) if done < width else a


def word_hashes(text: str | None) -> np.ndarray:
    """A 64-bit hash of each word of the whole text in order, A-Z read as a-z.

    A polynomial over the word's UTF-8 bytes, taken from running sums, so that the work is a few
    vector operations a text whatever its words are.
    """
    if not text:
        return np.zeros(0, dtype=np.uint64)
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)
    out, at = [], 0
    while at < len(data):
        end = at + _PART
        if end < len(data):  # on to the next white space
            while end < len(data) and not (space := _SPACES[data[end : end + 4096]]).any():
                end += 4096
            end = min(len(data), end + int(space.argmax()) if end < len(data) else len(data))
        part = data[at : max(end, at + 1)]
        at = end
        inside = np.concatenate([[False], ~_SPACES[part], [False]])
        edge = np.flatnonzero(inside[1:] != inside[:-1])
        starts, ends = edge[::2], edge[1::2]
        n = len(part)
        sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(_BYTES[part] * _power_table(_BASE, n)[:n], out=sums[1:])
        h = (sums[ends] - sums[starts]) * _power_table(_INVERSE, n)[starts]
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(29)
        out.append(h)
    return out[0] if len(out) == 1 else np.concatenate(out)


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where it is unset, a master that runs all in one machine gets a folder of its own; any other raises an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.match(r"local(\[[^,]*\])?$", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='framelake-')}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def bounded_batches(spark: SparkSession) -> None:
    """Hold what goes to a Python worker at once to 2 MB (of rows beyond the first), as texts and vectors vary in size."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "2m")


class Admitted(dict):
    """A bounded cache of words by what they became: a word is kept when it is met for the second time, as most words of a corpus come once."""

    def __init__(self, most: int, longest: int = 64):
        super().__init__()
        self.most, self.longest = most, longest
        self._forget()

    def _forget(self) -> None:
        self.met, self.marks = bytearray(1 << 22), 0

    def offer(self, word: str, made: object) -> None:
        place = hash(word) & 0x3FFFFF
        if not self.met[place]:
            self.met[place] = 1
            self.marks += 1
            if self.marks > 1 << 21:  # half full: too many words would pass for met ones
                self._forget()
        elif len(self) < self.most and len(word) <= self.longest:
            self[word] = made

    def offer_all(self, made: dict[str, object]) -> None:
        """offer() of many words."""
        if self.marks + len(made) > 1 << 21:
            for word, x in made.items():
                self.offer(word, x)
            return
        met, longest, room = self.met, self.longest, self.most - len(self)
        for word, x in made.items():
            place = hash(word) & 0x3FFFFF
            if not met[place]:
                met[place] = 1
                self.marks += 1
            elif room > 0 and len(word) <= longest:
                room -= word not in self
                self[word] = x


_caches: dict[str, Callable[[], None]] = {}


def keeps_cache(owner: str, drop: Callable[[], None]) -> None:
    """Register what drops an operator's cache in this Python worker."""
    _caches[owner] = drop


def start_task(owner: str) -> None:
    """Drop the caches of other operators, as Python workers live on from job to job."""
    for name, drop in _caches.items():
        if name != owner:
            drop()


def give_back() -> None:
    """Return memory that this Python worker no longer uses to the machine."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def frugal(run: Callable[[Iterator], Iterator], owner: str = "") -> Callable[[Iterator], Iterator]:
    """run(), which maps a partition's batches, between start_task() and give_back()."""

    def wrapped(batches: Iterator) -> Iterator:
        start_task(owner)
        try:
            yield from run(batches)
        finally:
            give_back()

    return wrapped


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back, which cuts its lineage there.

    A lost executor loses nothing of it, unlike with a cached or locally checkpointed frame.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    if _recorders:
        _recorders[-1].append(out)
    return out


_recorders: list[list[DataFrame]] = []


@contextlib.contextmanager
def recording(frames: list[DataFrame]) -> Iterator[None]:
    """What materialize() writes meanwhile is added to frames, for discard()."""
    _recorders.append(frames)
    try:
        yield
    finally:
        _recorders.pop()


def discard(*frames: DataFrame) -> None:
    """Delete what materialize() wrote for these frames, once nothing reads them any more."""
    for df in frames:
        if path := getattr(df, "stored_at", None):
            jvm = df.sparkSession._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(p, True)


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def unused(df: DataFrame, *names: str) -> dict[str, str]:
    """For each name a column name that df does not have, whatever the case of its letters."""
    have, out = {c.lower() for c in df.columns}, {}
    for name in names:
        made = f"__{name}"
        while made.lower() in have:
            made += "_"
        have.add(made.lower())
        out[name] = made
    return out


def grouped_stream(rows: DataFrame, keys: list[str], run: Callable[[pd.DataFrame], pd.DataFrame | None], schema: str) -> DataFrame:
    """run() over each group of rows with equal keys; for very many small groups, which applyInPandas would call one by one at a price.

    Groups must be of bounded size: cut large ones into blocks first.
    """

    def stream(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import pandas as pd

        held = None
        for batch in batches:
            rest = batch if held is None else pd.concat([held, batch], ignore_index=True)
            ids = rest[keys]
            starts = np.flatnonzero((ids != ids.shift()).any(axis=1).to_numpy())
            made = [run(rest.iloc[s:e]) for s, e in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True) if e - s > 1]
            held = rest.iloc[starts[-1] :] if len(starts) else None
            if made := [x for x in made if x is not None]:
                yield pd.concat(made, ignore_index=True)
        if held is not None and (last := run(held)) is not None:
            yield last

    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInPandas(frugal(stream), schema)


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node that has an edge; component is the smallest node reachable.

    Minimum labels spread along edges and then jump: each round a node takes the smallest label of
    its neighbours, and then the label of its label, so that paths shrink by doubling. Hub nodes are
    safe: minima are combined on the map side, and the joins are plain equi-joins that adaptive
    execution can split. Every round is written to the shared folder.
    """
    pairs = edges.select(F.col(a).alias("x"), F.col(b).alias("y")).where("x <> y")
    both = materialize(pairs.union(pairs.select("y", "x")).distinct(), "edges")
    labels = materialize(both.groupBy(F.col("x").alias("node")).agg(F.min("y").alias("m")).select("node", F.least("node", "m").alias("label")), "labels")
    while True:
        old = labels
        offered = both.join(old, both.y == old.node).groupBy("x").agg(F.min("label").alias("m"))
        spread = materialize(
            old.join(offered, old.node == offered.x, "left").select("node", F.col("label").alias("before"), F.least("label", F.coalesce("m", "label")).alias("label")),
            "spread",
        )
        jump = spread.select(F.col("node").alias("n2"), F.col("label").alias("l2"))
        labels = materialize(
            spread.join(jump, spread.label == jump.n2).select("node", F.least("label", "l2").alias("label"), (F.least("label", "l2") < F.col("before")).alias("moved")),
            "labels",
        )
        moved = labels.where("moved").limit(1).count()
        labels_out = labels.select("node", "label")
        labels_out.stored_at = labels.stored_at
        discard(old, spread)
        labels = labels_out
        if not moved:
            break
    discard(both)
    out = labels.select("node", F.col("label").alias("component"))
    out.stored_at = labels.stored_at
    return out


def with_components(rows: DataFrame, edges: DataFrame, key: str, a: str = "a", b: str = "b") -> DataFrame:
    """rows with component_id (its own key where it has no edge)."""
    found = connected_components(edges, a, b)
    kept = reduce(lambda df, c: df.drop(c), ["component_id"], rows)
    return kept.join(found, kept[key] == found["node"], "left").withColumn("component_id", F.coalesce("component", key)).drop("node", "component")
