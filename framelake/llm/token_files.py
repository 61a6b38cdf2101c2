"""Token-id files: frequency-ranked ids in byte-aligned variable-length coding with separate control bytes.

Format. A data set is a folder with two Parquet tables, written and committed by Spark, so it may
live in any store and survives lost executors.

* `ranks`: (rank int, id int). Rank 0 is the id that occurs most, ties go to the smaller id.
* `blocks`: one row a block of whole documents in ascending key order: bucket int (key range),
  block string (unique), first_key, n_docs int, n_tokens bigint, keys binary (int64 each), lengths
  binary (uint32 each, ids of each document), control binary, data binary.

A token is its rank in 1 to 4 bytes, little-endian, in `data`; a control byte holds four 2-bit
lengths less one, first token in the low bits. Reading turns control bytes into lengths by a table
of 256 rows, lengths into places by a running sum, and ranks into ids by a table: numpy only, no
loop over tokens.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from framelake.llm.common import Admitted, bounded_batches, discard, frugal, give_back, keeps_cache, materialize, new_path, table

#: Words kept by a Python worker, those that it meets again, and those that it met last. Characters split, and new words encoded, at a
#: time. Tokens of a block, more for a longer document.
CACHED_WORDS, RECENT_WORDS, SPLIT_CHARS, NEW_WORDS, BLOCK_TOKENS = 300_000, 200_000, 1 << 22, 4096, 1 << 15
#: Whether the library encodes a word alone as inside its text: no white space but one space or newline at its start.
ALONE = re.compile(r"[ \n]?[^\s\0](?:[^\0 \n]*[^\s\0])?").fullmatch
#: What a byte is for cutting: a sign (1), a digit (2), a letter (3) or something that is not cut at (0), as is every byte beyond ASCII here.
KINDS = np.zeros(256, dtype=np.uint8)
KINDS[33:127] = [3 if chr(c).isalpha() else 2 if chr(c).isdigit() else 1 for c in range(33, 127)]
#: UTF-8 bytes of text aimed at in a key range, and the bytes that count as one when ranges are made. Key ranges, each larger
#: where there would be more: what the driver sees of the keys.
RANGE_BYTES, UNIT_BYTES, MOST_RANGES = 1 << 24, 1 << 10, 20_000
#: control byte -> the lengths of its four tokens
LENGTHS = np.array([[(c >> 2 * k & 3) + 1 for k in range(4)] for c in range(256)], dtype=np.uint8)


def pack(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """(control bytes, data bytes) of ranks below 2**32."""
    n = len(ranks)
    lengths = np.ones((n + 3) // 4 * 4, dtype=np.uint8)
    for limit in (0xFF, 0xFFFF, 0xFFFFFF):
        lengths[:n] += ranks > limit
    codes = (lengths - 1).reshape(-1, 4)
    control = codes[:, 0] | codes[:, 1] << 2 | codes[:, 2] << 4 | codes[:, 3] << 6
    ends = np.cumsum(lengths[:n], dtype=np.int64)
    starts = ends - lengths[:n]
    data = np.empty(int(ends[-1]) if n else 0, dtype=np.uint8)
    data[starts] = ranks.astype(np.uint8)
    for k in (1, 2, 3):
        more = np.flatnonzero(lengths[:n] > k)
        data[starts[more] + k] = (ranks[more] >> np.uint32(8 * k)).astype(np.uint8)
    return control.astype(np.uint8).tobytes(), data.tobytes()


def unpack(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The n ranks that pack() coded."""
    lengths = LENGTHS[np.frombuffer(control, dtype=np.uint8)].reshape(-1)[:n]
    ends = np.cumsum(lengths, dtype=np.int64)
    padded = np.concatenate([np.frombuffer(data, dtype=np.uint8), np.zeros(3, dtype=np.uint8)])
    starts = ends - lengths
    out = padded[starts].astype(np.uint32)
    for k in (1, 2, 3):
        more = np.flatnonzero(lengths > k)
        out[more] |= padded[starts[more] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


class WordEncoder:
    """Whole texts through the tokenizers library, with a bounded cache of words.

    The pre-tokenizer splits before a space or newline that stands between other characters whatever is around
    it, and wherever letters, digits and signs meet (but between an apostrophe and what follows), so a text without
    neighbouring white space falls into words that the library encodes alone.
    Any other text goes through the library whole, as does one that holds an added token's content, unless as_text
    says that such content is plain text, and any text if the pre-tokenizer is another.
    """

    def __init__(self, path: str, as_text: bool = True):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.lib = Tokenizer.from_file(path)
        first = self.lib.pre_tokenizer
        self.cuts = isinstance(first, pre_tokenizers.ByteLevel) and first.use_regex and not first.add_prefix_space and not self.lib.normalizer
        self.kind = np.dtype("<u2") if self.lib.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        self.lib.encode_special_tokens = as_text
        self.added = [] if as_text else [t.content for t in self.lib.get_added_tokens_decoder().values()]
        # a byte-level token has a character a byte
        vocabulary = self.lib.get_vocab()
        self.bytes_of = np.zeros(max(vocabulary.values(), default=0) + 1, dtype=np.int64)
        for token, i in vocabulary.items():
            self.bytes_of[i] = len(token)
        self.words = Admitted(CACHED_WORDS)
        self.recent: dict[str, bytes] = {}

    def raw(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype=self.kind).tobytes() for e in self.lib.encode_batch_fast(texts, add_special_tokens=False)]

    def raw_words(self, words: list[str]) -> list[bytes]:
        """raw() of words that each hold one space or newline, at their start, encoded as one text and cut again by the bytes of its tokens."""
        text = "".join(words)
        ids = np.array(self.lib.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype=self.kind)
        ends = np.cumsum(self.bytes_of[ids])
        octets = np.frombuffer(text.encode(), dtype=np.uint8)
        goals = np.append(np.flatnonzero((octets == 32) | (octets == 10))[1:], len(octets))
        cuts = np.searchsorted(ends, goals, side="left") + 1
        if cuts[-1] != len(ids) or (ends[cuts - 1] != goals).any():
            return self.raw(words)
        data, k = ids.tobytes(), self.kind.itemsize
        cuts = (cuts * k).tolist()
        return [data[a:b] for a, b in zip([0, *cuts], cuts, strict=False)]

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """The ids of each text, as bytes; a few texts are in memory as words at a time."""
        some, held = [], 0
        for t in texts:
            some.append(t)
            held += len(t)
            if held >= SPLIT_CHARS:
                yield from self._encode(some)
                some, held = [], 0
        yield from self._encode(some)

    def _new_words(self, words: list[str]) -> list[bytes]:
        """The ids of words that the library encodes alone and that are not kept; those that it encodes are in memory until many others have come."""
        made = dict(zip(words, map(self.recent.get, words), strict=True))
        lacking = [w for w, x in made.items() if x is None]
        # a newline before a word is a token of its own
        after = [w if w[0] in " \n" else "\n" + w for w in lacking]
        line = len(self.raw(["\n"])[0]) if lacking else 0
        new = {}
        for i in range(0, len(lacking), NEW_WORDS):
            some = lacking[i : i + NEW_WORDS]
            new.update((w, x if w[0] in " \n" else x[line:]) for w, x in zip(some, self.raw_words(after[i : i + NEW_WORDS]), strict=True))
            if len(self.recent) >= RECENT_WORDS:
                self.recent.clear()
            self.recent.update((w, new[w]) for w in some if len(w) <= self.words.longest)
        made.update(new)
        self.words.offer_all(made)
        return list(made.values())

    @staticmethod
    def _begins(octets: np.ndarray) -> np.ndarray:
        """Whether a word begins at each byte."""
        kinds = KINDS[octets]
        lead = np.flatnonzero(octets[:-1] == 0xC3)
        lead = lead[(octets[lead + 1] != 0x97) & (octets[lead + 1] != 0xB7)]  # U+00C0 to U+00FF are letters but for these two
        kinds[lead] = kinds[lead + 1] = 3
        begins = (octets == 32) | (octets == 10)
        begins[1:] |= (kinds[1:] != kinds[:-1]) & (kinds[1:] != 0) & (kinds[:-1] != 0) & (octets[:-1] != 39)
        return begins

    @staticmethod
    def _doubtful(words: pa.Array) -> np.ndarray:
        """Whether each word must be looked at before it is encoded alone: white space or no ASCII at its end or behind a space or newline at its start."""
        octets = np.frombuffer(words.buffers()[2] or b"", dtype=np.uint8)
        bounds = np.frombuffer(words.buffers()[1], dtype=np.int64)[: len(words) + 1]
        first, last = bounds[:-1], bounds[1:] - 1
        inner = np.minimum(first + ((octets[first] == 32) | (octets[first] == 10)), last)
        plain = lambda at: (KINDS[octets[at]] != 0) | (octets[np.maximum(at - 1, 0)] == 0xC3)
        return ~plain(last) | ~((KINDS[octets[inner]] != 0) | (octets[inner] == 0xC3))

    def _encode(self, texts: list[str]) -> list[bytes]:
        """A distinct word is one string and one look-up; its occurrences are numbers."""
        if not self.cuts:
            return self.raw(texts)
        apart = [i for i, t in enumerate(texts) if "\0" in t or any(x in t for x in self.added)]
        parts = [t.encode() for t in texts]
        for i in apart:
            parts[i] = b""
        data = b"".join(parts)
        of_texts = np.cumsum([0, *map(len, parts)])
        del parts
        begins = self._begins(np.frombuffer(data, dtype=np.uint8))
        begins[of_texts[:-1][np.diff(of_texts) > 0]] = True
        starts = np.append(np.flatnonzero(begins), len(data)).astype(np.int64)
        del begins
        words = pa.Array.from_buffers(pa.large_string(), len(starts) - 1, [None, pa.py_buffer(starts), pa.py_buffer(data)]).dictionary_encode()
        distinct = words.dictionary.to_numpy(zero_copy_only=False).tolist()
        found = list(map(self.words.get, distinct))
        lacking = [i for i, x in enumerate(found) if x is None]
        if lacking:
            doubtful = self._doubtful(words.dictionary)[lacking].tolist()
            lacking = [i for i, look in zip(lacking, doubtful, strict=True) if not look or ALONE(distinct[i])]
            for i, x in zip(lacking, self._new_words([distinct[i] for i in lacking]), strict=True):
                found[i] = x
        made = pa.array(found, pa.large_binary()).take(words.indices)
        # a null has no bytes, so offsets hold for all
        ends = np.frombuffer(made.buffers()[1], dtype=np.int64)[: len(made) + 1] if len(made) else np.zeros(1, dtype=np.int64)
        at = np.searchsorted(starts, of_texts)
        bounds = ends[at].tolist()
        ids = memoryview(made.buffers()[2] or b"")
        out = [bytes(ids[a:b]) for a, b in zip(bounds, bounds[1:], strict=False)]
        if made.null_count:
            nulls = np.append(0, np.cumsum(made.is_null().to_numpy(zero_copy_only=False)))[at]
            apart += np.flatnonzero(np.diff(nulls)).tolist()
        for i, x in zip(apart, self.raw([texts[i] for i in apart]), strict=True):
            out[i] = x
        return out


_encoders: dict[tuple[str, bool], WordEncoder] = {}


keeps_cache("token files", _encoders.clear)


def encoder_at(path: str, as_text: bool = True) -> WordEncoder:
    if (path, as_text) not in _encoders:
        _encoders[path, as_text] = WordEncoder(path, as_text)
    return _encoders[path, as_text]


def encode_texts(docs: DataFrame, tokenizer_path: str, end_id: int, key: str = "doc_id", text: str = "text", as_text: bool = True) -> DataFrame:
    """(key, ids binary of uint32 or uint16, bucket) for every row with a key; a null text is empty, end_id closes each."""
    bounded_batches(docs.sparkSession)
    # a key counts once for each unit of bytes that its row has begun, so that ranges are of like sizes
    units = F.floor(F.coalesce(F.octet_length(text), F.lit(0)) / UNIT_BYTES).cast("int")
    keyed = docs.where(F.col(key).isNotNull()).select(F.col(key).cast("bigint").alias("k"), units.alias("u"))
    total = keyed.agg(F.sum(F.col("u").cast("bigint") + 1)).first()[0] or 0
    n = min(MOST_RANGES, max(1, -(-total * UNIT_BYTES // RANGE_BYTES)))
    probs = [i / n for i in range(1, n)]
    weighted = keyed.select("k", F.explode(F.sequence(F.lit(0), "u")))
    bounds = sorted(set(weighted.agg(F.percentile_approx("k", probs, max(10_000, 4 * n))).first()[0] or [])) if probs else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder_at(tokenizer_path, as_text)
        end = np.array([end_id], dtype=enc.kind).tobytes()
        edges = np.array(bounds, dtype=np.int64)

        def encoded() -> pa.RecordBatch:
            keys = np.concatenate([b.column("k").to_numpy() for b in held])
            texts = [t or "" for b in held for t in b.column("t").to_pylist()]
            held.clear()
            ids = [x + end for x in enc.encode(texts)]
            width = np.full(len(ids), enc.kind.itemsize, dtype=np.int32)
            return pa.record_batch({"k": keys, "ids": pa.array(ids, pa.binary()), "width": width, "bucket": np.searchsorted(edges, keys, side="left").astype(np.int32)})

        # small batches together, as the words of more text are fewer for their number
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.nbytes for b in held) >= SPLIT_CHARS:
                yield encoded()
        if held:
            yield encoded()

    rows = docs.where(F.col(key).isNotNull()).select(F.col(key).cast("bigint").alias("k"), F.col(text).alias("t"))
    return rows.mapInArrow(frugal(run, "token files"), "k bigint, ids binary, width int, bucket int").repartitionById(len(bounds) + 1, "bucket").sortWithinPartitions("bucket", "k", "ids")


def _ids(raw: bytes, width: int) -> np.ndarray:
    return np.frombuffer(raw, dtype="<u2" if width == 2 else "<u4")


def id_counts(tokens: DataFrame) -> DataFrame:
    """(id, n): how often each id occurs; counted in each task before it is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(0, dtype=np.int64)
        for batch in batches:
            if batch.num_rows:
                width = batch.column("width")[0].as_py()
                found = np.bincount(_ids(b"".join(batch.column("ids").to_pylist()), width), minlength=len(counts))
                found[: len(counts)] += counts
                counts = found.astype(np.int64)
        at = np.flatnonzero(counts)
        yield pa.record_batch({"id": at.astype(np.int32), "n": counts[at]})

    return tokens.select("ids", "width").mapInArrow(frugal(run), "id int, n bigint").groupBy("id").agg(F.sum("n").alias("n"))


def write_token_files(docs: DataFrame, tokenizer_path: str, path: str, end_id: int = 0, key: str = "doc_id", text: str = "text", as_text: bool = True) -> str:
    """Encode docs and write the data set at path; returns path.

    Rows with a null key are left out (they have no place in key order); a null text gives end_id
    alone; rows that repeat a key are all written, next to each other. as_text reads an added token's content (such as
    <|endoftext|>) as plain text; without it such content gets the token's id, as in the library by default. What reaches the driver is
    the counts of the ids, a table that the vocabulary bounds.
    """
    spark = docs.sparkSession
    tokens = materialize(encode_texts(docs, tokenizer_path, end_id, key, text, as_text), "tokens")
    counted = id_counts(tokens).toPandas().sort_values(["n", "id"], ascending=[False, True])
    of_rank = counted["id"].to_numpy(dtype=np.int64)
    rank_of = np.zeros(int(of_rank.max(initial=-1)) + 1, dtype=np.uint32)
    rank_of[of_rank] = np.arange(len(of_rank), dtype=np.uint32)
    schema = "rank int, id int"
    rows = [(r, int(i)) for r, i in enumerate(of_rank)]
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{path}/ranks")
    shared = spark.sparkContext.broadcast(rank_of)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks, keys, parts, held, bucket, made = shared.value, [], [], 0, None, 0

        def block() -> pa.RecordBatch:
            nonlocal keys, parts, held, made
            control, data = pack(ranks[np.concatenate(parts)])
            lengths = np.array([len(p) for p in parts], dtype="<u4")
            row = (int(bucket), f"{bucket}-{keys[0]}-{keys[-1]}-{zlib.crc32(data)}-{made}", keys[0], len(keys), int(lengths.sum(dtype=np.int64)), np.array(keys, dtype="<i8").tobytes(), lengths.tobytes(), control, data)
            keys, parts, held, made = [], [], 0, made + 1
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, kinds, strict=True)], names)

        for batch in batches:
            for k, raw, width, b in zip(*[batch.column(c).to_pylist() for c in ("k", "ids", "width", "bucket")], strict=True):
                if parts and (b != bucket or held >= BLOCK_TOKENS):
                    yield block()
                bucket = b
                keys.append(k)
                parts.append(_ids(raw, width))
                held += len(parts[-1])
        if parts:
            yield block()

    names = ["bucket", "block", "first_key", "n_docs", "n_tokens", "keys", "lengths", "control", "data"]
    kinds = [pa.int32(), pa.string(), pa.int64(), pa.int32(), pa.int64(), *[pa.binary()] * 4]
    tokens.mapInArrow(frugal(run), "bucket int, block string, first_key bigint, n_docs int, n_tokens bigint, keys binary, lengths binary, control binary, data binary").write.parquet(f"{path}/blocks")
    discard(tokens)
    return path


def read_token_files(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """One row a document, read from the files: key, start, n_tokens, ids_crc32 and, if asked for, ids.

    start counts the ids of all documents before it. Offsets come from running sums over block
    sizes, first over key ranges and then inside each, not over documents.
    """
    blocks = spark.read.parquet(f"{path}/blocks")
    of_rank = spark.read.parquet(f"{path}/ranks").toPandas().sort_values("rank")["id"].to_numpy(dtype="<u4")  # the vocabulary bounds it
    shared = spark.sparkContext.broadcast(of_rank)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = shared.value[unpack(row["control"], row["data"], row["n_tokens"])]
                lengths = np.frombuffer(row["lengths"], dtype="<u4").astype(np.int64)
                ends = np.cumsum(lengths)
                raw = memoryview(ids.tobytes())
                spans = [raw[4 * (e - n) : 4 * e] for e, n in zip(ends.tolist(), lengths.tolist(), strict=True)]
                out = {"key": np.frombuffer(row["keys"], dtype="<i8"), "block": [row["block"]] * len(spans), "before": ends - lengths, "n_tokens": lengths, "ids_crc32": np.array([zlib.crc32(s) for s in spans], dtype=np.int64)}
                if with_ids:
                    out["ids"] = pa.array([np.frombuffer(s, dtype="<u4").astype(np.int64) for s in spans], pa.list_(pa.int64()))
                yield pa.record_batch(out)
            give_back()

    docs = blocks.select("block", "n_tokens", "keys", "lengths", "control", "data").mapInArrow(frugal(run), "key bigint, block string, before bigint, n_tokens bigint, ids_crc32 bigint" + ", ids array<bigint>" * with_ids)
    small = blocks.select("bucket", "block", "first_key", "n_tokens")
    ranges = small.groupBy("bucket").agg(F.sum("n_tokens").alias("n"))
    ranges = ranges.select("bucket", F.coalesce(F.sum("n").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("range_start"))
    inside = Window.partitionBy("bucket").orderBy("first_key", "block").rowsBetween(Window.unboundedPreceding, -1)
    small = small.withColumn("inner", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
    starts = small.join(ranges, "bucket").select("block", (F.col("range_start") + F.col("inner")).alias("block_start"))
    return docs.join(starts, "block").select("key", (F.col("block_start") + F.col("before")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * with_ids)


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = new_path(spark, "token-files")
    write_token_files(table(spark, sf_dir, "documents", "doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"), path, as_text=False)
    return read_token_files(spark, path).withColumnRenamed("key", "doc_id")
