"""Cross-tokenizer alignment by inverted pair bitmaps.

A text is encoded by a byte-level vocabulary (A) and by pieces (B). Byte offsets where tokens of both end cut the tokens into
groups, and an A token and a B token whose byte ranges overlap are linked. Both vocabularies fall apart
at a single space between two other characters, so chunks from space to space are aligned alone, and those that a
worker meets again are kept.

Documents are numbered in blocks of 2**16 numbers. A block's postings have, for each pair of ids, a compressed bitmap of the
documents that hold the pair linked, and a plane for each bit of how often more than once they do: plane k holds the documents in which
bit k of that number is set. A bitmap is a list of 16-bit offsets, or, where that is longer, a bit a document from the
first to the last. Blocks share no documents, so the set bits of a pair's OR-merged bitmap are the sum of
those of its blocks' bitmaps: only that sum is shuffled by pair. The pair's score (its count of documents, and whether
it is the best of its A id) then joins its postings, and these return by block, each plane weighing its power of two, to add the scores up at their documents.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from framelake.llm.common import Admitted, bounded_batches, frugal, keeps_cache, materialize, table
from framelake.llm.token_files import WordEncoder

#: Chunks kept by a Python worker, those that it meets again; characters split at a time; new chunks aligned at a time.
CACHED_CHUNKS, SPLIT_CHARS, NEW_CHUNKS = 300_000, 1 << 19, 4096
#: Documents of a block, and links whose postings are made at a time (a longer document is one block).
BLOCK_DOCS, BLOCK_LINKS = 1 << 16, 1 << 21
#: A pair is a 64-bit integer: 24 bits for the id of A, 24 for that of B, 16 for the document's offset in its block.
ID_BITS, DOC_BITS = 24, 16
#: The plane that holds a pair's documents; those from 0 on hold bits of the occurrences beyond the first.
DOCUMENTS = -1

_EVEN = re.compile(r"\s\s|^\s|\s$")
_CUT = re.compile(r"(?<=\S) (?=\S)")
_SPACE = re.compile(r"\s")


class Aligned(NamedTuple):
    """A chunk: numbers of A ids, B ids and groups as 32-bit integers; its groups as text; its links as 64-bit pairs."""

    counts: bytes
    groups: bytes
    links: bytes


def byte_alphabet() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones for themselves, others for 256 onwards, in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Vocabulary:
    """Token bytes by id, and what vector operations need of them: lengths, and ids as decimal digits with zeros behind."""

    def __init__(self, tokens: list[bytes]):
        self.tokens = tokens
        self.lengths = np.array([len(t) for t in tokens], dtype=np.int64)
        width = len(str(len(tokens)))
        text = np.array([str(i).encode() for i in range(len(tokens))], dtype=f"S{width}")
        self.digits = text.view(np.uint8).reshape(len(tokens), width)
        self.digit_counts = (self.digits > 0).sum(axis=1)


def _per_chunk(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sums of values up to each end since the end before."""
    return np.diff(np.concatenate([[0], np.cumsum(values, dtype=np.int64)])[ends], prepend=0)


def link_chunks(a: np.ndarray, n_a: np.ndarray, b: np.ndarray, n_b: np.ndarray, va: Vocabulary, vb: Vocabulary) -> list[Aligned]:
    """Chunks one behind another, n_a and n_b tokens each, of which both segmentations give the same bytes: a chunk's end is a cut like any other, so all are one sequence."""
    len_a, len_b = va.lengths[a], vb.lengths[b]
    end_a, end_b = np.cumsum(len_a), np.cumsum(len_b)
    start_a, start_b = end_a - len_a, end_b - len_b
    cuts = end_a[end_b[np.searchsorted(end_b, end_a)] == end_a]
    # an A token's links: the B tokens that end behind its start and start before its end
    low, high = np.searchsorted(end_b, start_a, side="right"), np.searchsorted(start_b, end_a, side="left")
    times = high - low
    j = np.arange(int(times.sum())) + np.repeat(low - (np.cumsum(times) - times), times)
    pairs = np.repeat(a, times) << (ID_BITS + DOC_BITS) | b[j] << DOC_BITS
    # groups as text: the tokens of A and then of B in each, a sign behind each token
    group_a, group_b = np.searchsorted(cuts, end_a), np.searchsorted(cuts, end_b)
    order = np.argsort(np.concatenate([group_a * 2, group_b * 2 + 1]), kind="stable")
    width = max(va.digits.shape[1], vb.digits.shape[1])
    text = np.zeros((len(a) + len(b), width + 1), dtype=np.uint8)
    text[: len(a), : va.digits.shape[1]] = va.digits[a]
    text[len(a) :, : vb.digits.shape[1]] = vb.digits[b]
    text[: len(a), width] = np.where(cuts[group_a] == end_a, ord("|"), ord(","))
    text[len(a) :, width] = np.where(cuts[group_b] == end_b, ord(";"), ord(","))
    text = text[order].reshape(-1)
    text = text[text > 0].tobytes()
    lengths = np.concatenate([va.digit_counts[a], vb.digit_counts[b]])[order] + 1
    ends_a, ends_both = np.cumsum(n_a), np.cumsum(n_a + n_b)
    text_ends = np.cumsum(_per_chunk(lengths, ends_both)).tolist()
    link_ends = (np.cumsum(_per_chunk(times, ends_a)) * 8).tolist()
    groups = np.diff(np.searchsorted(cuts, end_a[ends_a - 1], side="right"), prepend=0)
    counts, links = np.stack([n_a, n_b, groups], axis=1).astype("<u4").tobytes(), pairs.tobytes()
    return [Aligned(counts[12 * k : 12 * k + 12], text[s : e - 1], links[x:y]) for k, (s, e, x, y) in enumerate(zip([0, *text_ends], text_ends, [0, *link_ends], link_ends, strict=False))]


class Aligner:
    """Both encoders with what they make of chunks; a chunk whose tokens do not give its bytes is None."""

    def __init__(self, byte_path: str, piece_path: str):
        import sentencepiece

        self.a = WordEncoder(byte_path)
        self.b = sentencepiece.SentencePieceProcessor(model_file=piece_path)
        alphabet = byte_alphabet()
        vocabulary = self.a.lib.get_vocab()
        tokens = [b""] * (max(vocabulary.values()) + 1)
        for t, i in vocabulary.items():
            tokens[i] = bytes(alphabet[c] for c in t) if all(c in alphabet for c in t) else t.encode()
        self.va = Vocabulary(tokens)
        tokens, splits = [], True
        for i in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(i)
            if self.b.is_byte(i):
                tokens.append(bytes([int(piece[3:5], 16)]))
            elif self.b.is_control(i) or self.b.is_unknown(i):
                tokens.append(b"")
            else:
                tokens.append(piece.replace("▁", " ").encode())
                splits &= "▁" not in piece.lstrip("▁")
        self.vb = Vocabulary(tokens)
        self.splits = splits  # else a piece may reach over the start of a word, and texts stay whole
        if max(len(self.va.tokens), len(self.vb.tokens)) > 1 << ID_BITS:
            raise ValueError(f"a vocabulary has more than 2**{ID_BITS} ids")
        self.chunks = Admitted(CACHED_CHUNKS)

    def split(self, text: str) -> list[str]:
        """The chunks of a text, without the space that stands before each."""
        if not self.splits:
            return [text]
        return _CUT.split(text) if _EVEN.search(text) else text.split(" ")

    def _align(self, chunks: list[str]) -> dict[str, Aligned | None]:
        plain, odd = [], []
        for c in chunks:
            (odd if _SPACE.search(c) or not c or "\0" in c else plain).append(" " + c)
        raw = [*(self.a.raw_words(plain) if plain else []), *self.a.raw(odd)]
        both = [c[1:] for c in (*plain, *odd)]
        pieces = self.b.encode(both, num_threads=1)
        k = self.a.kind.itemsize
        n_a, n_b = np.array([len(r) // k for r in raw], dtype=np.int64), np.array([len(p) for p in pieces], dtype=np.int64)
        a, b = np.frombuffer(b"".join(raw), dtype=self.a.kind).astype(np.int64), np.fromiter(chain.from_iterable(pieces), dtype=np.int64, count=int(n_b.sum()))
        octets = [(" " + c).encode() for c in both]
        sizes = np.array([len(o) for o in octets], dtype=np.int64)
        good = (n_a > 0) & (n_b > 0) & (_per_chunk(self.va.lengths[a], np.cumsum(n_a)) == sizes) & (_per_chunk(self.vb.lengths[b], np.cumsum(n_b)) == sizes)
        whole = b"".join(octets)
        if not (good.all() and b"".join([self.va.tokens[i] for i in a.tolist()]) == whole and b"".join([self.vb.tokens[i] for i in b.tolist()]) == whole):
            for i, (x, y) in enumerate(zip(np.split(a, np.cumsum(n_a)[:-1]), np.split(b, np.cumsum(n_b)[:-1]), strict=True)):
                good[i] &= b"".join([self.va.tokens[t] for t in x.tolist()]) == octets[i] and b"".join([self.vb.tokens[t] for t in y.tolist()]) == octets[i]
            a, b = a[np.repeat(good, n_a)], b[np.repeat(good, n_b)]
        made = iter(link_chunks(a, n_a[good], b, n_b[good], self.va, self.vb) if good.any() else [])
        return {c: next(made) if ok else None for c, ok in zip(both, good.tolist(), strict=True)}

    def known(self, chunks: list[str]) -> dict[str, Aligned | None]:
        """What becomes of chunks that are not kept yet."""
        made: dict[str, Aligned | None] = {}
        for at in range(0, len(chunks), NEW_CHUNKS):
            made |= self._align(chunks[at : at + NEW_CHUNKS])
        for c, x in made.items():
            self.chunks.offer(c, x)
        return made

    def texts(self, texts: list[str | None]) -> Iterator[tuple[bytes, bytes, bytes] | None]:
        """(counts of the chunks, groups, links) of each text, None for one without tokens; a few texts are in memory as chunks at a time."""
        some, held = [], 0
        for t in texts:
            some.append(t)
            held += len(t or "")
            if held >= SPLIT_CHARS:
                yield from self._texts(some)
                some, held = [], 0
        yield from self._texts(some)

    def _texts(self, texts: list[str | None]) -> Iterator[tuple[bytes, bytes, bytes] | None]:
        split = [self.split(t) if t else [] for t in texts]
        kept = self.chunks
        new = self.known([*dict.fromkeys(c for chunks in split for c in chunks if c not in kept)])
        for chunks in split:
            parts = [x if (x := new.get(c)) is not None or c in new else kept[c] for c in chunks] if new else [kept[c] for c in chunks]
            if not parts or None in parts:
                yield None
            else:
                yield b"".join([x[0] for x in parts]), b";".join([x[1] for x in parts]), b"".join([x[2] for x in parts])


_aligners: dict[tuple[str, str], Aligner] = {}
keeps_cache("alignment", _aligners.clear)


def aligner_at(byte_path: str, piece_path: str) -> Aligner:
    if (byte_path, piece_path) not in _aligners:
        _aligners[byte_path, piece_path] = Aligner(byte_path, piece_path)
    return _aligners[byte_path, piece_path]


def pack_bitmap(offsets: np.ndarray) -> bytes:
    """A bitmap of ascending 16-bit offsets: themselves, or their first and a bit each from it on, whichever is shorter; the first byte tells which."""
    span = (int(offsets[-1]) - int(offsets[0])) // 8 + 1
    if 2 * len(offsets) <= 2 + span:
        return b"\0" + offsets.astype("<u2").tobytes()
    bits = np.zeros(span * 8, dtype=np.uint8)
    bits[offsets.astype(np.int64) - int(offsets[0])] = 1
    return b"\1" + offsets[:1].astype("<u2").tobytes() + np.packbits(bits, bitorder="little").tobytes()


def unpack_bitmap(data: bytes) -> np.ndarray:
    """The offsets that pack_bitmap() was given."""
    if data[0] == 0:
        return np.frombuffer(data, dtype="<u2", offset=1)
    bits = np.unpackbits(np.frombuffer(data, dtype=np.uint8, offset=3), bitorder="little")
    return (np.flatnonzero(bits) + int.from_bytes(data[1:3], "little")).astype(np.uint16)


def block_postings(keys: np.ndarray) -> Iterator[tuple[np.ndarray, int, np.ndarray, np.ndarray]]:
    """(pairs, plane, ends of the bitmaps, offsets) of a block's links, each a pair's bits above the offset of its document."""
    keys = np.sort(keys)
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])[: len(keys)])
    times = np.diff(np.append(first, len(keys))) - 1
    keys = keys[first]
    plane = DOCUMENTS
    while len(keys):
        pairs = keys >> DOC_BITS
        ends = np.flatnonzero(np.append(pairs[1:] != pairs[:-1], True)) + 1
        yield pairs[ends - 1], plane, ends, (keys & ((1 << DOC_BITS) - 1)).astype(np.uint16)
        if plane == DOCUMENTS:
            rest, left = keys[times > 0], times[times > 0]
        plane += 1
        while len(left) and not (left >> plane & 1).any() and (left >> plane).any():
            plane += 1
        keys = rest[(left >> plane & 1) == 1]


def _posting_rows(block: int, keys: np.ndarray) -> Iterator[pa.RecordBatch]:
    for pairs, plane, ends, offsets in block_postings(keys):
        starts = np.concatenate([[0], ends[:-1]])
        for at in range(0, len(pairs), 1 << 15):
            s, e = starts[at : at + (1 << 15)].tolist(), ends[at : at + (1 << 15)].tolist()
            some = pairs[at : at + (1 << 15)]
            yield pa.record_batch(
                {
                    "block": np.full(len(some), block, dtype=np.int64),
                    "a": (some >> ID_BITS).astype(np.int32),
                    "b": (some & ((1 << ID_BITS) - 1)).astype(np.int32),
                    "plane": np.full(len(some), plane, dtype=np.int32),
                    "card": (ends - starts)[at : at + (1 << 15)].astype(np.int32),
                    "bits": pa.array([pack_bitmap(offsets[x:y]) for x, y in zip(s, e, strict=True)], pa.binary()),
                }
            )


_POSTING = {"block": pa.int64(), "a": pa.int32(), "b": pa.int32(), "plane": pa.int32(), "card": pa.int32(), "bits": pa.binary()}
_DOCUMENT = {"at": pa.int32(), "n_a": pa.int64(), "n_b": pa.int64(), "n_groups": pa.int64(), "n_links": pa.int64(), "groups_sha256": pa.string()}


def postings(docs: DataFrame, byte_path: str, piece_path: str, key: str, text: str, block_docs: int = BLOCK_DOCS, block_links: int = BLOCK_LINKS) -> DataFrame:
    """A row a document (plane null) with its facts and its place (block, at), and the rows of the blocks' postings, from one pass over the texts."""
    kind = dict(docs.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = aligner_at(byte_path, piece_path)
        block, at, held, links = TaskContext.get().partitionId() << 32, 0, 0, []
        schema = None
        for batch in batches:
            schema = schema or pa.schema([pa.field("k", batch.schema.field("k").type), *(pa.field(n, t) for n, t in (_POSTING | _DOCUMENT).items())])
            keys, texts = batch.column("k"), batch.column("t").to_pylist()
            rows: dict[str, list] = {"block": [], "at": [], "n_a": [], "n_b": [], "n_groups": [], "n_links": [], "groups_sha256": []}
            for found in both.texts(texts):
                counts, sha, pairs = (0, 0, 0), "", b""
                if found is not None:
                    counts = np.frombuffer(found[0], dtype="<u4").reshape(-1, 3).sum(axis=0, dtype=np.int64).tolist()
                    sha, pairs = hashlib.sha256(found[1]).hexdigest(), found[2]
                    links.append(np.frombuffer(pairs, dtype=np.int64) | at)
                    held += len(pairs) // 8
                for name, value in zip(rows, (block, at, *counts, len(pairs) // 8, sha), strict=True):
                    rows[name].append(value)
                at += 1
                if at == block_docs or held >= block_links:
                    for made in _posting_rows(block, np.concatenate([np.zeros(0, dtype=np.int64), *links])):
                        yield _padded(made, schema)
                    block, at, held, links = block + 1, 0, 0, []
            yield _padded(pa.record_batch({"k": keys} | {n: pa.array(v, schema.field(n).type) for n, v in rows.items()}), schema)
        if links:
            for made in _posting_rows(block, np.concatenate(links)):
                yield _padded(made, schema)

    columns = f"k {kind}, block bigint, a int, b int, plane int, card int, bits binary, at int, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string"
    return docs.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInArrow(frugal(run, "alignment"), columns)


def _padded(batch: pa.RecordBatch, schema: pa.Schema) -> pa.RecordBatch:
    have = set(batch.schema.names)
    return pa.RecordBatch.from_arrays([batch.column(f.name) if f.name in have else pa.nulls(batch.num_rows, f.type) for f in schema], schema=schema)


def pair_scores(found: DataFrame) -> DataFrame:
    """(a, b, n_docs, n_links, best) of each pair of ids: documents that hold it linked, links, and whether no pair of its A id is in more documents."""
    counted = found.where("plane is not null").groupBy("a", "b").agg(
        F.sum(F.when(F.col("plane") == DOCUMENTS, F.col("card"))).alias("n_docs"),
        F.sum(F.col("card") * F.when(F.col("plane") >= 0, F.expr("shiftleft(1L, plane)")).otherwise(1)).alias("n_links"),
    )
    return counted.withColumn("best", F.col("n_docs") == F.max("n_docs").over(Window.partitionBy("a")))


def returned_scores(found: DataFrame, scores: DataFrame) -> DataFrame:
    """(block, at, n_best, count_sum) of the documents that postings return scores to."""
    scored = found.where("plane is not null").select("block", "a", "b", "plane", "bits").join(scores.select("a", "b", "n_docs", "best"), ["a", "b"])
    times = F.when(F.col("plane") >= 0, F.expr("shiftleft(1L, plane)")).otherwise(1)
    scored = scored.select("block", "bits", (times * F.col("n_docs")).alias("sum"), F.when(F.col("best"), times).otherwise(0).alias("times"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, sums, bests = None, np.zeros(BLOCK_DOCS, dtype=np.int64), np.zeros(BLOCK_DOCS, dtype=np.int64)

        def done() -> pa.RecordBatch:
            at = np.flatnonzero(sums)
            out = pa.record_batch({"block": np.full(len(at), held, dtype=np.int64), "at": at.astype(np.int32), "n_best": bests[at], "count_sum": sums[at]})
            sums[:] = 0
            bests[:] = 0
            return out

        for batch in batches:
            blocks, sum_, times_ = (batch.column(c).to_numpy() for c in ("block", "sum", "times"))
            bits = batch.column("bits")
            cuts = [0, *(np.flatnonzero(blocks[1:] != blocks[:-1]) + 1).tolist(), len(blocks)]
            for s, e in zip(cuts[:-1], cuts[1:], strict=True):
                if s == e:
                    continue
                if held is not None and held != blocks[s]:
                    yield done()
                held = int(blocks[s])
                maps = [unpack_bitmap(x) for x in bits[s:e].to_pylist()]
                sizes = [len(m) for m in maps]
                at = np.concatenate(maps)
                np.add.at(sums, at, np.repeat(sum_[s:e], sizes))
                np.add.at(bests, at, np.repeat(times_[s:e], sizes))
        if held is not None:
            yield done()

    dealt = scored.repartition("block").sortWithinPartitions("block")
    return dealt.mapInArrow(frugal(run), "block bigint, at int, n_best bigint, count_sum bigint")


def align(docs: DataFrame, byte_path: str, piece_path: str, key: str = "doc_id", text: str = "text", block_docs: int = BLOCK_DOCS, block_links: int = BLOCK_LINKS) -> tuple[DataFrame, DataFrame]:
    """(documents, pairs).

    documents has a row for each row of docs: key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256. pairs is what pair_scores() gives
    for the whole table. A null or empty text and one that a vocabulary does not give back have zeros and no digest. Rows
    with a null key and repeated rows are documents of their own, and count as such; other columns are ignored. Strings of special tokens in texts are plain text.
    block_docs (65,536 at most) and block_links bound a block and change no result.
    """
    bounded_batches(docs.sparkSession)
    found = materialize(postings(docs, byte_path, piece_path, key, text, block_docs, block_links), "postings")
    scores = materialize(pair_scores(found), "pairs")
    facts = found.where("plane is null").select("k", "block", "at", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")
    out = facts.join(returned_scores(found, scores), ["block", "at"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return out.select(F.col("k").alias(key), "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256"), scores


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return align(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))[0]
