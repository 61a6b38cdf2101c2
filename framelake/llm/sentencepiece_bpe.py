"""SentencePiece encoding and decoding: exact merge-type encoding by backtracking.

Greedy merging by score is equivalent to finding the one segmentation in which every two adjacent
pieces are compatible, that is, in which merging the characters of the two again yields those two
pieces. So an encoder walks the text taking the longest piece at each place (all matches come from
one Aho-Corasick pass), steps down to the next shorter prefix piece where the pair is incompatible,
steps back where no prefix is left, and marks in a bit field the positions from which no encoding
goes on, so that no position is tried twice.

Pieces never hold a word-start sign behind another character in the model that is used (checked at
load time; a model in which one does is encoded as one chunk), so a text falls into chunks at word
starts that are encoded alone and kept in a bounded cache.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import struct
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.llm.common import Admitted, bounded_batches, frugal, keeps_cache, table

SPACE = "▁"
#: Chunks kept by a Python worker (those that it meets again); pairs kept for compatibility, beyond which
#: that cache starts anew.
CACHED_CHUNKS, CACHED_PAIRS = 250_000, 250_000


class PieceModel:
    """A byte-fallback BPE model read through the sentencepiece library; encodes and decodes by itself."""

    def __init__(self, path: str):
        lib = sentencepiece.SentencePieceProcessor(model_file=path)
        n = lib.get_piece_size()
        self.bos, self.eos, self.unk = lib.bos_id(), lib.eos_id(), lib.unk_id()
        self.pieces = [lib.id_to_piece(i) for i in range(n)]
        special = [lib.is_control(i) or lib.is_unknown(i) or lib.is_byte(i) for i in range(n)]
        self.control = {i for i in range(n) if lib.is_control(i)}
        self.byte_of = {i: int(p[3:5], 16) for i, p in enumerate(self.pieces) if lib.is_byte(i)}
        self.id_of_byte = {b: i for i, b in self.byte_of.items()}
        self.score = {p: lib.get_score(i) for i, p in enumerate(self.pieces) if not special[i]}
        self.id_of = {p: i for i, p in enumerate(self.pieces) if not special[i]}
        self.splits = not any(SPACE in p.lstrip(SPACE) for p in self.id_of)
        # What only a chain of merges can reach: a piece that merging its own characters doesn't yield is never a result.
        self.reach = {p for p in self.id_of if len(p) == 1 or self.merge(p) == [p]}
        self.auto = ahocorasick.Automaton()
        for p in self.reach:
            self.auto.add_word(p, p)
        self.auto.make_automaton()
        self.prefix: dict[str, str | None] = {}
        for p in self.reach:
            self.prefix[p] = next((p[:k] for k in range(len(p) - 1, 0, -1) if p[:k] in self.reach), None)
        self.pairs: dict[tuple[str, str], bool] = {}
        self.chunks = Admitted(CACHED_CHUNKS)

    def merge(self, text: str) -> list[str]:
        """The plain definition: merge the neighbours whose joint piece scores highest, leftmost first."""
        sym: list[str | None] = list(text)
        nxt, prv = list(range(1, len(sym) + 1)), list(range(-1, len(sym) - 1))
        heap: list[tuple[float, int, int, str]] = []

        def offer(i: int, j: int) -> None:
            if i >= 0 and j < len(sym) and (s := self.score.get(sym[i] + sym[j])) is not None:
                heapq.heappush(heap, (-s, i, j, sym[i] + sym[j]))

        for i in range(len(sym) - 1):
            offer(i, i + 1)
        while heap:
            _, i, j, both = heapq.heappop(heap)
            if sym[i] is None or sym[j] is None or sym[i] + sym[j] != both or nxt[i] != j:
                continue
            sym[i], sym[j], nxt[i] = both, None, nxt[j]
            if nxt[j] < len(sym):
                prv[nxt[j]] = i
            offer(prv[i], i)
            offer(i, nxt[i])
        return [s for s in sym if s is not None]

    def compatible(self, left: str, right: str) -> bool:
        pair = (left, right)
        known = self.pairs.get(pair)
        if known is None:
            if len(self.pairs) >= CACHED_PAIRS:
                self.pairs.clear()
            known = self.pairs[pair] = self.merge(left + right) == [left, right]
        return known

    def segment(self, text: str) -> list[str]:
        """The pieces of text; a character that the model lacks is a piece of its own, whatever its neighbours are."""
        n = len(text)
        longest: list[str | None] = [None] * n
        for end, p in self.auto.iter(text):
            start = end - len(p) + 1
            if (known := longest[start]) is None or len(known) < len(p):
                longest[start] = p
        pairs, out, pos, failed = self.pairs, [], 0, 0
        piece = longest[0] if n else None
        while pos < n:
            if piece is None and longest[pos] is None:
                out.append(text[pos])  # unknown: nothing merges over it
                pos += 1
                piece = longest[pos] if pos < n else None
                continue
            while True:
                end = pos + len(piece)
                if not failed >> end & 1 and (not out or out[-1] not in self.reach or (self.compatible(out[-1], piece) if (ok := pairs.get((out[-1], piece))) is None else ok)):
                    out.append(piece)
                    pos = end
                    piece = longest[pos] if pos < n else None
                    break
                if (shorter := self.prefix[piece]) is not None:
                    piece = shorter
                    continue
                failed |= 1 << pos
                piece = out.pop()
                pos -= len(piece)
        return out

    def chunk_ids(self, chunk: str) -> list[int]:
        ids: list[int] = []
        for p in self.segment(chunk):
            if (i := self.id_of.get(p)) is not None:
                ids.append(i)
            elif self.id_of_byte:
                ids += [self.id_of_byte[b] for b in p.encode()]
            else:
                ids.append(self.unk)
        return ids

    def pieces_text(self, ids: list[int]) -> str:
        """ids as text, word-start signs as spaces, runs of byte pieces as UTF-8."""
        out, raw = [], bytearray()
        for i in ids:
            if (b := self.byte_of.get(i)) is not None:
                raw.append(b)
                continue
            if raw:
                out.append(raw.decode("utf-8", "replace"))
                raw.clear()
            out.append("" if i in self.control else " ⁇ " if i == self.unk else self.pieces[i].replace(SPACE, " "))
        if raw:
            out.append(raw.decode("utf-8", "replace"))
        return "".join(out)

    def decode(self, ids: list[int]) -> str:
        text = self.pieces_text(ids)
        return text[1:] if text.startswith(" ") else text

    def known_chunk(self, chunk: str) -> tuple[bytes, str]:
        """Ids as little-endian bytes, and their text, of '▁' + chunk."""
        found = self.chunks.get(chunk)
        if found is None:
            ids = self.chunk_ids(SPACE + chunk)
            found = (struct.pack(f"<{len(ids)}I", *ids), self.pieces_text(ids))
            self.chunks.offer(chunk, found)
        return found

    def encode_text(self, text: str) -> tuple[bytes, str]:
        """Ids of the whole text, without begin and end, as little-endian bytes; and the text that they decode to."""
        if not text:
            return b"", ""
        if not self.splits:
            found = [self.known_chunk(text.replace(" ", SPACE))]
        elif SPACE in text or "  " in text or text[0] == " " or text[-1] == " ":
            # each chunk goes without its first sign, which known_chunk() adds
            found = [self.known_chunk(c[1:]) for c in _CHUNK.findall(SPACE + text.replace(" ", SPACE))]
        else:
            get, known = self.chunks.get, self.known_chunk
            found = [get(w) or known(w) for w in text.split(" ")]
        return b"".join([f[0] for f in found]), "".join([f[1] for f in found])[1:]

    def encode(self, text: str, begin_end: bool = True) -> list[int]:
        raw = self.encode_text(text)[0]
        ids = list(struct.unpack(f"<{len(raw) // 4}I", raw))
        return [self.bos, *ids, self.eos] if begin_end else ids


_CHUNK = re.compile(f"{SPACE}+[^{SPACE}]*")
_models: dict[str, PieceModel] = {}


def model_at(path: str) -> PieceModel:
    if path not in _models:
        _models[path] = PieceModel(path)
    return _models[path]


def forget_chunks() -> None:
    """Drop the chunks that this worker has kept, and what is known of pairs."""
    for m in _models.values():
        m.chunks, m.pairs = Admitted(CACHED_CHUNKS), {}


keeps_cache("sentencepiece", forget_chunks)


def encode_documents(docs: DataFrame, model_path: str, key: str = "doc_id", text: str = "text", with_ids: bool = False, with_text: bool = False) -> DataFrame:
    """Encode every whole text and decode the ids again; a null text counts as empty.

    Returns key, n_tokens, ids_sha256, decoded_sha256, with with_ids also ids (array of int,
    begin and end included), and with with_text decoded. An empty text has the begin and the end id alone. Rows with a null key and repeated
    rows give a row each; other columns are ignored. A map over partitions: no shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model_at(model_path)
        first, last = struct.pack("<I", m.bos), struct.pack("<I", m.eos)
        for batch in batches:
            n, ids, ids_sha, text_sha, texts = [], [], [], [], []
            for t in batch.column("t").to_pylist():
                raw, decoded = m.encode_text(t or "")
                raw = first + raw + last
                n.append(len(raw) // 4)
                ids_sha.append(hashlib.sha256(raw).hexdigest())
                text_sha.append(hashlib.sha256(decoded.encode()).hexdigest())
                if with_ids:
                    ids.append(raw)
                if with_text:
                    texts.append(decoded)
            out = {"k": batch.column("k"), "n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(ids_sha, pa.string()), "decoded_sha256": pa.array(text_sha, pa.string())}
            if with_ids:
                ends = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
                out["ids"] = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(ids), dtype="<i4")))
            if with_text:
                out["decoded"] = pa.array(texts, pa.string())
            yield pa.record_batch(out)

    bounded_batches(docs.sparkSession)
    kind = dict(docs.dtypes)[key]
    out = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInArrow(frugal(run, "sentencepiece"), f"k {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids + ", decoded string" * with_text)
    return out.withColumnRenamed("k", key)


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_documents(table(spark, sf_dir, "documents", "doc_id", "text"), public_tokenizers.path("piece_bpe_32k.model"))
