"""Byte-level BPE encoding and decoding as a monoid tree reduction.

A piece (one match of the splitting pattern) is cut in halves down to short
leaves. A leaf is encoded by merging its lowest-ranked pair until none is left;
two neighbours are joined by re-encoding a window at their border, which grows
until the tokens outside it provably stay as they are. The proof uses a
property of rank-ordered BPE: a token sequence is the encoding of its bytes if
and only if each pair of neighbours, taken alone, encodes to itself. Inside the
kept parts and inside the window that holds already, so the two pairs at the
window's ends decide. Decoding concatenates the tokens' bytes up the same tree.

Pieces are independent, so a text is the concatenation of its pieces and a
document never leaves its row: no shuffle, whatever the length. The rank file
(at most ``MAX_RANK_BYTES``) is read on the driver and broadcast; piece results
are remembered in a cache that is emptied at ``CACHE_PIECES`` entries, which
changes speed only.

Defined cases: null text is the empty text; the empty text has no tokens and
decodes to no bytes; null ids decode to no bytes; an id outside the vocabulary
raises; repeated rows are answered one by one; extra columns are left out.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_RANK_BYTES = 64 << 20
CACHE_PIECES = 200_000
LEAF_BYTES = 24
_NONE = 1 << 62


class Codec:
    """Encoder and decoder for one rank file and splitting pattern."""

    def __init__(self, rank_file: bytes, pattern: str, leaf_bytes: int = LEAF_BYTES):
        self.ranks = {base64.b64decode(token): int(rank) for token, rank in (x.split() for x in rank_file.splitlines() if x)}
        self.bytes_of = {rank: token for token, rank in self.ranks.items()}
        self.size = np.zeros(max(self.bytes_of, default=-1) + 1, np.int64)  # bytes of each token, and where they are in store
        for rank, token in self.bytes_of.items():
            self.size[rank] = len(token)
        self.at = np.cumsum(self.size) - self.size
        self.store = np.frombuffer(b"".join(self.bytes_of[r] for r in sorted(self.bytes_of)), np.uint8)
        self.split = regex.compile(pattern).findall
        self.leaf_bytes = max(1, leaf_bytes)
        self.known = _Pieces(self)
        self.pairs: dict[tuple[int, int], bool] = {}

    # ---- merging without the tree: leaves and windows
    def merge(self, data: bytes) -> list[int]:
        """Encoding of ``data`` by its lowest-ranked pair, leftmost first, until no pair is in the vocabulary."""
        if len(data) > 4 * self.leaf_bytes:
            return self._merge_long(data)
        get = self.ranks.get
        cut = list(range(len(data) + 1))
        rank = [get(data[i:i + 2], _NONE) for i in range(len(data) - 1)]
        while rank:
            low = min(rank)
            if low == _NONE:
                break
            k = rank.index(low)
            del cut[k + 1], rank[k]
            if k < len(rank):
                rank[k] = get(data[cut[k]:cut[k + 2]], _NONE)
            if k:
                rank[k - 1] = get(data[cut[k - 1]:cut[k + 1]], _NONE)
        return [self.ranks[data[a:b]] for a, b in zip(cut, cut[1:])]

    def _merge_long(self, data: bytes) -> list[int]:
        """The same result in n log n, with a heap over a linked list of parts."""
        n, get = len(data), self.ranks.get
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := get(data[i:i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, end = heapq.heappop(heap)
            j = after[i] if alive[i] else n
            if j >= n or after[j] != end:
                continue  # one of the two parts has changed since
            alive[j], after[i] = False, end
            if end < n:
                before[end] = i
                if (r := get(data[i:after[end]])) is not None:
                    heapq.heappush(heap, (r, i, after[end]))
            if (p := before[i]) >= 0 and (r := get(data[p:end])) is not None:
                heapq.heappush(heap, (r, p, end))
        return [self.ranks[data[i:after[i]]] for i in range(n) if alive[i]]

    # ---- the monoid
    def stable(self, left: int, right: int) -> bool:
        """Whether the two tokens, side by side, encode to themselves."""
        key = (left, right)
        found = self.pairs.get(key)
        if found is None:
            if len(self.pairs) >= CACHE_PIECES:
                self.pairs.clear()
            found = self.pairs[key] = self.merge(self.bytes_of[left] + self.bytes_of[right]) == [left, right]
        return found

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """Encoding of the concatenated bytes of two encodings."""
        if not left or not right:
            return left + right
        i, j = 1, 1  # tokens of either side in the window
        while True:
            a, b = max(0, len(left) - i), min(len(right), j)
            window = self.merge(b"".join(self.bytes_of[t] for t in chain(left[a:], right[:b])))
            keep_left = a == 0 or self.stable(left[a - 1], window[0])
            keep_right = b == len(right) or self.stable(window[-1], right[b])
            if keep_left and keep_right:
                return left[:a] + window + right[b:]
            i, j = (i if keep_left else 2 * i), (j if keep_right else 2 * j)

    def tree(self, data: bytes) -> list[int]:
        if len(data) <= self.leaf_bytes:
            return self.merge(data)
        half = len(data) // 2
        return self.join(self.tree(data[:half]), self.tree(data[half:]))

    def encode_piece(self, data: bytes) -> list[int]:
        whole = self.ranks.get(data)
        return [whole] if whole is not None else self.tree(data)

    def encode(self, text: str | None) -> np.ndarray:
        ids = chain.from_iterable(map(self.known.__getitem__, self.split(text))) if text else ()
        return np.fromiter(ids, np.int32)

    def decode(self, ids: list[int] | None) -> bytes:
        if not ids:
            return b""
        if len(ids) <= 4096:
            return b"".join(map(self.bytes_of.__getitem__, ids))
        half = len(ids) // 2
        return self.decode(ids[:half]) + self.decode(ids[half:])

    def decode_column(self, column: pa.Array) -> pa.Array:
        """``decode`` of each row at once: the same concatenation, laid out by the tokens' lengths."""
        column = column.cast(pa.large_list(pa.int32())).fill_null([]) if column.null_count else column.cast(pa.large_list(pa.int32()))
        ids, bounds = column.flatten().to_numpy(), column.offsets.to_numpy()
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.size) or not self.size[ids].all()):
            raise KeyError("an id outside the vocabulary")
        size = self.size[ids]
        end = np.concatenate([[0], np.cumsum(size)])
        data = self.store[np.repeat(self.at[ids] - end[:-1], size) + np.arange(end[-1])]
        off = end[bounds - bounds[0]].astype(np.int64)
        return pa.Array.from_buffers(pa.large_binary(), len(column), [None, pa.py_buffer(off), pa.py_buffer(data)]).cast(pa.binary())


class _Pieces(dict):
    """Encodings of pieces seen so far."""

    def __init__(self, codec: Codec):
        super().__init__()
        self.codec = codec

    def __missing__(self, piece: str) -> list[int]:
        if len(self) >= CACHE_PIECES:
            self.clear()
        found = self.codec.encode_piece(piece.encode("utf-8"))
        if len(piece) <= 64:
            self[piece] = found
        return found


_CODECS: dict[tuple[int, str], Codec] = {}


def _codec(rank_file: bytes, pattern: str) -> Codec:
    """One codec for each Python worker, so that its cache serves all tasks of the worker."""
    key = (hash(rank_file), pattern)
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = Codec(rank_file, pattern)
    return _CODECS[key]


def read_ranks(path: str) -> bytes:
    with open(path, "rb") as f:
        data = f.read(MAX_RANK_BYTES + 1)
    if len(data) > MAX_RANK_BYTES:
        raise ValueError(f"{path} is larger than {MAX_RANK_BYTES} bytes")
    return data


def _batches(n: int, b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    for at in range(0, b.num_rows, n):
        yield b.slice(at, n)


def encode(docs: DataFrame, rank_path: str, pattern: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, ids array<int>: the token ids of each whole text, without special tokens."""
    ranks = docs.sparkSession.sparkContext.broadcast(read_ranks(rank_path))
    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))

    def run(batches):
        codec = _codec(ranks.value, pattern)
        for b in batches:
            for part in _batches(500, b):
                found = [codec.encode(t) for t in part.column(1).to_pylist()]
                bounds = np.cumsum([0, *map(len, found)]).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(bounds), pa.array(np.concatenate(found)))
                yield pa.record_batch([part.column(0), ids], ["doc_id", "ids"])

    return own.mapInArrow(run, f"doc_id {own.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def decode(tokens: DataFrame, rank_path: str, pattern: str, doc_id: str = "doc_id", ids: str = "ids") -> DataFrame:
    """doc_id, ids, decoded binary: the bytes that the ids stand for."""
    ranks = tokens.sparkSession.sparkContext.broadcast(read_ranks(rank_path))
    own = tokens.select(F.col(doc_id).alias("doc_id"), F.col(ids).alias("ids"))

    def run(batches):
        codec = _codec(ranks.value, pattern)
        for b in batches:
            for part in _batches(500, b):
                yield pa.record_batch([part.column(0), part.column(1), codec.decode_column(part.column(1))], ["doc_id", "ids", "decoded"])

    kind = own.schema["doc_id"].dataType.simpleString()
    return own.mapInArrow(run, f"doc_id {kind}, ids array<int>, decoded binary")


def round_trip(docs: DataFrame, rank_path: str, pattern: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``decode(encode(docs))`` in one pass over the texts, so that one Python worker a task does both; the bytes are
    concatenated up the tree."""
    ranks = docs.sparkSession.sparkContext.broadcast(read_ranks(rank_path))
    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))

    def run(batches):
        codec = _codec(ranks.value, pattern)
        for b in batches:
            for part in _batches(500, b):
                found = [codec.encode(t) for t in part.column(1).to_pylist()]
                bounds = np.cumsum([0, *map(len, found)]).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(bounds), pa.array(np.concatenate(found)))
                yield pa.record_batch([part.column(0), ids, pa.array([codec.decode(f.tolist()) for f in found], pa.binary())], ["doc_id", "ids", "decoded"])

    return own.mapInArrow(run, f"doc_id {own.schema['doc_id'].dataType.simpleString()}, ids array<int>, decoded binary")


def digests(decoded: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of ``decode(encode(...))``."""
    joined = F.array_join(F.coalesce("ids", F.expr("array()")).cast("array<string>"), " ")
    return decoded.select("doc_id", F.size(F.coalesce("ids", F.expr("array()"))).cast("long").alias("n_tokens"),
                          F.sha2(joined.cast("binary"), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
