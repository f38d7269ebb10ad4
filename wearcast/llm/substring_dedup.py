"""Removal of passages that recur, word for word, anywhere in the corpus.

A window is ``width`` consecutive words of one text. A word goes if it lies in
a window whose words also start at another place, in the same text or another.

1. Confirm: every window's 64-bit hash is sent, once a pack, to the bucket of
   its value (``packs``); the bucket answers which of them start at two places
   or more. Nothing is sampled and no window is left out.
2. Compile: consecutive confirmed windows form a passage. Each pack, a shard of
   the corpus, compiles its passages into one Aho-Corasick automaton: phrases
   of ``width`` words that cover the passage end to end, from its first window
   to its last.
3. Locate: every text of the shard streams through the automaton, word by word
   (a word is one symbol), and each occurrence marks its words.

A shard's automaton holds no more than the shard's own words, so its size does
not grow with the corpus and no text has to meet another shard's phrases:
whatever recurs in a shard is among that shard's passages. Two different
windows share a hash with a probability of 2**-64 a pair.

Scale: the shuffles carry about 6 bytes a word and the compressed texts; a
passage in a third of all texts is one key a pack. Defined cases: null text
has no words; texts shorter than a window keep everything; repeated rows are
copies like any other and lose all their windows; null or repeated ids are
kept and answered row by row; empty tables give empty results; extra columns
are ignored.
"""

from __future__ import annotations

from itertools import compress

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wearcast.llm import packs as P
from wearcast.llm.words import Tokens, rolling

WIDTH = 35
#: Code points for words: above the surrogates; two symbols a word where one alphabet is too small.
_FIRST, _ALPHABET = 0xE000, 0x100000


def _windows(rows: pa.Table, width: int) -> tuple[Tokens, np.ndarray, np.ndarray]:
    t = Tokens(rows.column("text").combine_chunks() if rows.num_rows else pa.array([], pa.string()), lower=False)
    at, w = rolling(t.hashes(), t.bounds, width)
    return t, at, w


def _send(width: int, buckets: int):
    def run(name: str, rows: pa.Table):
        _, _, w = _windows(rows, width)
        keys, n = np.unique(w, return_counts=True)
        cuts = P.bucket_cuts(keys, buckets)
        for b in np.flatnonzero(np.diff(cuts)):
            own = slice(cuts[b], cuts[b + 1])
            yield pa.record_batch([pa.array([b], pa.int32()), [name], pa.array([P.write_keys(keys[own])], pa.binary()),
                                   pa.array([np.packbits(n[own] > 1).tobytes()], pa.binary())], ["bucket", "pack", "keys", "twice"])

    return run


def _confirm(bucket: pa.Table) -> pa.Table:
    """Which keys of each pack occur at two places or more."""
    keys = [P.read_keys(k.as_py()) for k in bucket.column("keys")]
    twice = [np.unpackbits(np.frombuffer(t.as_py(), np.uint8), count=len(k)).astype(bool) for t, k in zip(bucket.column("twice"), keys)]
    every = np.sort(np.concatenate(keys))
    again = every[1:][every[1:] == every[:-1]]
    again = np.unique(np.concatenate([again, *(k[t] for k, t in zip(keys, twice))]))

    def flags(k):
        at = np.minimum(np.searchsorted(again, k), len(again) - 1)
        return np.packbits(again[at] == k if len(again) else np.zeros(len(k), bool)).tobytes()

    return pa.table({"pack": bucket.column("pack"), "bucket": bucket.column("bucket"), "flags": pa.array([flags(k) for k in keys], pa.binary())})


def _symbols(t: Tokens, wanted: np.ndarray) -> tuple[np.ndarray, int]:
    """Symbols of the words (0 for those not wanted; equal bytes, equal symbol) and how many symbols a word takes."""
    at = np.flatnonzero(wanted)
    size = t.ends[at] - t.starts[at]
    off = np.concatenate([[0], np.cumsum(size)])
    data = t.data[np.repeat(t.starts[at] - off[:-1], size) + np.arange(off[-1])]
    words = pa.Array.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(off.astype(np.int64)), pa.py_buffer(data)])
    code = pc.dictionary_encode(words).indices.to_numpy().astype(np.int64) + 1
    n = int(code.max(initial=0)) + 1
    out = np.zeros(len(wanted), np.int64)
    out[at] = code
    if n <= _ALPHABET:
        return out, 1
    half = _ALPHABET // 2  # the two symbols of a word come from different halves
    return np.stack([out // half, half + out % half], 1).ravel(), 2


def locate(t: Tokens, at: np.ndarray, recurs: np.ndarray, width: int) -> np.ndarray:
    """Which words of a shard lie in an occurrence of a recurring phrase."""
    marked = np.zeros(len(t.starts) + 1, np.int64)
    if not recurs.any():
        return marked[:-1] > 0
    window = np.zeros(len(t.starts), bool)
    window[at[recurs]] = True
    begins = np.flatnonzero(recurs)  # passages: runs of recurring windows that follow each other in one text
    new = np.concatenate([[True], (np.diff(at[begins]) != 1) | (t.bounds[np.searchsorted(t.bounds, at[begins[1:]], "right") - 1] == at[begins[1:]])])
    first = at[begins[new]]
    last = at[begins[np.concatenate([np.flatnonzero(new)[1:] - 1, [len(begins) - 1]])]]
    cover = np.zeros(len(t.starts) + 1, np.int64)
    np.add.at(cover, first, 1)
    np.add.at(cover, last + width, -1)
    symbol, wide = _symbols(t, np.cumsum(cover[:-1]) > 0)
    line = (symbol + _FIRST).astype(np.uint32).tobytes().decode("utf-32-le")
    machine = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
    for a, z in zip(first.tolist(), last.tolist()):
        for p in (*range(a, z, width), z):
            machine.add_word(line[p * wide:(p + width) * wide])
    machine.make_automaton()
    rows = np.flatnonzero(t.counts >= width)
    for a, z in zip(t.bounds[rows].tolist(), t.bounds[rows + 1].tolist()):
        for end, _ in machine.iter(line, a * wide, z * wide):
            stop = (end + 1) // wide
            marked[stop - width] += 1
            marked[stop] -= 1
    return np.cumsum(marked[:-1]) > 0


def _cut(width: int):
    def run(rows: pa.Table, answers: pa.Table) -> pa.Table:
        t, at, w = _windows(rows, width)
        keys, place = np.unique(w, return_inverse=True)
        recurs = np.zeros(len(keys), bool)
        if answers.num_rows:
            order = np.argsort(answers.column("bucket").to_numpy())
            flags = answers.column("flags")
            size = answers.column("n").to_numpy()
            recurs = np.concatenate([np.unpackbits(np.frombuffer(flags[i].as_py(), np.uint8), count=size[i]) for i in order.tolist()]).astype(bool)
        gone = locate(t, at, recurs[place], width)
        n_words, n_gone, kept, spans = t.counts, [], [], []
        for text, a, z in zip(rows.column("text").to_pylist(), t.bounds[:-1].tolist(), t.bounds[1:].tolist()):
            words = (text or "").encode().split()
            own = gone[a:z]
            n_gone.append(int(own.sum()))
            edge = np.flatnonzero(np.diff(np.concatenate([[False], own, [False]]))).tolist() if n_gone[-1] else []
            spans.append([{"start": s, "end": e} for s, e in zip(edge[::2], edge[1::2])])
            kept.append(b" ".join(compress(words, (~own).tolist()) if n_gone[-1] else words).decode())
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        return pa.table([rows.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_gone, pa.int64()), pa.array(spans, kind), pa.array(kept, pa.string())],
                        ["doc_id", "n_words", "n_removed", "spans", "kept"])

    return run


def remove_repeats(docs: DataFrame, width: int = WIDTH, doc_id: str = "doc_id", text: str = "text",
                   pack_bytes: int = P.PACK_BYTES, bucket_bytes: int = P.BUCKET_BYTES) -> DataFrame:
    """doc_id, n_words, n_removed, spans (word numbers removed), kept (the words left, joined by single spaces)."""
    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    packed = P.pack(own, "text", pack_bytes)
    buckets = P.bucket_count(packed, bucket_bytes)
    sent = P.per_pack(packed, _send(width, buckets), "bucket int, pack string, keys binary, twice binary")

    def answer(bucket: pa.Table) -> pa.Table:
        sizes = [len(P.read_keys(k.as_py())) for k in bucket.column("keys")]
        return _confirm(bucket).append_column("n", pa.array(sizes, pa.int32()))

    answers = sent.groupBy("bucket").applyInArrow(answer, "pack string, bucket int, flags binary, n int")
    kind = own.schema["doc_id"].dataType.simpleString()
    return P.with_answers(packed, answers, _cut(width),
                          f"doc_id {kind}, n_words long, n_removed long, spans array<struct<start: int, end: int>>, kept string")
