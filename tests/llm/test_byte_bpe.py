"""The tree against tiktoken, the exact round trip, and the defined edge cases."""

import base64
import hashlib
import random

import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken

from tests.conftest import SF_MID
from wearcast.llm import byte_bpe as B

PATH = P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def codec():
    return B.Codec(B.read_ranks(PATH), P.PATTERN, leaf_bytes=3)  # short leaves: many joins


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_every_token_alone_is_itself(codec):
    assert all(codec.merge(token) == [rank] for token, rank in codec.ranks.items())


def test_random_texts_equal_the_library(codec, library):
    rng = random.Random(7)
    alphabets = ["ab", "aab b", "the in er on an re he ", "0123456789 .,-", "é€𝄞ßñ a", " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85  x",
                 "".join(map(chr, range(32, 127))), "的一是不了ａ１"]
    for k in range(3000):
        t = "".join(rng.choice(rng.choice(alphabets)) for _ in range(rng.randint(0, 90))) if k % 2 else \
            "".join(rng.choices(rng.choice(alphabets), k=rng.randint(0, 300)))
        ids = codec.encode(t).tolist()
        assert ids == library.encode_ordinary(t), repr(t)
        assert codec.decode(ids) == t.encode()


def test_long_pieces_equal_the_library(codec, library):
    for t in ("a" * 5000, "ab" * 3000, "-" * 3001, " " * 2000 + "x", "antidisestablishment" * 300, "É" * 999, "\n" * 1500):
        assert codec.encode(t).tolist() == library.encode_ordinary(t)
        assert codec.tree(t.encode()) == codec.merge(t.encode())


def test_special_token_strings_are_ordinary_text(codec, library):
    assert codec.encode("a<|endoftext|>b").tolist() == library.encode_ordinary("a<|endoftext|>b")


def test_documents_round_trip(spark, library):
    docs = spark.read.parquet(f"{SF_MID}/documents.parquet")
    got = {r["doc_id"]: r for r in B.digests(B.decode(B.encode(docs, PATH, P.PATTERN), PATH, P.PATTERN)).collect()}
    rows = docs.collect()
    assert len(got) == len(rows)
    for r in rows:
        ids = library.encode_ordinary(r["text"] or "")
        g = got[r["doc_id"]]
        assert (g["n_tokens"], g["ids_sha256"]) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert g["decoded_sha256"] == hashlib.sha256((r["text"] or "").encode()).hexdigest()


def test_edge_rows(spark):
    rows = [(1, None, "x"), (1, None, "x"), (None, "", "y"), (2, "a" * 200_000, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    out = B.digests(B.decode(B.encode(docs, PATH, P.PATTERN), PATH, P.PATTERN)).collect()
    empty = hashlib.sha256(b"").hexdigest()
    assert sorted((r["doc_id"] or 0, r["n_tokens"] > 0, r["decoded_sha256"] == empty) for r in out) == \
        [(0, False, True), (1, False, True), (1, False, True), (2, True, False)]
    assert B.encode(docs.limit(0), PATH, P.PATTERN).count() == 0
    with pytest.raises(KeyError):
        B.Codec(B.read_ranks(PATH), P.PATTERN).decode_column(pa.array([[50256]], pa.list_(pa.int32())))
    none = spark.createDataFrame([(1, None)], "doc_id long, ids array<int>")
    assert B.digests(B.decode(none, PATH, P.PATTERN)).first()["n_tokens"] == 0


def test_round_trip_equals_both_steps(spark):
    import corpus_pipeline as C
    from wearcast.llm import byte_bpe
    docs = spark.createDataFrame([(1, "Hello, wörld! " * 3000), (2, None), (None, ""), (1, "a\u0000b")], "doc_id long, text string")
    once = byte_bpe.round_trip(docs, C.RANKS, C.PATTERN)
    twice = byte_bpe.decode(byte_bpe.encode(docs, C.RANKS, C.PATTERN), C.RANKS, C.PATTERN)
    assert sorted(map(str, once.collect())) == sorted(map(str, twice.collect())) and once.columns == twice.columns
    assert byte_bpe.round_trip(docs.limit(0), C.RANKS, C.PATTERN).count() == 0
