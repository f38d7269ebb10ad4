"""Removal of recurring passages against a direct count of windows, and the defined edge cases."""

import random
from collections import Counter

import pytest

from wearcast.llm import substring_dedup as S


def brute(texts, width):
    docs = [(t or "").encode().split() for t in texts]
    seen = Counter(tuple(d[i:i + width]) for d in docs for i in range(len(d) - width + 1))
    out = []
    for d in docs:
        gone = {k for i in range(len(d) - width + 1) if seen[tuple(d[i:i + width])] > 1 for k in range(i, i + width)}
        out.append((len(d), len(gone), b" ".join(w for k, w in enumerate(d) if k not in gone).decode()))
    return out


def made(rng, n):
    vocab = [c * k for c in "abcé" for k in (1, 9)]
    shared = [[rng.choice(vocab) for _ in range(rng.randint(3, 12))] for _ in range(6)]
    texts = []
    for _ in range(n):
        words = []
        for _ in range(rng.randint(0, 6)):
            words += rng.choice(shared)[rng.randint(0, 3):] if rng.random() < 0.5 else [f"w{rng.randint(0, 400)}" for _ in range(rng.randint(1, 9))]
        texts.append(rng.choice([" ", "  \n", "\t"]).join(words))
    return texts


@pytest.mark.parametrize("width,pack", [(3, 64), (5, 400), (5, 1 << 20), (35, 1 << 20)])
def test_equals_direct_count(spark, width, pack):
    rng = random.Random(width + pack)
    texts = made(rng, 120) + [None, "", "a", "x " * 500, "x " * 30]
    if width == 35:
        texts += [" ".join(f"p{i}" for i in range(40))] * 3 + [" ".join(f"p{i}" for i in range(3, 39)), " ".join(f"q{i}" for i in range(300))]
    docs = spark.createDataFrame([(i, t, "extra") for i, t in enumerate(texts)], "doc_id long, text string, kept string").repartition(5)
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept"]) for r in S.remove_repeats(docs, width, pack_bytes=pack, bucket_bytes=300).collect()}
    assert [got[i] for i in range(len(texts))] == brute(texts, width)


def test_repeated_and_null_ids(spark):
    t = " ".join(f"w{i}" for i in range(50))
    docs = spark.createDataFrame([(1, t), (1, t), (None, "own words only"), (None, None)], "doc_id long, text string")
    got = sorted((r["doc_id"] or 0, r["n_words"], r["n_removed"], r["kept"], len(r["spans"])) for r in S.remove_repeats(docs).collect())
    assert got == [(0, 0, 0, "", 0), (0, 3, 0, "own words only", 0), (1, 50, 50, "", 1), (1, 50, 50, "", 1)]
    assert S.remove_repeats(docs.limit(0)).count() == 0


def test_two_symbols_a_word(monkeypatch, spark):
    monkeypatch.setattr(S, "_ALPHABET", 8)
    import numpy as np
    import pyarrow as pa
    from wearcast.llm.words import Tokens, rolling
    texts = made(random.Random(5), 40)
    t = Tokens(pa.array(texts), False)
    at, w = rolling(t.hashes(), t.bounds, 4)
    _, place, n = np.unique(w, return_inverse=True, return_counts=True)
    gone = S.locate(t, at, n[place] > 1, 4)
    want = brute(texts, 4)
    assert [int(gone[a:z].sum()) for a, z in zip(t.bounds[:-1], t.bounds[1:])] == [x[1] for x in want]
