"""The join against all pairs of sets, the tree against all pairs of points, and the defined edge cases."""

import random

import numpy as np
import pytest

from wearcast.llm import jaccard_join as J
from wearcast.llm.components import components


def sets_of(texts, width):
    out = []
    for t in texts:
        w = (t or "").encode().lower().split()
        out.append({tuple(w[i:i + width]) for i in range(len(w) - width + 1)} or ({tuple(w)} if w else set()))
    return out


def brute(ids, texts, width, percent):
    sets = sets_of(texts, width)
    up = list(range(len(ids)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i
    for i in range(len(ids)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * len(sets[i] | sets[j]):
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    low = {}
    for i in range(len(ids)):
        low.setdefault(root(i), []).append(ids[i])
    return sorted(((ids[i], len(sets[i]), min((x for x in low[root(i)] if x is not None), default=None)) for i in range(len(ids))), key=str)


def made(rng, n):
    base = [[rng.choice("abcdefghij") * rng.randint(1, 3) for _ in range(rng.randint(5, 70))] for _ in range(n // 12)]
    texts = []
    for _ in range(n):
        w = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
            w[rng.randrange(len(w))] = f"e{rng.randint(0, 50)}"
        texts.append(" ".join(w).upper() if rng.random() < 0.2 else "  ".join(w))
    return texts


@pytest.mark.parametrize("percent,tree", [(90, 2000), (80, 6)])
def test_equals_all_pairs(spark, percent, tree, monkeypatch):
    monkeypatch.setattr(J, "TREE_POINTS", tree)
    monkeypatch.setattr(J, "VERIFY_SETS", 4 if tree == 6 else 1000)
    texts = made(random.Random(percent), 260) + [None, "", "a", "a", "a b", "A b", "b a", " a  b ", "x " * 400]
    ids = list(range(len(texts)))
    random.Random(1).shuffle(ids)
    docs = spark.createDataFrame([(i, t, 5) for i, t in zip(ids, texts)], "doc_id long, text string, component long").repartition(4)
    got = sorted(map(tuple, J.jaccard_components(docs, 3, percent).collect()), key=str)
    assert got == brute(ids, texts, 3, percent)


def test_tree_keeps_every_pair_the_bound_allows():
    rng = np.random.default_rng(2)
    for k in (2, 13, 150, 400):
        center = rng.poisson(4, (max(1, k // 10), J.GROUPS))
        points = np.maximum(center[rng.integers(0, len(center), k)] + rng.integers(-1, 2, (k, J.GROUPS)) * (rng.random((k, J.GROUPS)) < 0.1), 0)
        n = points.sum(1)
        a, b = J._near(n, J.wide(points.astype(np.uint16)), 90)
        got = {frozenset(x) for x in zip(a.tolist(), b.tolist())}
        want = {frozenset((i, j)) for i in range(k) for j in range(i)
                if 190 * np.minimum(points[i], points[j]).sum() >= 90 * (n[i] + n[j]) and 100 * n[i] >= 90 * n[j] and 100 * n[j] >= 90 * n[i]}
        assert got == want and len(a) == len(got)


def test_keep_one_returns_whole_rows(spark):
    docs = spark.createDataFrame([(5, "a b c d", "x", 1), (3, "A B C D", "y", 2), (3, "a b c d", "z", 3), (None, "a b c d", "n", 4), (None, "own", "m", 5), (7, None, None, 6),
                                  (8, "", None, 7), (None, None, None, 8)], "doc_id long, text string, pack string, at int")
    kept = J.keep_one(docs)
    assert kept.columns == docs.columns
    rows = kept.collect()
    assert sorted(r["at"] for r in rows if r["at"] > 4) == [5, 6, 7, 8] and sum(r["doc_id"] == 3 for r in rows) == 1 and len(rows) == 5
    assert J.keep_one(docs.limit(0)).count() == 0


def test_components_of_chains_stars_and_loops(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(30)] + [(7, 7), (None, 3), (200, None), (300, 301), (301, 300), (5, 115)]
    rng.shuffle(edges)
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))
    want = {i: 0 for i in range(61)} | {100 + i: 0 for i in range(30)} | {300: 300, 301: 300}
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
