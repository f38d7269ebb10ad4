"""Held-out accuracy, the estimate against a direct Kneser-Ney, and the defined edge cases."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from tests.conftest import SF_MID
from wearcast.llm import toxicity as T


def direct(texts, labels, order, discount=T.DISCOUNT):
    """Differences of every string by dictionaries: (known, other)."""
    count = [Counter(), Counter()]
    for t, y in zip(texts, labels):
        for w in t.lower().split():
            b = b"\x00" * (order - 1) + w.encode() + b" "
            for i in range(order - 1, len(b)):
                count[y][b[i - order + 1:i + 1]] += 1
    keys = set(count[0]) | set(count[1])
    levels = [keys]
    for _ in range(order - 1):
        levels.append({k[1:] for k in levels[-1]})
    follows = [None] + [Counter(k[1:] for k in levels[i]) for i in range(order - 1)]

    def lower(g, level):
        if len(g) == 0 or level == order:
            return 1 / 256
        c = follows[level]
        same = [k for k in c if k[:-1] == g[:-1]]
        total = sum(c[k] for k in same)
        if not total:
            return lower(g[1:], level + 1)
        return (max(c[g] - discount, 0) + discount * len(same) * lower(g[1:], level + 1)) / total

    def p(y, g):
        same = [k for k in count[y] if k[:-1] == g[:-1]]
        total = sum(count[y][k] for k in same)
        if not total:
            return lower(g[1:], 1)
        return max(count[y][g] - discount, 0) / total + discount * len(same) / total * lower(g[1:], 1)

    return {g: math.log(p(1, g) / p(0, g)) for g in keys}


def test_estimate_equals_direct_kneser_ney():
    rng = random.Random(3)
    texts = [" ".join("".join(rng.choice("abé") for _ in range(rng.randint(1, 5))) for _ in range(rng.randint(0, 6))) for _ in range(30)]
    labels = [k % 2 for k in range(30)]
    for order in (2, 3, 4):
        counts = pa.Table.from_batches([T.count_rows(pa.array(texts), np.array(labels), order)])
        model = T.estimate(counts, order)
        want = direct(texts, labels, order)
        got = {int(g).to_bytes(8, "little")[:order]: float(x) for g, x in zip(model.grams, model.known)}
        assert got.keys() == want.keys()
        # the lowest order ends in a uniform byte probability
        assert all(abs(got[g] - want[g]) < 2e-3 for g in want), max(abs(got[g] - want[g]) for g in want)


def test_held_out_accuracy(spark):
    from wearcast.llm.queries import QUERIES
    out = QUERIES["op10_toxicity"](spark, SF_MID)
    labels = spark.read.parquet(f"{SF_MID}/labels.parquet")
    rows = out.join(labels, "doc_id").filter("held_out").collect()
    hit = sum(r["predicted"] == r["toxic"] for r in rows) / len(rows)
    assert hit > 0.93 and out.count() == 1000
    held = [r for r in out.join(labels, "doc_id").collect() if r["held_out"] and r["toxic"] == 1]
    assert sum(r["predicted"] for r in held) >= 0.7 * len(held)  # 300 labels to learn from here


def test_edge_rows(spark):
    docs = spark.createDataFrame([(1, "you idiot fool", 9), (1, "you idiot fool", 9), (2, "a fine day", 9), (3, None, 9), (None, "idiot", 9),
                                  (4, "", 9), (5, "a " * 50_000, 9)], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (5, None), (None, 1)], "doc_id long, toxic int")
    model = T.fit(docs, labels)
    got = T.score(docs, model)
    assert got.columns == ["doc_id", "score"] and got.count() == 7
    assert all(0 <= r["score"] <= 1 for r in got.collect())
    assert T.remove_toxic(docs, model).columns == docs.columns
    assert T.fit(docs, labels.limit(0)) == 0.0
    assert T.fit(docs, labels.filter("doc_id = 2")) == 0.0 and T.fit(docs, labels.filter("toxic = 1")) == 1.0
    assert T.score(docs.limit(0), model).count() == 0
    assert {r["score"] for r in T.score(docs, 1.0).collect()} == {1.0}
