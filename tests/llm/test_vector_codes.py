"""Codes and codebooks against a plain version in Python integers; the grid against all distances; edge rows."""

import hashlib
import random

import numpy as np

from tests.conftest import SF_MID
from tests.oracle import compare
from wearcast.llm import vector_codes as V


def plain(rows, parts=4, entries=256, rounds=4):
    """rows: (vec_id, vector, label), usable vectors of one length."""
    rows = sorted(([r[0], [int(np.floor(1024 * x)) for x in r[1]], r[2]] for r in rows), key=lambda r: (r[0], r[1]))
    wide = len(rows[0][1]) // parts
    cut = [[r[1][p * wide:(p + 1) * wide] for p in range(parts)] for r in rows]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]

    def assign():
        return [[min((sum((a - b) ** 2 for a, b in zip(c[p], e)), k) for k, e in enumerate(books[p])) for p in range(parts)] for c in cut]

    for _ in range(rounds):
        near = assign()
        for p in range(parts):
            for k in range(len(books[p])):
                mine = [c[p] for c, n in zip(cut, near) if n[p][1] == k]
                if mine:
                    books[p][k] = [sum(col) // len(mine) for col in zip(*mine)]
    near = assign()
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    error = [sum(d for d, _ in n) for n in near]
    by = {}
    for r, e in zip(rows, error):
        by[r[2]] = by.get(r[2], 0) + e
    return sorted((r[0], "".join(f"{k:02x}" for _, k in n), e, by[r[2]], sha) for r, n, e in zip(rows, near, error))


def made(spark, rows):
    return spark.createDataFrame([(i, v, label, "x") for i, v, label in rows], "vec_id long, embedding array<float>, label int, v string")


def coded(df):
    return sorted(tuple(r) for r in df.select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect())


def test_small_tables(spark):
    rng = random.Random(2)
    for n, entries in ((5, 256), (90, 16)):
        rows = [(i, [float(np.float32(rng.gauss(0, 0.1))) for _ in range(8)], rng.choice([None, 1, 2])) for i in range(n)]
        rows += [(i + 1000, list(rows[0][1]), 1) for i in range(n)]  # many copies
        assert coded(V.compress(made(spark, rows), entries=entries)) == plain(rows, entries=entries)


def test_grid_equals_all_distances():
    rng = np.random.default_rng(3)
    for spread, cell in ((5, 4), (100, 32), (3000, 7)):
        book = rng.integers(-spread, spread, (40, 6))
        book[7] = book[3]  # a tie for whatever is nearest to both
        x = np.concatenate([rng.integers(-spread, spread, (500, 6)), book, np.zeros((3, 6), int)])
        memo = V.Memo(book, cell)
        for _ in range(2):  # the second time from the memo
            entry, distance = memo.nearest(x)
            every = ((x[:, None] - book[None]) ** 2).sum(axis=2)
            assert (entry == every.argmin(axis=1)).all() and (distance == every.min(axis=1)).all()
        assert memo.bounded <= len(np.unique(np.floor_divide(x, cell), axis=0)) and memo.evaluated <= 2 * every.size


def test_dominated_entries_are_left_out():
    memo = V.Memo(np.array([[0, 0], [1000, 1000], [8, 8]]), 16)
    memo.nearest(np.array([[1, 2], [3, 4], [14, 15], [1, 2]]))
    assert (memo.looked_up, memo.bounded, memo.evaluated) == (4, 1, 8)  # one cell, two entries left in it


def test_edge_rows(spark):
    ok = [0.1, 0.2, 0.3, 0.4]
    rows = [(1, ok, None), (2, None, 1), (3, [0.1, None, 0.2, 0.3], 1), (4, [float("nan")] * 4, 1), (5, [float("inf"), 0.0, 0.0, 0.0], 1), (1, ok, 2), (6, [0.5], 2), (None, ok, None),
            (7, [1e30, -1e30, 0.0, 0.0], 3)]
    got = coded(V.compress(made(spark, rows)).filter("vec_id is not null"))
    assert [r[0] for r in got] == [1, 1, 6, 7] and got[2][1:4] == (None, None, None)
    assert got[0][1] == "00000000" and got[0][2] == 0  # equal entries: the lower index
    assert V.compress(made(spark, rows)).filter("vec_id is null").count() == 1
    assert V.compress(made(spark, rows[1:5])).count() == 0 and V.compress(made(spark, [])).count() == 0
    assert coded(V.compress(made(spark, [(1, [0.5, 0.25, 1.0, 0.0, 0.5], 1), (2, [0.5, 0.25, 1.0, 0.0, 0.5], 1)])))[1][:3] == (2, "00000000", 0)


def test_oracle(spark, duck_mid):
    from wearcast.llm.queries import ORACLES, QUERIES
    ok, msg = compare(QUERIES["op13_vector_codes"](spark, SF_MID), duck_mid, ORACLES["op13_vector_codes"])
    assert ok, msg
