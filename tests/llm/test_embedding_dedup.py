"""Links and components against the full matrix of cosines, and the defined edge cases."""

import numpy as np
import pytest

from wearcast.llm import embedding_dedup as E


def brute(ids, vectors, cosine):
    n = len(ids)
    ok = [v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) for v in vectors]
    link = np.zeros((n, n), bool)
    for i in range(n):
        for j in range(i):
            if ok[i] and ok[j] and len(vectors[i]) == len(vectors[j]):
                a, b = np.array(vectors[i], float), np.array(vectors[j], float)
                link[i, j] = link[j, i] = a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= cosine
    comp = list(range(n))
    for _ in range(n):
        new = [min([comp[i]] + [comp[j] for j in np.flatnonzero(link[i])]) for i in range(n)]
        if new == comp:
            break
        comp = new
    low = [min((ids[j] for j in range(n) if comp[j] == comp[i] and ids[j] is not None), default=None) for i in range(n)]
    return sorted(((ids[i], int(link[i].sum()), low[i], ids[i] == low[i]) for i in range(n)), key=str)


@pytest.mark.parametrize("dims,cosine,cell", [(64, 0.9, 8000), (20, 0.8, 30), (3, 0.95, 8000), (1, 0.9, 8000)])
def test_equals_the_full_matrix(spark, dims, cosine, cell, monkeypatch):
    monkeypatch.setattr(E, "CELL_POINTS", cell)
    rng = np.random.default_rng(dims)
    base = rng.standard_normal((25, dims))
    x = [(base[rng.integers(25)] * rng.uniform(0.1, 9) + rng.standard_normal(dims) * rng.choice([0, 0.05, 0.3, 0.5])).tolist() for _ in range(160)]
    x += [None, [], [0.0] * dims, [float("nan")] * dims, [None] + [1.0] * (dims - 1), [float("inf")] * dims, [1.0] * (dims + 1), [1.0] * (dims + 1), [-0.0] * dims]
    ids = rng.permutation(len(x)).tolist()
    ids[3], ids[7] = None, ids[8]
    df = spark.createDataFrame([(i, v, 0) for i, v in zip(ids, x)], "vec_id long, embedding array<double>, c int").repartition(3)
    got = sorted(((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in E.near_duplicates(df, cosine).collect()), key=str)
    assert got == brute(ids, x, cosine)


def test_empty(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    out = E.near_duplicates(df)
    assert out.count() == 0 and out.columns == ["vec_id", "n_links", "component_id", "kept"]


def test_vectors_are_dealt_once_a_block_and_paired_without_an_exchange(spark):
    rng = np.random.default_rng(5)
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(rng.standard_normal((300, 64)))], "c long, embedding array<float>, weight long")
    for block in range(4):
        points = df.mapInArrow(E._points(0.9, block), E.POINT).sortWithinPartitions("dims", "cell_0", "cell_1", "c")
        chunks = points.mapInArrow(E._chunks(0.9, block, "<f4", 40), E.CHUNK).checkpoint()
        rows = chunks.collect()
        assert sum(len(r["vectors"]) for r in rows) == 300 * 64 * 4 and max(len(r["c"]) for r in rows) == 40 * 8
        plan = E._pairs(chunks)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" in plan and "Exchange" not in plan
        n = len(rows)
        assert E._pairs(chunks).where("no = other").count() == n and n < E._pairs(chunks).count() <= n * (n + 1) // 2
