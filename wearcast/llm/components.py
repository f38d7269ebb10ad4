"""Connected components by alternating large-star and small-star steps.

Each step is a grouped minimum (pre-aggregated before the shuffle) and an
equi-join that adaptive execution can split on a hot node; nothing is gathered
in one task or on the driver. Every round is checkpointed, which keeps the
lineage short and survives lost executors. The number of rounds grows with the
logarithm of the number of nodes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wearcast.session import pin


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node that has an edge: component is the smallest node reachable.

    Null ends, loops and repeated edges are ignored; without edges the result is empty.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u > v and v is not null").distinct()
    e = pin(e)
    mark = None
    while True:
        state = e.agg(F.count(F.lit(1)).alias("n"), F.expr("bit_xor(xxhash64(u, v))").alias("x")).first()
        if tuple(state) == mark or not state["n"]:
            break
        mark = tuple(state)
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        hung = large.join(low, "u").filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = pin(hung.union(low.select("u", F.col("m").alias("v"))).distinct())
    roots = e.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)


class Forest:
    """Union-find over row numbers of one bounded group."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.root(i), self.root(j)
        if i != j:
            self.up[max(i, j)] = min(i, j)
        return i != j
