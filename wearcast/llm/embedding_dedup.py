"""Embedding near-duplicates by a subspace pigeonhole join.

A cosine of ``cosine`` or more between unit vectors is a squared distance of at
most 2 - 2 * cosine. The vectors are turned by one fixed rotation, which spreads
whatever directions the data prefer, and cut into blocks of about
``BLOCK_DIMS`` coordinates. Each block gets a share of the squared distance in
proportion to its dimensions; a linked pair stays within the share of at least
one block. Per block a range join finds all pairs within the share: the vectors
are sorted by a grid over the block's first coordinates, with cells as wide as the
share's root, and cut into chunks; chunks that are nowhere that close in those
coordinates are not compared, and the distance over the whole block decides. The
union over the blocks is verified with the cosine in double precision, and a pair
counts in the first block that finds it.

Equal vectors are one class, so a vector that fills a third of the table is one
point with a weight. Pairs of chunks are read where the chunks were written (a
join without an exchange), so a vector is stored twice at most, however many it is
compared with. No pair leaves its task: a task returns sums of links by class and
spanning edges, as many rows as points.

Defined cases: vectors that are null, empty, zero or hold null or non-finite
components link with nothing and are their own component; vectors of different
lengths never link; repeated rows count as rows of their own, linked with each
other; null ids are kept (their component is the smallest id they reach, if
any); empty tables give empty results; extra columns are ignored. Classes are
told apart by 64-bit hashes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wearcast.llm import packs as P
from wearcast.llm.components import Forest, components
from wearcast.session import pin, shuffle_partitions

COSINE = 0.9
BLOCK_DIMS = 16
GRID_DIMS = 2
CELL_POINTS = 8000  # in a chunk, at most
CHUNK_BYTES = 4 << 20
CHUNKS = 16  # in a partition, at most
_SLACK = 1e-4  # of squared distance, for single precision in the blocks; the cosine decides

_TURNS: dict[int, np.ndarray] = {}


def rotation(dims: int) -> np.ndarray:
    """A fixed orthogonal matrix, the same in every task."""
    if dims not in _TURNS:
        q, r = np.linalg.qr(np.random.Generator(np.random.PCG64(dims)).standard_normal((dims, dims)))
        _TURNS[dims] = q * np.sign(np.diag(r))
    return _TURNS[dims]


def block_edges(dims: int, block_dims: int = BLOCK_DIMS) -> np.ndarray:
    return np.linspace(0, dims, max(1, round(dims / block_dims)) + 1).astype(int)


def unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def _width(cosine: float, dims: int) -> np.ndarray:
    """The squared distance that each block of a linked pair may have."""
    return (2 - 2 * cosine) * np.diff(block_edges(dims)) / dims + _SLACK


POINT = "dims int, cell_0 long, cell_1 long, c long, weight long, vector binary"
CHUNK = "no string, dims int, side double, lo_0 double, hi_0 double, lo_1 double, hi_1 double, c binary, weight binary, vectors binary"


def _points(cosine: float, block: int):
    """The vectors that have such a block, with their grid cells in it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            size = np.diff(b.column("embedding").offsets.to_numpy())
            for dims in np.unique(size).tolist():
                if block >= len(block_edges(dims)) - 1:
                    continue
                part = b.take(pa.array(np.flatnonzero(size == dims)))
                flat = part.column("embedding").flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
                cell = np.floor(_grid(flat, dims, block) / np.sqrt(_width(cosine, dims)[block])).astype(np.int64)
                yield pa.record_batch([pa.array([dims] * len(flat), pa.int32()), pa.array(cell[:, 0]), pa.array(cell[:, 1]), part.column("c"), part.column("weight"),
                                       pa.array([v.tobytes() for v in flat], pa.binary())], ["dims", "cell_0", "cell_1", "c", "weight", "vector"])

    return run


def _grid(vectors: np.ndarray, dims: int, block: int) -> np.ndarray:
    """The coordinates of the grid, 0 where a block has fewer."""
    edges = block_edges(dims)
    first = range(edges[block], min(edges[block] + GRID_DIMS, edges[block + 1]))
    own = unit(vectors.astype(np.float64)) @ rotation(dims)[:, first]
    return np.concatenate([own, np.zeros((len(own), GRID_DIMS - own.shape[1]))], 1)


def _chunk_points(dims: int, kind: str, most: int) -> int:
    return max(1, min(most, CHUNK_BYTES // (max(1, dims) * np.dtype(kind).itemsize)))


def _chunks(cosine: float, block: int, kind: str, most: int):
    """Neighbours in the order of the rows as chunks, with their bounds in the coordinates of the grid."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, held, n = TaskContext.get().partitionId(), [], 0

        def flush(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
            nonlocal n
            t, n = pa.Table.from_batches(rows), n + 1
            dims, data = t.column("dims")[0].as_py(), b"".join(t.column("vector").to_pylist())
            own = _grid(np.frombuffer(data, kind).reshape(-1, dims), dims, block)
            values = [f"{task}-{n}", dims, float(np.sqrt(_width(cosine, dims)[block])), *(float(f(own[:, k])) for k in range(GRID_DIMS) for f in (np.min, np.max)),
                      *(t.column(x).to_numpy().tobytes() for x in ("c", "weight")), data]
            kinds = [pa.string(), pa.int32(), *[pa.float64()] * 5, *[pa.binary()] * 3]
            return pa.record_batch([pa.array([v], k) for v, k in zip(values, kinds)], [x.split(" ")[0] for x in CHUNK.split(", ")])

        for b in batches:
            dims = b.column("dims").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(dims)) + 1).tolist(), b.num_rows]
            for i, j in zip(cuts, cuts[1:]):
                while i < j:
                    if held and held[0].column("dims")[0].as_py() != dims[i]:
                        yield flush(held)
                        held = []
                    room = _chunk_points(int(dims[i]), kind, most) - sum(x.num_rows for x in held)
                    part = b.slice(i, min(j - i, room))
                    held, i = [*held, part], i + part.num_rows
                    if part.num_rows == room:
                        yield flush(held)
                        held = []
        if held:
            yield flush(held)

    return run


def _search(cosine: float, block: int, kind: str):
    """(a, null, links) and spanning edges (a, b, 0) of the linked pairs across two chunks, or inside one."""
    def one(dims: int, same: bool, sides: list[tuple[bytes, bytes, bytes]]) -> pa.RecordBatch | None:
        c, weight = (np.concatenate([np.frombuffer(side[k], np.int64) for side in sides]) for k in (0, 1))
        x = unit(np.concatenate([np.frombuffer(side[2], kind) for side in sides]).astype(np.float64).reshape(-1, dims))
        edges, turned, budget = block_edges(dims), x @ rotation(dims), _width(cosine, dims)
        own = turned[:, edges[block]:edges[block + 1]]
        half, ones = (own * own).sum(1, keepdims=True) / 2, np.ones((len(own), 1))
        # one product a pair: left @ right = -(squared distance) / 2
        left, right = (np.hstack(z).astype(np.float32) for z in ((own, -half, ones), (own, ones, -half)))
        links, forest, out = np.zeros(len(c), np.int64), Forest(len(c)), []

        def verify(u, v):
            real = np.einsum("ij,ij->i", x[u], x[v]) >= cosine
            u, v = u[real], v[real]
            if not len(u):
                return
            apart = np.add.reduceat((turned[u] - turned[v]) ** 2, edges[:-1], axis=1)
            first = (apart[:, :block] > budget[:block]).all(1)
            u, v = u[first], v[first]
            np.add.at(links, u, weight[v])
            np.add.at(links, v, weight[u])
            out.extend((int(c[m]), int(c[n])) for m, n in zip(u.tolist(), v.tolist()) if forest.join(m, n))

        n, reach = len(sides[0][0]) // 8, np.sqrt(budget[block])
        p = np.argsort(own[:n, 0], kind="stable")
        q = p if same else n + np.argsort(own[n:, 0], kind="stable")
        line = own[q, 0]
        for s in range(0, len(p), 512):
            mine = p[s:s + 512]
            begin, end = np.searchsorted(line, own[mine[0], 0] - reach), np.searchsorted(line, own[mine[-1], 0] + reach, "right")
            for e in range(max(begin, s) if same else begin, end, 1024):
                theirs = q[e:min(e + 1024, end)]
                near = left[mine] @ right[theirs].T >= -budget[block] / 2
                a, b = np.divmod(np.flatnonzero(near), near.shape[1])
                if same:  # each pair once
                    a, b = a[a + s < b + e], b[a + s < b + e]
                for t in range(0, len(a), 50_000):
                    verify(mine[a[t:t + 50_000]], theirs[b[t:t + 50_000]])
        some = np.flatnonzero(links)
        if not len(some):
            return None
        a, b = zip(*out)
        return pa.record_batch([pa.array(c[some].tolist() + list(a), pa.int64()), pa.array([None] * len(some) + list(b), pa.int64()),
                                pa.array(links[some].tolist() + [0] * len(a), pa.int64())], ["a", "b", "links"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                same = r["no"] == r["other"]
                found = one(r["dims"], same, [(r["c"], r["weight"], r["vectors"])] + ([] if same else [(r["other_c"], r["other_weight"], r["other_vectors"])]))
                if found is not None:
                    yield found

    return run


def _pairs(chunks: DataFrame) -> DataFrame:
    """Each two chunks of a dimension, and each with itself, unless they are too far apart in the grid; no equality in the
    condition, so that chunks are read in pairs and not dealt by a key."""
    a, b = chunks.alias("a"), chunks.alias("b")
    near = [f"a.lo_{k} - a.side <= b.hi_{k} AND b.lo_{k} - a.side <= a.hi_{k}" for k in range(GRID_DIMS)]
    return a.join(b.hint("shuffle_replicate_nl"), F.expr(" AND ".join(["a.no <= b.no", "a.dims <= b.dims", "a.dims >= b.dims", *near]))) \
        .select("a.no", "a.dims", "a.c", "a.weight", "a.vectors", F.col("b.no").alias("other"), *[F.col(f"b.{x}").alias(f"other_{x}") for x in ("c", "weight", "vectors")])


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """One row a vector: vec_id, n_links, component_id (smallest id reachable), kept (vec_id is the component's)."""
    if not 0 < cosine <= 1:
        raise ValueError("cosine must be above 0 and at most 1")
    all_finite = F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    fit = F.col("e").isNotNull() & all_finite & F.exists("e", lambda x: x != 0)
    spark = vectors.sparkSession
    single = vectors.select(embedding).schema[0].dataType.elementType.simpleString() == "float"
    kind = "<f4" if single else "<f8"
    own = F.col(embedding) if single else F.col(embedding).cast("array<double>")
    rows = vectors.select(F.col(vec_id).alias("vec_id"), own.alias("own"), F.col(embedding).cast("array<double>").alias("e"))
    rows = rows.withColumn("c", F.when(fit, F.xxhash64("e")))  # null: links with nothing
    classes = pin(rows.filter("c is not null").groupBy("c").agg(F.first("own").alias("embedding"), F.count(F.lit(1)).alias("weight")))
    size = classes.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("embedding")).alias("dims")).first()
    chunks = math.ceil(size["n"] / _chunk_points(size["dims"] or 1, kind, CELL_POINTS))
    parts = max(1, min(chunks, math.ceil(math.sqrt(4 * shuffle_partitions(spark)))), math.ceil(chunks / CHUNKS))
    found = spark.createDataFrame([], "a long, b long, links long")
    for block in range(len(block_edges(size["dims"])) - 1 if size["n"] else 0):
        P.release(spark)
        points = classes.select("embedding", "c", "weight").mapInArrow(_points(cosine, block), POINT)
        dealt = points.repartitionByRange(parts, "dims", "cell_0", "cell_1", "c").sortWithinPartitions("dims", "cell_0", "cell_1", "c")
        dealt = pin(dealt.mapInArrow(_chunks(cosine, block, kind, CELL_POINTS), CHUNK))
        P.release(spark)
        found = found.union(pin(_pairs(dealt).mapInArrow(_search(cosine, block, kind), "a long, b long, links long")))
        del points, dealt
    degree = found.filter("b is null").groupBy(F.col("a").alias("c")).agg(F.sum("links").alias("links"))
    member = components(found.filter("b is not null")).select(F.col("node").alias("c"), "component")
    alone = rows.filter("c is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    classes = classes.select("c", "weight").join(degree, "c", "left").join(member, "c", "left") \
        .select("c", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "c").alias("component"))
    linked = rows.filter("c is not null").select("vec_id", "c").join(classes, "c")
    lowest = linked.groupBy("component").agg(F.min("vec_id").alias("component_id"))
    linked = linked.join(lowest, "component").select("vec_id", "n_links", "component_id")
    return linked.union(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
