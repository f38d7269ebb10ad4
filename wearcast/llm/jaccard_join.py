"""Exact Jaccard self-join of documents on word shingles, by a count-vector R-tree.

A document is the set of its distinct ``width``-word shingles (64-bit hashes).
Documents with the same set form a class, represented once. The shingles of a
class are dealt by hash to ``GROUPS`` groups; the counts by group are a point.
The overlap of two sets is at most the sum over the groups of the smaller
count, so an R-tree over the points, walked against itself from the root down,
discards pairs of boxes, then of points, that cannot reach the overlap the
threshold asks for. Survivors are verified on the sets.

Which points share a tree: a linked pair agrees on at least ``percent`` % of
either set, so, with every set in one global order, the two share a shingle
among the first of theirs (prefix: what ``percent`` leaves, and one). Trees are
built per shared prefix shingle and size class; sizes of linked sets differ by
what ``percent`` leaves at most, so a point is at home in one size class and
visits the next. The global order puts shingles that few
documents hold first, as far as a sketch of fixed size (``SKETCH_SLOTS``
counters, 4 MB as broadcast) can tell; the order is the same for all whatever
the sketch says, so no link depends on it. A tree of more than ``TREE_POINTS``
points is cut into chunks and built for each pair of chunks.

A group of thousands of near copies has millions of links but one component, so
the search for all links is preceded by a round that finds many cheaply: sets
that share one of two smallest hashes, a chunk of at most ``VERIFY_SETS`` at a
time, with the same tree and the same verification. What it links is one
component before the search begins, and the search only returns pairs that lie
in different components. The round decides nothing else: the search is complete
by itself.

Defined cases: null text and text without words give the empty set, linked with
nothing, a component of its own; fewer words than a shingle are one shingle;
repeated rows and null ids are kept and answered row by row (a component
without any id has a null id); empty tables give empty results; extra columns
are ignored. Sets are told apart by 64-bit hashes.
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
from wearcast.llm.words import Tokens, mix, rolling
from wearcast.session import pin

WIDTH, PERCENT = 5, 80
GROUPS = 128
SKETCH_SLOTS = 1 << 22
SKETCH_PARTS = 16
TREE_POINTS = 2000
TREE_ROWS = 50_000  # rows of trees in one task's table
VERIFY_SETS = 1000
_LEAF = 12
_FULL = 0xFFFF
_TURN = np.uint64(0x7F4A7C159E3779B9)


# ---------------------------------------------------------------- sets
def shingle_sets(column: pa.Array, width: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each row."""
    t = Tokens(column, lower=True)
    h = t.hashes()
    at, w = rolling(h, t.bounds, width)
    cut = np.searchsorted(at, t.bounds)
    for a, z, i, j in zip(t.bounds[:-1].tolist(), t.bounds[1:].tolist(), cut[:-1].tolist(), cut[1:].tolist()):
        if j > i:
            yield np.unique(w[i:j])
        elif z > a:
            yield rolling(h[a:z], np.array([0, z - a]), z - a)[1]
        else:
            yield np.zeros(0, np.uint64)


def point_of(own: np.ndarray) -> np.ndarray:
    """Counts of a set's shingles by group; a count that does not fit 16 bits is left at the top, where it rules nothing out."""
    return np.minimum(np.bincount((own & np.uint64(GROUPS - 1)).astype(np.int64), minlength=GROUPS), _FULL).astype(np.uint16)


def wide(points: np.ndarray) -> np.ndarray:
    """Points ready for sums; a full count stands for any number."""
    out = points.reshape(-1, GROUPS).astype(np.int64)
    out[out == _FULL] = 1 << 40
    return out


def need(n: np.ndarray, percent: int) -> np.ndarray:
    """Least overlap with any set that makes a link with a set of n."""
    return (percent * n + 99) // 100


def prefix(own: np.ndarray, level: np.ndarray, percent: int) -> np.ndarray:
    """The first shingles of a set in the global order (sketched frequency, then hash)."""
    p = len(own) - int(need(np.array(len(own)), percent)) + 1
    rank = level[(own >> np.uint64(64 - int(math.log2(len(level)))))].astype(np.uint64) << np.uint64(56) | own >> np.uint64(8)
    return own[np.lexsort((own, rank))[:p]]


# ---------------------------------------------------------------- R-tree over count vectors
class Tree:
    """Boxes over points, packed by size and then by the widest group; level 0 holds the points themselves."""

    def __init__(self, n: np.ndarray, points: np.ndarray):
        order = np.argsort(n, kind="stable")
        slab = max(_LEAF, int(math.sqrt(len(n) / _LEAF)) * _LEAF)
        parts = []
        for a in range(0, len(n), slab):
            own = order[a:a + slab]
            parts.append(own[np.argsort(points[own, np.argmax(points[own].var(0))], kind="stable")])
        self.order = np.concatenate(parts)
        self.high, self.least, self.most = [points[self.order]], [n[self.order]], [n[self.order]]
        while len(self.high[-1]) > 1:
            cut = np.arange(0, len(self.high[-1]), _LEAF)
            self.high.append(np.maximum.reduceat(self.high[-1], cut))
            self.least.append(np.minimum.reduceat(self.least[-1], cut))
            self.most.append(np.maximum.reduceat(self.most[-1], cut))

    def self_join(self, percent: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of different points, each once, that the bound cannot rule out."""
        a = b = np.zeros(1, np.int64)
        for level in range(len(self.high) - 1, -1, -1):
            keep = []
            for s in range(0, len(a), 8192):
                x, y = a[s:s + 8192], b[s:s + 8192]
                low_x, low_y = self.least[level][x], self.least[level][y]
                bound = np.minimum(self.high[level][x], self.high[level][y]).sum(1)
                fits = (100 * self.most[level][x] >= percent * low_y) & (100 * self.most[level][y] >= percent * low_x)
                keep.append(fits & ((100 + percent) * bound >= percent * (low_x + low_y)))
            keep = np.concatenate(keep)
            a, b = a[keep], b[keep]
            if level == 0 or not len(a):
                break
            n = len(self.high[level - 1])
            step = np.arange(_LEAF)
            left = (a[:, None] * _LEAF + step)[:, :, None].repeat(_LEAF, 2).reshape(len(a), -1)
            right = (b[:, None] * _LEAF + step)[:, None, :].repeat(_LEAF, 1).reshape(len(a), -1)
            ok = (left < n) & (right < n) & ((left < right) if level == 1 else (left <= right))
            a, b = left[ok], right[ok]
        return self.order[a], self.order[b]


def _near(n: np.ndarray, points: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    if len(n) < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return Tree(n, points).self_join(percent)


# ---------------------------------------------------------------- steps
def _sketch(packs: DataFrame, width: int, slots: int) -> np.ndarray:
    """Level (twice the binary logarithm) of how often the shingles of each slot occur; a fixed size for any corpus."""
    size, shift = slots // SKETCH_PARTS, np.uint64(64 - int(math.log2(slots)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(slots, np.uint32)
        for b in batches:
            for data in b.column("rows"):
                column = P.read_rows(data.as_py()).column("text").combine_chunks()
                t = Tokens(column, lower=True)
                _, w = rolling(t.hashes(), t.bounds, width)
                total += np.bincount((w >> shift).astype(np.int64), minlength=slots).astype(np.uint32)
        codec = pa.Codec("zstd")
        task = TaskContext.get().partitionId() % 32
        for k in range(SKETCH_PARTS):
            yield pa.record_batch([pa.array([k], pa.int32()), pa.array([task], pa.int32()),
                                   pa.array([codec.compress(total[k * size:(k + 1) * size].astype(np.uint64).tobytes(), asbytes=True)], pa.binary())],
                                  ["part", "lane", "counts"])

    def add(rows: pa.Table) -> pa.Table:
        codec = pa.Codec("zstd")
        total = sum(np.frombuffer(codec.decompress(x.as_py(), size * 8, asbytes=True), np.uint64) for x in rows.column("counts"))
        return pa.table({"part": rows.column("part")[:1], "lane": pa.array([0], pa.int32()), "counts": pa.array([codec.compress(total.tobytes(), asbytes=True)], pa.binary())})

    shape = "part int, lane int, counts binary"
    summed = packs.select("rows").mapInArrow(count, shape).groupBy("part", "lane").applyInArrow(add, shape).groupBy("part").applyInArrow(add, shape)
    level = np.zeros(slots, np.uint8)
    for r in summed.collect():  # SKETCH_PARTS rows of a fixed size
        own = np.frombuffer(pa.Codec("zstd").decompress(bytes(r["counts"]), size * 8, asbytes=True), np.uint64)
        level[r["part"] * size:(r["part"] + 1) * size] = np.minimum(255, 2 * np.log2(own + 1.0))
    return level


def _features(packs: DataFrame, level: np.ndarray, width: int, percent: int, kind: str) -> DataFrame:
    """One row a document: its place, id, set size, class, smallest shingle, point and prefix."""
    sent = packs.sparkSession.sparkContext.broadcast(level)

    def run(name: str, rows: pa.Table):
        out = []
        for i, own in enumerate(shingle_sets(rows.column("text").combine_chunks(), width)):
            if len(own):
                cls = mix(np.array([mix(own.copy()).sum(dtype=np.uint64) ^ np.uint64(len(own))]))
                least = mix(own ^ _TURN).min()
                out.append((i, len(own), int(cls.view(np.int64)[0]), own[:1].view(np.int64)[0], least.view(np.int64), point_of(own).tobytes(), prefix(own, sent.value, percent).view(np.int64)))
            else:
                out.append((i, 0, None, None, None, None, None))
        at, n, cls, first, second, point, keys = zip(*out)
        yield pa.record_batch([pa.array([name] * len(at)), pa.array(at, pa.int32()), rows.column("doc_id").combine_chunks(), pa.array(n, pa.int64()), pa.array(cls, pa.int64()),
                               pa.array(first, pa.int64()), pa.array(second, pa.int64()), pa.array(point, pa.binary()), pa.array(keys, pa.list_(pa.int64()))],
                              ["pack", "at", "doc_id", "n", "cls", "first", "second", "point", "keys"])

    return P.per_pack(packs, run, f"pack string, at int, doc_id {kind}, n long, cls long, first long, second long, point binary, keys array<long>")


def _cells(classes: DataFrame, percent: int) -> DataFrame:
    """cls, key, home, cell: classes at the prefix shingles they share with others, in their size class and the next."""
    keyed = classes.select("cls", "n", F.explode("keys").alias("key"))
    shared = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("holders")).filter("holders > 1").select("key")
    width = math.log(100 / percent) * 1.0001  # a linked pair's sizes are at most one class apart
    return keyed.join(shared, "key").select("cls", "key", F.floor(F.log("n") / width).cast("int").alias("home")) \
        .select("cls", "key", "home", F.explode(F.array("home", F.col("home") + 1)).alias("cell"))


def _tables(df: DataFrame, rows: int, size: int) -> int:
    """How many tables to deal groups to: of bounded size, and enough for all tasks."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(rows / size))


def _sets(packs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """(g, cls, set) of the wanted (g, cls, pack, at), read again from the packs."""
    def pick(rows: pa.Table, answers: pa.Table) -> pa.Table:
        at, of = np.unique(answers.column("at").to_numpy(), return_inverse=True)
        sets = [s.tobytes() for s in shingle_sets(rows.column("text").take(pa.array(at)).combine_chunks(), width)]
        return pa.table({"g": answers.column("g"), "cls": answers.column("cls"), "set": pa.array([sets[i] for i in of.tolist()], pa.binary())})

    return P.with_answers(packs, wanted, pick, "g long, cls long, set binary")


def _linked(s: np.ndarray, t: np.ndarray, percent: int) -> bool:
    both = len(s) + len(t) - len(np.union1d(s, t))
    return 100 * both >= percent * (len(s) + len(t) - both)


def _edges(found: list[tuple[int, int]]) -> pa.Table:
    a, b = zip(*found) if found else ((), ())
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def _first_links(packs: DataFrame, classes: DataFrame, cells: DataFrame, width: int, percent: int) -> DataFrame:
    """(a, b): spanning edges of what sets of one size class with a common smallest hash link, chunk by chunk."""
    some = cells.select("cls", "home").distinct()  # who shares no prefix shingle has no link
    rows = classes.select("cls", "pack", "at", "first", "second").join(some, "cls") \
        .select("cls", "pack", "at", "home", F.posexplode(F.array("first", "second")).alias("turn", "low"))
    sizes = rows.groupBy("turn", "low", "home").agg(F.count(F.lit(1)).alias("k")).filter("k > 1")
    rows = rows.join(sizes, ["turn", "low", "home"]).select(
        "cls", "pack", "at", F.xxhash64("turn", "low", "home", F.pmod(F.xxhash64("cls", "turn"), F.ceil(F.col("k") / VERIFY_SETS))).alias("g"))
    rows = pin(rows)
    tables = _tables(packs, rows.count(), 2000)

    def link(rows: pa.Table) -> pa.Table:
        g, cls = rows.column("g").to_numpy(), rows.column("cls").to_numpy()
        order = np.lexsort((cls, g))
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(g[order])) + 1, [len(g)]])
        found, data = [], rows.column("set")
        for i, j in zip(cuts[:-1], cuts[1:]):
            own = order[i:j]
            if len(own) < 2:
                continue
            sets = [np.frombuffer(data[k].as_py(), np.uint64) for k in own.tolist()]
            x, y = _near(np.array([len(s) for s in sets]), wide(np.stack([point_of(s) for s in sets])), percent)
            forest = Forest(len(own))
            for p, q in zip(x.tolist(), y.tolist()):
                if forest.root(p) != forest.root(q) and _linked(sets[p], sets[q], percent):
                    forest.join(p, q)
                    found.append((int(cls[own[p]]), int(cls[own[q]])))
        return _edges(found)

    load = _sets(packs, rows, width).withColumn("table", F.pmod(F.xxhash64("g"), F.lit(tables)))
    return pin(load.groupBy("table").applyInArrow(link, "a long, b long"))


def _candidates(classes: DataFrame, cells: DataFrame, member: DataFrame, percent: int) -> DataFrame:
    """(a, b): pairs of classes in different components that the trees cannot rule out, once each."""
    sizes = cells.groupBy("key", "cell").agg(F.count(F.lit(1)).alias("points"), F.max(F.col("home") == F.col("cell")).alias("lived_in")) \
        .filter("points > 1 and lived_in")
    chunks = F.ceil(F.col("points") / TREE_POINTS).cast("int")
    cells = cells.join(sizes, ["key", "cell"]).withColumn("chunk", F.pmod(F.xxhash64("cls"), chunks).cast("int")) \
        .withColumn("other", F.explode(F.sequence(F.lit(0), chunks - 1))) \
        .select("cls", "key", "cell", (F.col("home") == F.col("cell")).alias("lives"), "chunk",
                F.least("chunk", "other").alias("c"), F.greatest("chunk", "other").alias("d"))
    points = classes.select("cls", "n", "point").join(member, "cls", "left").withColumn("member", F.coalesce("component", "cls")).drop("component")
    # a tree whose points are all in one component has nothing to find
    cells = cells.join(points.select("cls", "member"), "cls")
    open_trees = cells.groupBy("key", "cell", "c", "d").agg(F.min("member").alias("x"), F.max("member").alias("y")).filter("x < y").drop("x", "y")
    cells = pin(cells.join(open_trees, ["key", "cell", "c", "d"]))
    tables = _tables(cells, cells.count(), TREE_ROWS)
    rows = cells.join(points.select("cls", "n", "point"), "cls").withColumn("table", F.pmod(F.xxhash64("key", "cell", "c", "d"), F.lit(tables)))

    def search(rows: pa.Table) -> pa.Table:
        col = {c: rows.column(c).to_numpy() for c in ("cls", "key", "cell", "lives", "chunk", "c", "d", "n", "member")}
        points = wide(np.frombuffer(b"".join(rows.column("point").to_pylist()), np.uint16))
        order = np.lexsort((col["cls"], col["d"], col["c"], col["cell"], col["key"]))
        same = np.ones(len(order), bool)
        for c in ("key", "cell", "c", "d"):
            same[1:] &= col[c][order[1:]] == col[c][order[:-1]]
        same[0] = False
        cuts = np.append(np.flatnonzero(~same), len(order))
        found = set()
        for i, j in zip(cuts[:-1], cuts[1:]):
            own = order[i:j]
            x, y = _near(col["n"][own], points[own], percent)
            x, y = own[x], own[y]
            ok = (col["lives"][x] | col["lives"][y]) & ((col["c"][x] == col["d"][x]) | (col["chunk"][x] != col["chunk"][y])) & (col["member"][x] != col["member"][y])
            a, b = col["cls"][x[ok]], col["cls"][y[ok]]
            found.update(zip(np.minimum(a, b).tolist(), np.maximum(a, b).tolist()))
        return _edges(sorted(found))

    return pin(rows.groupBy("table").applyInArrow(search, "a long, b long").distinct())


def _verified(packs: DataFrame, classes: DataFrame, pairs: DataFrame, width: int, percent: int) -> DataFrame:
    """(a, b): the pairs that are links, as spanning edges of what each verification group links.

    A pair is verified where the smallest hashes of its two sets meet, so that near copies meet in few groups and a set
    is sent once a group; large groups are cut into chunks.
    """
    own = classes.select("cls", "first")
    pairs = pairs.join(own.select(F.col("cls").alias("a"), F.col("first").alias("fa")), "a").join(own.select(F.col("cls").alias("b"), F.col("first").alias("fb")), "b")
    pairs = pairs.select("a", "b", F.xxhash64(F.least("fa", "fb"), F.greatest("fa", "fb")).alias("g"))
    many = pairs.groupBy("g").agg(F.count(F.lit(1)).alias("n"))
    chunks = F.ceil(F.sqrt("n") / 32)  # at most some 1,000 pairs a group
    pairs = pairs.join(many, "g").withColumn("x", F.pmod(F.xxhash64("a"), chunks)).withColumn("y", F.pmod(F.xxhash64("b"), chunks)) \
        .select("a", "b", F.xxhash64("g", F.least("x", "y"), F.greatest("x", "y")).alias("g"))
    pairs = pin(pairs)
    ends = pairs.select("g", F.explode(F.array("a", "b")).alias("cls")).distinct()
    sets = _sets(packs, ends.join(classes.select("cls", "pack", "at"), "cls"), width)
    load = sets.withColumn("b", F.lit(None).cast("long")) \
        .union(pairs.select("g", F.col("a").alias("cls"), F.lit(None).cast("binary").alias("set"), "b"))
    tables = _tables(packs, 2 * pairs.count(), 5000)

    def verify(rows: pa.Table) -> pa.Table:
        g, cls, other = rows.column("g").to_numpy(), rows.column("cls").to_numpy(), rows.column("b")
        is_pair = other.is_valid().to_numpy()
        other = other.fill_null(0).to_numpy()
        data = rows.column("set")
        sets = {(x, c): np.frombuffer(data[i].as_py(), np.uint64) for i, (x, c) in enumerate(zip(g.tolist(), cls.tolist())) if not is_pair[i]}
        number = {k: n for n, k in enumerate(sets)}
        forest, found = Forest(len(sets)), []
        todo = np.flatnonzero(is_pair)
        for i in todo[np.lexsort((other[todo], cls[todo], g[todo]))].tolist():
            x, y = (int(g[i]), int(cls[i])), (int(g[i]), int(other[i]))
            # linked already through others: the component is the same
            if forest.root(number[x]) != forest.root(number[y]) and _linked(sets[x], sets[y], percent):
                forest.join(number[x], number[y])
                found.append((x[1], y[1]))
        return _edges(found)

    return load.withColumn("table", F.pmod(F.xxhash64("g"), F.lit(tables))).groupBy("table").applyInArrow(verify, "a long, b long")


def jaccard_components(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a document: doc_id, n_shingles, component_id (the smallest id reachable by links of ``percent`` or more)."""
    packed = P.pack(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text")))
    return _components(packed, width, percent, docs.select(doc_id).schema[0].dataType.simpleString()) \
        .select("doc_id", "n_shingles", "component_id")


def _components(packed: DataFrame, width: int, percent: int, kind: str) -> DataFrame:
    """pack, at, doc_id, n_shingles, component (null for empty sets), component_id."""
    features = _features(packed, _sketch(packed, width, SKETCH_SLOTS), width, percent, kind)
    nodes = pin(features.select("pack", "at", "doc_id", F.col("n").alias("n_shingles"), "cls"))
    P.release(packed.sparkSession)
    classes = pin(features.filter("n > 0").select("cls", "n", "first", "second", "point", "keys", "pack", "at").dropDuplicates(["cls"]))
    P.release(packed.sparkSession)
    cells = pin(_cells(classes, percent))
    P.release(packed.sparkSession)
    first = _first_links(packed, classes, cells, width, percent)
    member = pin(components(first).withColumnRenamed("node", "cls"))
    P.release(packed.sparkSession)
    links = pin(_verified(packed, classes, _candidates(classes, cells, member, percent), width, percent).union(first))
    member = components(links).withColumnRenamed("node", "cls")
    linked = nodes.filter("cls is not null").join(member, "cls", "left") \
        .select("pack", "at", "doc_id", "n_shingles", F.coalesce("component", "cls").alias("component"))
    lowest = linked.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    alone = nodes.filter("cls is null").select("pack", "at", "doc_id", "n_shingles", F.lit(None).cast("long").alias("component"), F.col("doc_id").alias("component_id"))
    return linked.join(lowest, "component").select(alone.columns).union(alone)


def keep_one(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """One row of each component: that with the smallest doc_id (ties: the first row). Rows without words all stay.

    The rows return with all their columns, unchanged.
    """
    packed = P.pack(P.split_text(docs))
    found = _components(packed, width, percent, docs.schema["doc_id"].dataType.simpleString())
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "pack", "at")
    first = found.filter("component is not null").groupBy("component").agg(F.min(place).alias("p")).select("p.pack", "p.at")
    kept = first.union(found.filter("component is null").select("pack", "at"))

    def take(rows: pa.Table, answers: pa.Table) -> pa.Table:
        at = np.sort(answers.column("at").to_numpy())
        return rows.select(["row", "text"]).take(pa.array(at))

    shape = P.split_text(docs).select("row", "text").schema
    return P.join_text(P.with_answers(packed, kept, take, shape), docs)
