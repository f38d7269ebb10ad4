"""Vector code compression with memoised grid cells.

A vector becomes integers (floor of ``scale`` times each component) and is cut
into ``parts`` equal consecutive parts; each part is coded by the nearest entry
of its position's codebook (integer squared distance, ties to the lower index).
Codebooks start as the parts of the vectors with the smallest ids and go
through a fixed number of rounds of assignment and floored means.

Nearest entries are found through a grid: a part lies in a coarse cell (its
components divided by ``cell``). For the box of a cell every entry has a least
and a largest distance; an entry whose least distance is above another one's
largest is dominated in the whole box. The entries that are left are kept under
the cell, and only those are evaluated exactly, for every part that falls into
it. Dominated entries are strictly farther away, so codes and ties are exact.
The memo of a task has a fixed number of cells and starts anew when it is full,
which costs time and changes nothing.

Scale: one pass over the vectors a round, without moving them: a task sends the
integer sums of its parts by codebook entry (at most parts x entries rows),
which are summed exactly whatever their order, so a task that runs again after
a lost executor gives the same books. The driver holds the codebooks (parts x
entries x components, fixed by the parameters) and no vector but the first ones.

Defined cases: rows whose vector is null or holds null or non-finite components
are dropped; the first vector by id (null ids last, equal ids by components)
sets the length, a vector of another length stays with null code, error and
label_error; a length that the number of parts does not divide is filled with
zeros; integers are held within ``LIMIT`` on both sides, so that no sum
overflows; fewer vectors than entries give smaller codebooks; repeated ids are
vectors of their own; an empty table gives an empty result; null labels are one
label; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wearcast.session import pin

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Side of a grid cell, in integer units: about a quarter of a component's spread, which leaves some ten of 256 entries to evaluate.
CELL = 32
MEMO_CELLS = 1 << 15
LIMIT = 1 << 26
WORK_BYTES = 32 << 20  # of the largest array of one step

Books = list[np.ndarray]


class Memo:
    """Nearest entries of one codebook for parts that come in batches."""

    def __init__(self, book: np.ndarray, cell: int = CELL):
        self.book, self.cell, self.left = book, cell, {}
        self.looked_up = self.bounded = self.evaluated = 0

    def survivors(self, cells: np.ndarray) -> list[np.ndarray]:
        """For each cell the entries that no other entry dominates across its box, ascending."""
        n, k = len(cells), len(self.book)
        least, most = np.zeros((n, k), np.int64), np.zeros((n, k), np.int64)
        for j in range(cells.shape[1]):
            at, which = np.unique(cells[:, j], return_inverse=True)  # few coordinates an axis
            below = at[:, None] * self.cell - self.book[None, :, j]  # from the entry to the lower side
            above = below + self.cell - 1
            near = np.where(below > 0, below, np.where(above < 0, above, 0))
            far = np.maximum(np.abs(below), np.abs(above))
            least += (near * near)[which]
            most += (far * far)[which]
        self.bounded += n
        row, entry = np.nonzero(least <= most.min(axis=1)[:, None])
        return np.split(entry, np.searchsorted(row, np.arange(1, n)))

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(entry, squared distance) of each row of ``x``."""
        d = max(1, x.shape[1])
        step = max(1, WORK_BYTES // (8 * len(self.book) * d))
        out = [self._nearest(x[a:a + step]) for a in range(0, len(x), step)]
        return np.concatenate([e for e, _ in out] or [np.zeros(0, np.int64)]), np.concatenate([e for _, e in out] or [np.zeros(0, np.int64)])

    def _nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cells = np.ascontiguousarray(np.floor_divide(x, self.cell)) if x.shape[1] else np.zeros((len(x), 1), np.int64)
        keys, first, which = np.unique(cells.view(f"V{cells.shape[1] * 8}").ravel(), return_index=True, return_inverse=True)
        names = [k.tobytes() for k in keys]
        if len(self.left) + len(names) > MEMO_CELLS:
            self.left = {}
        new = [i for i, name in enumerate(names) if name not in self.left]
        self.looked_up += len(x)
        if new:
            for i, entries in zip(new, self.survivors(cells[first[new]] if x.shape[1] else np.zeros((len(new), 0), np.int64))):
                self.left[names[i]] = entries.astype(np.int32)
        lists = [self.left[name] for name in names]
        size = np.array([len(e) for e in lists])
        flat, start = np.concatenate(lists), np.cumsum(size) - size
        count = size[which]  # candidates of each row
        ends = np.cumsum(count)
        at = np.repeat(start[which] - (ends - count), count) + np.arange(ends[-1])
        entry = flat[at].astype(np.int64)
        gap = np.repeat(x, count, axis=0) - self.book[entry]
        distance = np.einsum("ij,ij->i", gap, gap)
        self.evaluated += len(entry)
        best = np.minimum.reduceat(distance, ends - count)
        return np.minimum.reduceat(np.where(distance == np.repeat(best, count), entry, len(self.book)), ends - count), best


# ---------------------------------------------------------------- vectors
def usable(vector: Column) -> Column:
    """Not null, without null or non-finite components."""
    return vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < F.lit(float("inf"))))


def integers(column: pa.Array, parts: int, scale: int, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows of the given length, their integer parts as (row, part, component))."""
    fit = np.flatnonzero(pc.fill_null(pc.equal(pc.list_value_length(column), length), False).to_numpy(zero_copy_only=False))
    values = pc.list_flatten(column.take(pa.array(fit))).cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(len(fit), length)
    whole = np.clip(np.floor(values * scale), -LIMIT, LIMIT).astype(np.int64)
    wide = -(-length // parts)
    return fit, np.pad(whole, ((0, 0), (0, wide * parts - length))).reshape(len(fit), parts, wide)


def first_books(rows: DataFrame, parts: int, entries: int, scale: int) -> tuple[int, Books] | None:
    """(length, codebooks) from the vectors with the smallest ids; at most ``entries`` rows reach the driver."""
    def head(of):
        return of.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).select("v").collect()

    found = head(rows)
    if not found:
        return None
    length = len(found[0]["v"])
    if any(len(r["v"]) != length for r in found):
        found = head(rows.filter(F.size("v") == length))
    _, whole = integers(pa.array([r["v"] for r in found], pa.list_(pa.float64())), parts, scale, length)
    return length, [np.ascontiguousarray(whole[:, p]) for p in range(parts)]


def _sums(rows: DataFrame, length: int, books: Books, scale: int, cell: int) -> Books:
    """The codebooks after one round: floored means of the parts assigned to each entry; unused entries stay."""
    parts, wide = len(books), books[0].shape[1]
    schema = "part int, entry int, n long, sums array<bigint>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memos = [Memo(b, cell) for b in books]
        n = [np.zeros(len(b), np.int64) for b in books]
        total = [np.zeros(b.shape, np.int64) for b in books]
        for b in batches:
            _, whole = integers(b.column("v"), parts, scale, length)
            for p in range(parts):
                code, _ = memos[p].nearest(whole[:, p])
                np.add.at(n[p], code, 1)
                np.add.at(total[p], code, whole[:, p])
        for p in range(parts):
            used = np.flatnonzero(n[p])
            yield pa.record_batch([pa.array(np.full(len(used), p, np.int32)), pa.array(used.astype(np.int32)), pa.array(n[p][used]),
                                   pa.array(total[p][used].tolist(), pa.list_(pa.int64()))], ["part", "entry", "n", "sums"])

    added = rows.select("v").mapInArrow(run, schema).groupBy("part", "entry").agg(F.sum("n").alias("n"), *[F.sum(F.col("sums")[j]).alias(f"s{j}") for j in range(wide)])
    out = [b.copy() for b in books]
    for r in added.collect():  # at most parts x entries rows
        out[r["part"]][r["entry"]] = [r[f"s{j}"] // r["n"] for j in range(wide)]
    return out


def _coded(rows: DataFrame, length: int, books: Books, scale: int, cell: int) -> DataFrame:
    """vec_id, label, code, error of every vector."""
    parts = len(books)
    digits = np.array([f"{i:02x}" for i in range(max(256, len(books[0])))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memos = [Memo(b, cell) for b in books]
        for b in batches:
            fit, whole = integers(b.column("v"), parts, scale, length)
            code, error = np.full(b.num_rows, None, object), np.zeros(b.num_rows, np.int64)
            text, total = np.full(len(fit), "", object), np.zeros(len(fit), np.int64)
            for p in range(parts):
                entry, distance = memos[p].nearest(whole[:, p])
                text, total = text + digits[entry].astype(object), total + distance
            code[fit], error[fit] = text, total
            lost = np.ones(b.num_rows, bool)
            lost[fit] = False
            yield pa.record_batch([b.column("vec_id"), b.column("label"), pa.array(code, pa.string()), pa.array(error, mask=lost)], ["vec_id", "label", "code", "error"])

    schema = f"vec_id {rows.schema['vec_id'].dataType.simpleString()}, label {rows.schema['label'].dataType.simpleString()}, code string, error long"
    return rows.mapInArrow(run, schema)


def digest(books: Books) -> str:
    """SHA-256 of all entries' decimal components by part, entry and position."""
    return hashlib.sha256(",".join(str(v) for b in books for v in b.ravel().tolist()).encode()).hexdigest()


def train(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE, cell: int = CELL) -> tuple[int, Books] | None:
    """(length, codebooks) for vectors ``v``; None without vectors."""
    begun = first_books(rows, parts, entries, scale)
    if begun is None:
        return None
    length, books = begun
    for _ in range(rounds):
        books = _sums(rows, length, books, scale, cell)
    return length, books


def compress(vectors: DataFrame, column: str = "embedding", label: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS,
             scale: int = SCALE, cell: int = CELL) -> DataFrame:
    """vec_id, code (two hexadecimal digits a part), error, label_error (sum of the errors under the same label), codebooks_sha256."""
    rows = vectors.select("vec_id", F.col(column).cast("array<double>").alias("v"), F.col(label).alias("label")).filter(usable(F.col("v")))
    trained = train(rows, parts, entries, rounds, scale, cell)
    if trained is None:
        return rows.limit(0).select("vec_id", F.lit("").alias("code"), *[F.lit(0).cast("long").alias(c) for c in ("error", "label_error")], F.lit("").alias("codebooks_sha256"))
    coded = pin(_coded(rows, *trained, scale, cell))
    sums = coded.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    return coded.join(sums, F.col("label").eqNullSafe(F.col("of"))).select(
        "vec_id", "code", "error", F.when(F.col("error").isNotNull(), F.col("label_error")).alias("label_error"), F.lit(digest(trained[1])).alias("codebooks_sha256"))
