"""Filter interaction audit by contractions of contingency tensors.

Five filters (A to E) judge every document; each part of the corpus (a
language) gets a tensor of 2x2x2x2x2 counts, one axis a filter, index 0 pass
and 1 fail. Whatever a step of an order of the filters does is a contraction of
that tensor: along each axis a vector selects pass, fail or all. One ``einsum``
over a table of such selections answers all steps of all 120 orders.

Scale: documents become narrow rows (id, part, digest of the text, bits of A to
D) in the scan. Copies are found by counting rows of one digest, part and label
first, so that a text held by a third of all documents is a few rows a task
before it is shuffled, and the smallest id of a digest is taken over those
counts; no group of copies is gathered. A part is 32 counts when its tensor is
built, whatever its size; parts are contracted in parallel.

Defined cases: null text is the empty text, which fails A alone (and E as a
copy of an empty text with a smaller id); a null part is the part ""; a document
without an id is no copy of anything and has no labels; rows that repeat an id
count one by one and are no copies of each other; labels that repeat an id mark
it if any of them does, null labels mark nothing; empty tables give empty
results; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The filters, in the order of the tensor's axes; the last one looks for copies.
FILTERS = "ABCDE"
MIN_WORDS = 200
DISTINCT_PERCENT = 50
CAPITALS_PERCENT = 3
MARKS = "[#$%&*|]"
SALT = 1024

COUNTS = "part string, cells array<struct<cell:int,n:bigint,good:bigint,toxic:bigint>>"
STEPS = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"
_FIELDS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def failures(text: Column) -> Column:
    """Bits of the filters A, B, C, D that a text (not null) fails, A the lowest."""
    def bit(k, fails):
        return F.when(fails, 1 << k).otherwise(0)

    def of_words(words):
        n = F.size(words).cast("long")
        return bit(0, n < MIN_WORDS) + bit(1, F.size(F.array_distinct(words)).cast("long") * 100 < n * DISTINCT_PERCENT)

    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+", -1), "")
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", "")).cast("long")
    return F.element_at(F.transform(F.array(words), of_words), 1) \
        + bit(2, capitals * 100 > F.length(text).cast("long") * CAPITALS_PERCENT) + bit(3, text.rlike(MARKS))  # the words are cut once


def contingency(docs: DataFrame, labels: DataFrame, part: str = "lang") -> DataFrame:
    """part, cells: for each combination of failures (bit k: filter k) the documents, those of quality 1, those toxic."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    own = docs.select("doc_id", F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), text.alias("text"))
    rows = own.select("doc_id", "part", F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("digest"), failures(F.col("text")).alias("cell")) \
        .groupBy("doc_id", "part", "digest", "cell").agg(F.count(F.lit(1)).alias("n")) \
        .withColumn("salt", F.when(F.col("doc_id").isNull(), F.pmod(F.xxhash64("digest"), F.lit(SALT))).otherwise(0).cast("int"))

    def marked(column):
        return F.coalesce(F.max(F.when(F.col(column) == 1, 1).otherwise(0)), F.lit(0))

    marks = labels.filter("doc_id is not null").groupBy("doc_id").agg(marked("quality").alias("good"), marked("toxic").alias("toxic")).withColumn("salt", F.lit(0))
    known = rows.join(marks, ["doc_id", "salt"], "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("good", "toxic")})

    # Copies: ids above the smallest of their digest. Documents without an id stay out of the comparison.
    smallest = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n")))
    alike = known.groupBy("digest", "part", "cell", "good", "toxic").agg(
        F.sum("n").alias("n"), F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("unnamed"), smallest.alias("first"))
    least = F.min("first.doc_id").over(Window.partitionBy("digest"))
    passes = F.col("unnamed") + F.coalesce(F.when(F.col("first.doc_id") == least, F.col("first.n")), F.lit(0))
    split = alike.withColumn("passes", passes).select("part", "good", "toxic", F.explode(F.array(
        F.struct(F.col("cell"), F.col("passes").alias("n")),
        F.struct((F.col("cell") + (1 << len(FILTERS) - 1)).alias("cell"), (F.col("n") - F.col("passes")).alias("n")))).alias("x"))
    cells = split.filter("x.n > 0").groupBy("part", F.col("x.cell").alias("cell")).agg(
        F.sum("x.n").alias("n"), F.sum(F.col("x.n") * F.col("good")).alias("good"), F.sum(F.col("x.n") * F.col("toxic")).alias("toxic"))
    return cells.groupBy("part").agg(F.collect_list(F.struct("cell", "n", "good", "toxic")).alias("cells"))  # 32 cells at most


def selections(count: int) -> tuple[list[tuple[str, int, int]], dict[str, np.ndarray]]:
    """(order, step, axis) of every step of every order, and by meaning a table (step, axis, 2) of what it selects."""
    every, passing, failing = (1, 1), (1, 0), (0, 1)
    steps, tables = [], {name: [] for name in ("kept", "removed", "failing", "alone")}
    for order in permutations(range(count)):
        for s, axis in enumerate(order):
            steps.append(("".join(FILTERS[k] for k in order), s + 1, axis))
            before = set(order[:s])
            tables["kept"].append([passing if k in before or k == axis else every for k in range(count)])
            tables["removed"].append([failing if k == axis else passing if k in before else every for k in range(count)])
            tables["failing"].append([failing if k == axis else every for k in range(count)])
            tables["alone"].append([failing if k == axis else passing for k in range(count)])
    return steps, {name: np.array(rows, np.int64) for name, rows in tables.items()}


def contract(tensor: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """For tensors (measure, 2, 2, ...) the sums (measure, step) that the selections choose."""
    count = chosen.shape[1]
    operands = [tensor, [0, *range(2, count + 2)]]
    for k in range(count):
        operands += [chosen[:, k], [1, k + 2]]
    return np.einsum(*operands, [0, 1], optimize="greedy")


def audit(counts: DataFrame) -> DataFrame:
    """What every step of every order of the filters does in each part: see ``STEPS``."""
    count = len(FILTERS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steps, chosen = selections(count)
        axes = np.array([axis for _, _, axis in steps])
        for b in batches:
            for part, cells in zip(b.column("part").to_pylist(), b.column("cells").to_pylist()):
                flat = np.zeros((3, 1 << count), np.int64)
                for c in cells:
                    flat[:, c["cell"]] = c["n"], c["good"], c["toxic"]
                # cell numbers have filter 0 as their lowest bit, the first axis of a reshaped array is the highest
                tensor = flat.reshape(3, *[2] * count).transpose(0, *range(count, 0, -1))
                removed, good, toxic = contract(tensor, chosen["removed"])
                kept, failing, alone = (contract(tensor[:1], chosen[name])[0] for name in ("kept", "failing", "alone"))
                value = np.zeros(count, np.int64)
                np.add.at(value, axes, removed)
                columns = [kept, removed, failing - removed, alone, good, toxic, value[axes]]
                yield pa.record_batch([pa.array([part] * len(steps)), pa.array([o for o, _, _ in steps]), pa.array([s for _, s, _ in steps], pa.int32()),
                                       *(pa.array(c, pa.int64()) for c in columns)], ["part", "filter_order", "step", *_FIELDS])

    return counts.mapInArrow(run, STEPS)
