"""Packs: rows gathered into compressed blocks, and the exchange of hashed keys between packs.

A pack is one row: its name, the bytes of text in it and an Arrow stream of
its rows (zstd). Operators that look at every word of a corpus keep the texts
in packs and send only sorted 64-bit keys through the shuffle, each key at most
once a pack, so that a key held by a third of all rows arrives once a pack and
not once a row. Keys are dealt by their value to buckets of bounded size, and
answers travel back in the order of the keys, as bits or bytes.
"""

from __future__ import annotations

import gc
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wearcast.llm.words import slices
from wearcast.session import pin

PACK_BYTES = 8 << 20
BUCKET_BYTES = 8 << 20  # of text, in a bucket of keys

PACK = "pack string, n_bytes long, rows binary"


def write_rows(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 5))) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def read_rows(data: bytes) -> pa.Table:
    with pa.ipc.open_stream(data) as stream:
        return stream.read_all().combine_chunks()


def release(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of steps whose results are checkpointed: it does so once the driver forgets them."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def pack(rows: DataFrame, column: str = "text", limit: int = PACK_BYTES) -> DataFrame:
    """One row a pack of about ``limit`` bytes of ``column``; a row is never cut. Written to the checkpoint folder,
    so that all later steps see the same packs even if an executor is lost."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, held, size, n = TaskContext.get().partitionId(), [], 0, 0

        def flush():
            nonlocal held, size, n
            out = pa.record_batch([[f"{task}-{n}"], pa.array([size], pa.int64()), pa.array([write_rows(pa.Table.from_batches(held))], pa.binary())],
                                  ["pack", "n_bytes", "rows"])
            held, size, n = [], 0, n + 1
            return out

        for b in batches:
            for part in slices(b, column, limit // 4):
                held.append(part)
                size += pa.compute.sum(pa.compute.binary_length(part.column(column))).as_py() or 0
                if size >= limit:
                    yield flush()
        if held:
            yield flush()

    return pin(rows.mapInArrow(run, PACK))


def split_text(docs: DataFrame) -> DataFrame:
    """row (all columns but the text), doc_id and text, so that a pack holds each text once."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c != "text"]
    return docs.select(F.struct(*rest).alias("row"), "doc_id", F.col("text").cast("string").alias("text"))


def join_text(rows: DataFrame, docs: DataFrame, **new) -> DataFrame:
    """The columns of ``docs`` again from (row, text); ``new`` replaces columns by name."""
    own = {"text": F.col("text")} | new
    return rows.select(*[own.get(c, F.col(f"row.`{c}`")).cast(docs.schema[c].dataType).alias(c) for c in docs.columns])


def bucket_count(packs: DataFrame, size: int = BUCKET_BYTES) -> int:
    return max(1, math.ceil((packs.agg(F.sum("n_bytes")).first()[0] or 0) / size))


def bucket_cuts(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Bounds of the buckets in sorted keys: bucket b has keys[cuts[b]:cuts[b + 1]]."""
    edges = np.array([(b << 64) // buckets for b in range(1, buckets)], np.uint64)
    return np.concatenate([[0], np.searchsorted(keys, edges), [len(keys)]])


def write_keys(keys: np.ndarray) -> bytes:
    """Sorted keys as differences of six bytes where they fit."""
    if not len(keys):
        return b""
    step = np.diff(keys)
    wide = 6 if not len(step) or int(step.max()) < 1 << 48 else 8
    return bytes([wide]) + keys[:1].tobytes() + np.ascontiguousarray(step.view(np.uint8).reshape(-1, 8)[:, :wide]).tobytes()


def read_keys(data: bytes) -> np.ndarray:
    if not data:
        return np.zeros(0, np.uint64)
    wide = data[0]
    part = np.frombuffer(data, np.uint8, offset=9).reshape(-1, wide)
    step = np.zeros((len(part) + 1, 8), np.uint8)
    step[1:, :wide] = part
    step = step.view(np.uint64).ravel()
    step[0] = np.frombuffer(data, np.uint64, 1, 1)[0]
    return np.cumsum(step, dtype=np.uint64)


def per_pack(packs: DataFrame, f: Callable[[pa.Table], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``f(name, rows)`` for each pack, where it lies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, data in zip(b.column("pack"), b.column("rows")):
                yield from f(name.as_py(), read_rows(data.as_py()))

    return packs.select("pack", "rows").mapInArrow(run, schema)


def with_answers(packs: DataFrame, answers: DataFrame, f: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """``f(rows of the pack, its answers)`` for each pack; a pack without answers gets an empty table."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        parts = [f(read_rows(data.as_py()), right) for data in left.column("rows")]
        return pa.concat_tables(parts)

    return packs.select("pack", "rows").groupBy("pack").cogroup(answers.groupBy("pack")).applyInArrow(run, schema)
