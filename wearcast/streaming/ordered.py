"""Keyed state in event-time order (T2, T5), and history that is read from the state.

``OrderedServingProcessor`` lets readings wait until the watermark has passed
them. They wait in a map state, one entry a shard of machines and ``bucket`` of
time; one event-time timer a shard stands at its first waiting reading. When it
fires, all readings up to the watermark are released, each machine's in the order
of (time, row id), and move the same state as in arrival order. Whatever way readings are shuffled
over micro-batches, those that come before the watermark leave as the batch
features have them. A reading that comes after it is late: it is handed on
without features, marked ``late``, for a side table, and moves no state.

What waits is bounded by the readings within the watermark's delay.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessorHandle

from wearcast import schema as S
from wearcast.streaming.state import HistoryStateProcessor, ServingStateProcessor, serving_output_schema, table_of, to_bytes

cloudpickle.register_pickle_by_value(sys.modules[__name__])

BUCKET_MS = 3_600_000
AT = "event_us"  # event time in microseconds, a plain number: the operator drops no late row of its own accord


def ordered_output_schema(passthrough: T.StructType) -> T.StructType:
    return T.StructType([*serving_output_schema(passthrough).fields, T.StructField("late", T.BooleanType())])


class OrderedServingProcessor(ServingStateProcessor):
    """T2 + T5 in event-time order."""

    def __init__(self, passthrough: Sequence[str], bucket_ms: int = BUCKET_MS, **settings):
        super().__init__(passthrough, **settings)
        self.bucket_us = bucket_ms * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.handle = handle
        self.waiting = handle.getMapState("waiting", T.StructType([T.StructField("bucket", T.LongType())]), T.StructType([T.StructField("rows", T.BinaryType())]))
        self.first = handle.getValueState("first", T.StructType([T.StructField("at_ms", T.LongType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frames = [f for f in rows if len(f)]
        if not frames:
            return
        pdf = pd.concat(frames, ignore_index=True)
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        late = pdf[pdf[AT] <= passed]
        new = pdf[pdf[AT] > passed]
        if len(new):
            self._wait(new)
            self._wake(int(new[AT].min()) // 1000)
        if len(late):
            out = late[self.passthrough].reset_index(drop=True)
            out["late"] = True
            yield self._shaped(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        ready, left = [], None
        self.first.clear()
        for bucket in sorted(int(k[0]) for k in self.waiting.keys()):
            if bucket * self.bucket_us > passed:
                left = min(bucket * self.bucket_us if left is None else left, bucket * self.bucket_us)
                break
            part = table_of(self.waiting.getValue((bucket,))[0])
            stays = pc.greater(part[AT], passed)
            keep = part.filter(stays)
            ready.append(part.filter(pc.invert(stays)))
            if len(keep):
                self.waiting.updateValue((bucket,), (to_bytes(keep),))
                left = pc.min(keep[AT]).as_py()
                break  # later buckets wait longer
            self.waiting.removeKey((bucket,))
        if left is not None:
            self._wake(left // 1000)
        ready = [p for p in ready if len(p)]
        if ready:
            out = self.advance(pa.concat_tables(ready, promote_options="permissive").to_pandas())
            out["late"] = False
            yield self._shaped(out)

    def _wait(self, new: pd.DataFrame) -> None:
        """Readings go to their buckets, behind those that wait there."""
        bucket = new[AT].to_numpy() // self.bucket_us
        order = np.argsort(bucket, kind="stable")
        rows, (own, first) = pa.Table.from_pandas(new.iloc[order], preserve_index=False), np.unique(bucket[order], return_index=True)
        there = {int(k[0]) for k in self.waiting.keys()}
        for name, a, z in zip(own.tolist(), first.tolist(), [*first[1:].tolist(), len(rows)]):
            part = rows.slice(a, z - a)
            if name in there:
                part = pa.concat_tables([table_of(self.waiting.getValue((name,))[0]), part], promote_options="permissive")
            self.waiting.updateValue((name,), (to_bytes(part),))

    def _wake(self, at_ms: int) -> None:
        """One timer a shard, at its first waiting reading."""
        known = self.first.get()
        if known is None or at_ms < known[0]:
            if known is not None:
                self.handle.deleteTimer(known[0])
            self.handle.registerTimer(at_ms)
            self.first.update((at_ms,))

    def _shaped(self, out: pd.DataFrame) -> pd.DataFrame:
        names = [*self.passthrough, *(f"{c}_rolling_avg" for c in self.mean_cols), *(f"{c}_rolling_std" for c in self.std_cols),
                 "power_efficiency", "temp_vib_interaction", "seq", "degradation", "late"]
        return out.reindex(columns=names).astype({"seq": "Int64"})


class QuietHistoryProcessor(HistoryStateProcessor):
    """The last ``n`` readings of each machine as state alone; a batch hands on one row a machine it touched."""

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = 0
        for out in super().handleInputRows(key, rows, timerValues):
            held = len(out)
        yield pd.DataFrame({S.KEY: [key[0]], "held": np.array([held], "int64")})
