"""Event-time order: what leaves equals the batch features of the readings that were not late, whatever order they came in."""

import pytest
from pyspark.sql import functions as F

from tests.conftest import SF_SMALL
from wearcast import schema as S
from wearcast.operators import features as FE
from wearcast.operators import health as H
from wearcast.plans import extra as X
from wearcast.sources.tables import fixture_telemetry
from wearcast.streaming import live


@pytest.fixture(scope="module")
def readings(spark):
    return fixture_telemetry(spark, SF_SMALL).select(*X.STREAM_COLS).where("machine_id in ('MACHINE_001', 'MACHINE_002', 'MACHINE_003')").cache()


def features(df):
    cols = S.ROLLING_FEATURES + S.STAT_FEATURES
    return {r[S.ROW_ID]: tuple(None if r[c] is None else round(r[c], 9) for c in cols) for r in df.select(S.ROW_ID, *cols).collect()}


def test_late_readings_go_aside_and_move_no_state(spark, readings):
    us = F.unix_micros(F.col(S.TIME).cast("timestamp"))
    lo, hi = readings.agg(F.min(us), F.max(us)).first()
    held = F.col(S.ROW_ID) % 5 == 0
    untimed = readings.limit(1).withColumn(S.ROW_ID, F.lit(10**9).cast("long")).withColumn(S.TIME, F.lit(None).cast(readings.schema[S.TIME].dataType))
    cut = lo + (hi - lo) // 2
    parts = [readings.where(~held & (us < cut)), readings.where(held | (us >= cut)).unionByName(untimed)]
    out = X.run_ordered(spark, parts, "late-test").cache()
    late = {r[S.ROW_ID] for r in live.late_readings(out, [S.ROW_ID]).collect()}
    mark = readings.where(~held & (us < cut)).agg(F.max(us)).first()[0] - X.DELAY_HOURS * 3_600_000_000
    want = {r[S.ROW_ID] for r in readings.where(held & (us <= mark)).select(S.ROW_ID).collect()} | {10**9}
    assert late == want and len(late) > 5
    kept = readings.where(~F.col(S.ROW_ID).isin([i for i in late]))
    assert features(live.on_time(out)) == features(FE.serving_features(kept))
    degradation = {r[S.ROW_ID]: (r["seq"], round(r["degradation"], 9)) for r in live.on_time(out).collect()}
    health = H.health_index(kept)
    assert degradation == {r[S.ROW_ID]: (r["seq"], round(r["degradation"], 9)) for r in health.collect()}


def test_shuffled_rows_in_many_batches(spark, readings):
    arrival = F.unix_micros(F.col(S.TIME).cast("timestamp")) + F.pmod(F.xxhash64(S.ROW_ID, F.lit(3)), F.lit(X.DELAY_HOURS * 3_600_000_000))
    at = readings.agg(F.min(arrival), F.max(arrival)).first()
    cuts = [at[0] + (at[1] + 1 - at[0]) * i // 5 for i in range(6)]
    parts = [readings.where((arrival >= a) & (arrival < z)) for a, z in zip(cuts, cuts[1:])]
    out = X.run_ordered(spark, parts, "shuffled-test").cache()
    assert out.where("late").count() == 0
    assert features(out) == features(FE.serving_features(readings))


def test_history_from_state_writes_only_what_it_touches(spark, readings):
    fields = [S.ROW_ID, S.KEY, S.TIME, "vibration"]
    src, ckpt, sink = (X.scratch(spark, n) for n in ("hist-in", "hist-ckpt", "hist-out"))
    for i in range(2):
        readings.where(F.col(S.ROW_ID) % 2 == i).write.mode("append").parquet(src)

        def keep(df, batch, _sink=sink):
            df.write.mode("append").parquet(_sink)

        stream = live.kept_history_stream(live.reading_stream(spark, src, readings.schema), fields, 7)
        stream.writeStream.foreachBatch(keep).option("checkpointLocation", ckpt).outputMode("update").trigger(availableNow=True).start().awaitTermination()
    assert spark.read.parquet(sink).count() == 2 * 3  # a row a machine and batch, not its history
    got = {(r[S.ROW_ID], r["recency"]) for r in live.kept_history(spark, ckpt).collect()}
    assert got == {(r[S.ROW_ID], r["recency"]) for r in FE.last_readings(readings, 7).collect()}
