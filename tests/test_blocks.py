"""Blocks hold at most twice their rows however the readings lie, and windows over them stay exact."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from wearcast import schema as S
from wearcast.operators import series

R = 200
SECOND = 1_000_000


def frame(spark, times, keys=("M",)):
    rows = [(i, k, t, float(i * 7919 % 101)) for k in keys for i, t in enumerate(times)]
    df = spark.createDataFrame(rows, f"{S.ROW_ID} long, {S.KEY} string, us long, v double")
    return df.withColumn(S.TIME, F.timestamp_micros("us").cast("timestamp_ntz")).drop("us")


def cases():
    rng = random.Random(3)
    day = 1_700_000_000 * SECOND
    return {
        "one clock in 1970": [0] + [day + i * 1000 for i in range(5000)],
        "one clock in 2200": [day + i * 1000 for i in range(5000)] + [7_258_118_400 * SECOND],
        "all times equal": [day] * 3000,
        "no times": [None] * 3000,
        "half without a time": [None if i % 2 else day + i for i in range(4000)],
        "bursts in a long span": [day + b * 86_400 * SECOND * 30 + rng.randint(0, 50) for b in range(4) for _ in range(900)],
        "nested outliers": [day - 10**15, day - 10**12, day - 10**9, *[day + rng.randint(0, 300) for _ in range(3000)], day + 10**9, day + 10**14],
        "one time and missing ones": [day] * 1500 + [None] * 1500,
        "even": [day + i * SECOND for i in range(3000)],
    }


@pytest.mark.parametrize("name", list(cases()))
def test_bounded_and_in_order(spark, name):
    df = frame(spark, cases()[name])
    blocked = series.with_block(df, block_rows=R).cache()
    sizes = {r[series.BLOCK]: r["n"] for r in blocked.groupBy(series.BLOCK).agg(F.count(F.lit(1)).alias("n")).collect()}
    assert max(sizes.values()) <= 2 * R and sum(sizes.values()) == df.count()
    order = Window.orderBy(*series.in_order(S.TIME, S.ROW_ID))
    back = blocked.select(F.col(series.BLOCK).alias("b"), F.lag(series.BLOCK).over(order).alias("p")).where("b < p").count()
    assert back == 0  # blocks follow the order of the readings
    following = {r[series.BLOCK]: r[series.NEXT] for r in blocked.select(series.BLOCK, series.NEXT).distinct().collect()}
    names = sorted(sizes)
    assert following == dict(zip(names, [*names[1:], None]))


@pytest.mark.parametrize("name", ["one clock in 1970", "all times equal", "half without a time", "nested outliers"])
def test_windows_are_exact(spark, name):
    df = frame(spark, cases()[name][:1500], keys=("M", "N"))
    whole = Window.partitionBy(S.KEY).orderBy(*series.in_order(S.TIME, S.ROW_ID))
    want = {(r[S.KEY], r[S.ROW_ID]): (r["s"], r["n"]) for r in df.select(S.KEY, S.ROW_ID, F.sum("v").over(whole.rowsBetween(-4, 0)).alias("s"), F.row_number().over(whole).alias("n")).collect()}
    got = series.rolling(df, [("s", lambda w: F.sum("v").over(w.rowsBetween(-4, 0)))], 4, block_rows=100)
    assert {(r[S.KEY], r[S.ROW_ID]): r["s"] for r in got.collect()} == {k: s for k, (s, _) in want.items()}
    seq = series.sequence_number(df, block_rows=100)
    assert {(r[S.KEY], r[S.ROW_ID]): r["seq"] for r in seq.collect()} == {k: n for k, (_, n) in want.items()}


def test_equal_readings_and_ids_that_are_text(spark):
    df = frame(spark, [1_000_000] * 600).withColumn(S.ROW_ID, F.lit(5).cast("long"))
    assert series.with_block(df, block_rows=R).count() == 600  # nothing tells them apart
    text = frame(spark, [i * SECOND for i in range(1000)]).withColumn(S.ROW_ID, F.col(S.ROW_ID).cast("string"))
    sizes = [r["count"] for r in series.with_block(text, block_rows=R).groupBy(series.BLOCK).count().collect()]
    assert max(sizes) <= 2 * R


def test_small_machines_join_nothing(spark):
    df = frame(spark, [i * SECOND for i in range(50)], keys=("A", "B", None))
    out = series.with_block(df, block_rows=R)
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert {(r[series.BLOCK], r[series.NEXT]) for r in out.collect()} == {(0, None)}
