"""Declared threshold rules (D1, D2) and clamps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wearcast import schema as S
from wearcast.functions.columns import clamp


def range_table(spark: SparkSession, ranges: dict | None = None) -> DataFrame:
    ranges = ranges or S.NORMAL_RANGES
    return spark.createDataFrame([(k, float(lo), float(hi)) for k, (lo, hi) in ranges.items()],
                                 "sensor string, min_value double, max_value double")


def range_violations(df: DataFrame, ranges: dict | None = None, row_id: str = S.ROW_ID, key: str = S.KEY) -> DataFrame:
    """One row per (reading, sensor) whose value lies outside ``[min, max]``; NULL values are not violations.

    The readings are unpivoted in place (``stack``) and the range table, one
    row per sensor, is broadcast.
    """
    ranges = ranges or S.NORMAL_RANGES
    sensors = list(ranges)
    pairs = ", ".join(f"'{c}', CAST(`{c}` AS DOUBLE)" for c in sensors)
    long = df.selectExpr(row_id, key, f"stack({len(sensors)}, {pairs}) AS (sensor, value)")
    rt = range_table(df.sparkSession, ranges)
    return long.join(F.broadcast(rt), "sensor").where(
        (F.col("value") < F.col("min_value")) | (F.col("value") > F.col("max_value"))).select(
        row_id, key, "sensor", "value", F.when(F.col("value") < F.col("min_value"), F.lit("below")).otherwise(F.lit("above")).alias("side"))


def critical_alerts(df: DataFrame, prob: str | None = "p", row_id: str = S.ROW_ID, key: str = S.KEY) -> DataFrame:
    """Per reading, the list of critical conditions met (strict comparisons); readings with none are dropped."""
    conds = [
        F.when(F.col("vibration") > S.CRITICAL_VIBRATION, F.lit("vibration")),
        F.when(F.col("temperature") > S.CRITICAL_TEMPERATURE, F.lit("temperature")),
        F.when(F.col("pressure") < S.CRITICAL_PRESSURE_LOW, F.lit("pressure_low")),
        F.when(F.col("pressure") > S.CRITICAL_PRESSURE_HIGH, F.lit("pressure_high")),
    ]
    if prob:
        conds.append(F.when(F.col(prob) > S.FAILURE_PROBABILITY_ALERT, F.lit("failure_probability")))
    reasons = F.array_compact(F.array(*conds))
    return df.select(row_id, key, reasons.alias("reasons")).where(F.size("reasons") > 0) \
             .withColumn("n_reasons", F.size("reasons"))


def clamped(df: DataFrame) -> DataFrame:
    """The generator's clamps as column operations, NULL kept NULL."""
    return df.withColumn("vibration", clamp("vibration", lo=0.0)) \
             .withColumn("temperature", clamp("temperature", 50.0, 120.0)) \
             .withColumn("pressure", clamp("pressure", lo=0.0))
