"""Scans: telemetry files (S1, S2) and the fixture view over the driver tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from wearcast import schema as S


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _number(c: str) -> Column:
    """A sensor cell: empty and ``NaN`` are NULL, anything else must be a number."""
    text = F.trim(F.col(c))
    empty = text.isNull() | (text == "") | (F.lower(text) == "nan")
    value = text.try_cast("double")
    bad = F.raise_error(F.concat(F.lit(f"column {c}: not a number: "), text)).cast("double")
    return F.when(empty, F.lit(None).cast("double")).when(value.isNull(), bad).otherwise(value).alias(c)


def read_telemetry_csv(spark: SparkSession, path: str, row_id: str = S.ROW_ID) -> DataFrame:
    """S1 + S2: header CSV with the telemetry schema; no inference pass over the data.

    Every file's header must name the columns in the order of the first one's: a file that differs fails instead of
    being read by position. Every cell is read as text; the timestamp is parsed with ``to_timestamp_ntz``. A
    ``reading_id`` column is kept when the file has one. Else it is a hash of machine, time and the reading's number
    among those of the same machine and time, ordered by their cells: the same rows get the same ids however the files
    are split or named.
    """
    header = spark.read.option("header", True).csv(path).columns  # reads the first line only
    missing = [c for c in [S.TIME, S.KEY, *S.SENSORS, S.LABEL] if c not in header]
    if missing:
        raise ValueError(f"{path} lacks {', '.join(missing)}")
    text_schema = T.StructType([T.StructField(c, T.StringType()) for c in header])
    raw = spark.read.schema(text_schema).option("header", True).option("enforceSchema", False).option("mode", "FAILFAST").csv(path)
    own = [F.col(row_id).cast("long").alias(row_id)] if row_id in header else []
    out = raw.select(*own, F.to_timestamp_ntz(F.col(S.TIME)).alias(S.TIME), F.col(S.KEY), *[_number(c) for c in S.SENSORS],
                     F.col(S.LABEL).cast("int").alias(S.LABEL))
    if own:
        return out
    twin = F.row_number().over(Window.partitionBy(S.KEY, S.TIME).orderBy(*S.SENSORS, S.LABEL))
    return out.withColumn(row_id, F.xxhash64(F.col(S.KEY), F.col(S.TIME).cast("string"), twin)).select(row_id, *out.columns)


def _k(props: Column) -> Column:
    return F.get_json_object(props, "$.k").cast("int")


def _null_when(cond: Column, value: Column) -> Column:
    return F.when(cond, F.lit(None).cast("double")).otherwise(value.cast("double"))


def telemetry_from_events(events: DataFrame) -> DataFrame:
    """The fixture view: driver ``events`` mapped onto the telemetry schema.

    Deterministic per row (no shuffle, no window); every sensor gets a 2 %
    null pattern from ``event_id``, torque is all-null for every 75th user.
    """
    eid, uid, val, ts = F.col("event_id"), F.col("user_id"), F.col("value"), F.col("ts")
    k = _k(F.col("props"))
    m50 = eid % 50
    p = F.when(eid % 97 == 0, F.lit(0.0)).otherwise(F.least(F.lit(1.0), val / F.lit(200.0)))
    return events.select(
        eid.alias(S.ROW_ID),
        F.format_string("MACHINE_%03d", uid).alias(S.KEY),
        ts.alias(S.TIME),
        _null_when(m50 == 0, val / 50.0).alias("vibration"),
        _null_when(m50 == 1, F.lit(60.0) + k * F.lit(0.5)).alias("temperature"),
        _null_when(m50 == 2, F.lit(4.0) + (eid % 37) * F.lit(0.0625)).alias("pressure"),
        _null_when(m50 == 3, (F.unix_micros(ts.cast("timestamp")) % 3600000000) / F.lit(1000000.0)).alias("runtime_hours"),
        _null_when(m50 == 4, F.lit(210.0) + (eid * 7 % 41) * F.lit(0.5)).alias("voltage"),
        _null_when(m50 == 5, F.lit(10.0) + val / F.lit(25.0)).alias("current"),
        _null_when(m50 == 6, F.lit(55.0) + k * F.lit(0.25)).alias("acoustic_emission"),
        _null_when(m50 == 7, F.lit(1400.0) + (eid * 13 % 201)).alias("rotation_speed"),
        _null_when((m50 == 8) | (uid % 75 == 74), F.lit(130.0) + (uid * eid % 36)).alias("torque"),
        _null_when(m50 == 9, F.lit(18.0) + val / F.lit(40.0)).alias("power_consumption"),
        F.when(F.col("event_type") == "error", 1).otherwise(0).cast("int").alias(S.LABEL),
        p.cast("double").alias("p"),
        F.when(p > 0.5, 1).otherwise(0).cast("int").alias("prediction"),
    )


def fixture_telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telemetry_from_events(read_table(spark, sf_dir, "events"))


# DuckDB form of the same view, used by the oracle SQL.
FIXTURE_SQL = """
telemetry AS (
  SELECT event_id AS reading_id,
         printf('MACHINE_%03d', user_id) AS machine_id,
         ts AS "timestamp",
         CAST(CASE WHEN event_id % 50 = 0 THEN NULL ELSE value / 50.0 END AS DOUBLE) AS vibration,
         CAST(CASE WHEN event_id % 50 = 1 THEN NULL ELSE 60.0 + CAST(json_extract_string(props, '$.k') AS INT) * 0.5 END AS DOUBLE) AS temperature,
         CAST(CASE WHEN event_id % 50 = 2 THEN NULL ELSE 4.0 + (event_id % 37) * 0.0625 END AS DOUBLE) AS pressure,
         CAST(CASE WHEN event_id % 50 = 3 THEN NULL ELSE epoch_us(ts) % 3600000000 / 1000000.0 END AS DOUBLE) AS runtime_hours,
         CAST(CASE WHEN event_id % 50 = 4 THEN NULL ELSE 210.0 + (event_id * 7 % 41) * 0.5 END AS DOUBLE) AS voltage,
         CAST(CASE WHEN event_id % 50 = 5 THEN NULL ELSE 10.0 + value / 25.0 END AS DOUBLE) AS "current",
         CAST(CASE WHEN event_id % 50 = 6 THEN NULL ELSE 55.0 + CAST(json_extract_string(props, '$.k') AS INT) * 0.25 END AS DOUBLE) AS acoustic_emission,
         CAST(CASE WHEN event_id % 50 = 7 THEN NULL ELSE 1400.0 + (event_id * 13 % 201) END AS DOUBLE) AS rotation_speed,
         CAST(CASE WHEN event_id % 50 = 8 OR user_id % 75 = 74 THEN NULL ELSE 130.0 + (user_id * event_id % 36) END AS DOUBLE) AS torque,
         CAST(CASE WHEN event_id % 50 = 9 THEN NULL ELSE 18.0 + value / 40.0 END AS DOUBLE) AS power_consumption,
         CAST(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS INTEGER) AS failure,
         CAST(CASE WHEN event_id % 97 = 0 THEN 0.0 ELSE LEAST(1.0, value / 200.0) END AS DOUBLE) AS p,
         CAST(CASE WHEN (CASE WHEN event_id % 97 = 0 THEN 0.0 ELSE LEAST(1.0, value / 200.0) END) > 0.5 THEN 1 ELSE 0 END AS INTEGER) AS prediction
  FROM events
)"""
