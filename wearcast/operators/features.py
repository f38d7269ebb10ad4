"""Feature engineering windows.

All per-machine windows go through ``wearcast.operators.series`` so that a
machine with a huge series is still spread over many tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wearcast import schema as S
from wearcast.functions import columns as C
from wearcast.operators import series


def rolling_features(df: DataFrame, mean_cols: Sequence[str] = S.ROLLING_MEAN_INPUTS,
                     std_cols: Sequence[str] = S.ROLLING_STD_INPUTS, window: int = S.ROLLING_WINDOW,
                     key: str = S.KEY, time: str = S.TIME, row_id: str = S.ROW_ID,
                     block_rows: int = series.BLOCK_ROWS) -> DataFrame:
    """W3 + W4 + P3 + P4: training-time features.

    Rolling mean over the last ``window`` readings including the current one
    (fewer at the start), rolling sample std (NULL -> 0.0), power efficiency
    and the temperature x vibration interaction.
    """
    k = window - 1
    specs = [(f"{c}_rolling_avg", (lambda c: lambda w: F.avg(c).over(w.rowsBetween(-k, 0)))(c)) for c in mean_cols]
    specs += [(f"{c}_rolling_std",
               (lambda c: lambda w: F.coalesce(F.stddev_samp(c).over(w.rowsBetween(-k, 0)), F.lit(0.0)))(c))
              for c in std_cols]
    out = series.rolling(df, specs, k, key, time, row_id, block_rows)
    return out.withColumn("power_efficiency", C.power_efficiency()) \
              .withColumn("temp_vib_interaction", C.temp_vib_interaction())


def serving_features(df: DataFrame, mean_cols: Sequence[str] = S.ROLLING_MEAN_INPUTS,
                     std_cols: Sequence[str] = S.ROLLING_STD_INPUTS, window: int = S.ROLLING_WINDOW,
                     key: str = S.KEY, time: str = S.TIME, row_id: str = S.ROW_ID,
                     block_rows: int = series.BLOCK_ROWS) -> DataFrame:
    """Live-scoring features from the *previous* ``window`` readings only.

    Until ``window`` earlier readings exist the mean is the current value and
    the std is 0.0; the std is the population std. Same column names as
    ``rolling_features`` plus the two derived features.
    """
    def mean_spec(c):
        def b(w):
            prev = w.rowsBetween(-window, -1)
            return F.when(F.count(c).over(prev) >= window, F.avg(c).over(prev)).otherwise(F.col(c))
        return b

    def std_spec(c):
        def b(w):
            prev = w.rowsBetween(-window, -1)
            return F.when(F.count(c).over(prev) >= window, F.stddev_pop(c).over(prev)).otherwise(F.lit(0.0))
        return b

    specs = [(f"{c}_rolling_avg", mean_spec(c)) for c in mean_cols]
    specs += [(f"{c}_rolling_std", std_spec(c)) for c in std_cols]
    out = series.rolling(df, specs, window, key, time, row_id, block_rows)
    return out.withColumn("power_efficiency", C.power_efficiency()) \
              .withColumn("temp_vib_interaction", C.temp_vib_interaction())


def sequence(df: DataFrame, key: str = S.KEY, time: str = S.TIME, row_id: str = S.ROW_ID,
             history: int = S.LIVE_HISTORY, block_rows: int = series.BLOCK_ROWS) -> DataFrame:
    """Reading counter per machine (1-based) and live ``runtime_hours`` = history length before the reading."""
    out = series.sequence_number(df, "seq", None, key, time, row_id, block_rows)
    return out.withColumn("history_len", F.least(F.col("seq") - 1, F.lit(history)).cast("long"))


def run_progress(df: DataFrame, key: str = S.KEY, time: str = S.TIME, row_id: str = S.ROW_ID,
                 block_rows: int = series.BLOCK_ROWS) -> DataFrame:
    """``(position - 1) / readings of the machine``."""
    out = series.sequence_number(df, "seq", "_n", key, time, row_id, block_rows)
    return out.withColumn("progress", (F.col("seq") - 1) / F.col("_n")).drop("_n")


def imminent_label(df: DataFrame, label: str = S.LABEL, horizon: float = 0.95, key: str = S.KEY,
                   time: str = S.TIME, row_id: str = S.ROW_ID,
                   block_rows: int = series.BLOCK_ROWS) -> DataFrame:
    """1 when the machine fails at some point and the reading lies in its last (1 - horizon) share."""
    seq = series.sequence_frame(df, "seq", "_n", key, time, row_id, block_rows)
    seq = series.with_machine_values(seq, {"_fails": (F.max(label), "max")}, key)
    prog = seq.withColumn("progress", (F.col("seq") - 1) / F.col("_n"))
    return prog.withColumn("imminent", F.when((F.col("_fails") == 1) & (F.col("progress") > horizon), 1).otherwise(0)) \
               .select(*df.columns, "seq", "progress", "imminent")


def last_readings(df: DataFrame, n: int = S.LIVE_HISTORY, key: str = S.KEY, time: str = S.TIME,
                  row_id: str = S.ROW_ID, block_rows: int = series.BLOCK_ROWS) -> DataFrame:
    """The latest ``n`` readings of each machine (``recency`` 1 = newest)."""
    return series.last_n(df, n, "recency", key, time, row_id, block_rows)

