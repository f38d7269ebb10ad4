"""Health (degradation) index, batch form (T5 twin).

Per machine, in time order: the index starts at 0; once an alert has been
seen (the latch is sticky) every reading adds 0.05, otherwise it subtracts
0.01, and it stays within [0, 1]. Since it can only fall while it is already 0
before the latch, it equals ``min(1, 0.05 * readings since the first alert,
inclusive)`` - a closed form over the sequence number, no per-machine fold.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wearcast import schema as S
from wearcast.operators import series


def health_index(df: DataFrame, alert: str = "prediction", key: str = S.KEY, time: str = S.TIME,
                 row_id: str = S.ROW_ID, up: float = S.HEALTH_STEP_UP,
                 block_rows: int = series.BLOCK_ROWS) -> DataFrame:
    seq = series.sequence_frame(df, "seq", None, key, time, row_id, block_rows)
    seq = series.with_machine_values(seq, {"_latch": (F.min(F.when(F.col(alert) == 1, F.col("seq"))), "min")}, key)
    out = seq.withColumn(
        "degradation",
        F.when(F.col("_latch").isNull() | (F.col("seq") < F.col("_latch")), F.lit(0.0))
         .otherwise(F.least(F.lit(1.0), (F.col("seq") - F.col("_latch") + 1) * F.lit(up))))
    return out.select(*df.columns, "seq", "degradation")
