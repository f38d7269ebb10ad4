"""The log of live runs, committed batch by batch through a ledger.

Each micro-batch is written to a folder of its own, and counts only once the
ledger has its entry (stream, run, batch, rows), which is written last and as a
whole. A batch that is tried again, after a failure halfway or between the entry
and the checkpoint, overwrites what was not entered and adds nothing to what
was. A run without rows leaves neither file nor entry. The stream is the
checkpoint's query id, so a batch that one run began and another one replays
is the same batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from wearcast.session import folder_exists, remove_folder
from wearcast.sources.sinks import write_sorted_csv

ENTRY = "stream string, run string, batch long, rows long"


def _data(path: str, stream: str, batch: int) -> str:
    return f"{path}/data/stream={stream}/batch={batch}"


def _entry(path: str, stream: str, batch: int) -> str:
    return f"{path}/ledger/{stream}-{batch}"


def write_batch(rows: DataFrame, path: str, stream: str, run: str, batch: int) -> int | None:
    """The batch's rows and their number; None if the ledger has the batch already, 0 (and no folder) if it has no rows."""
    spark = rows.sparkSession
    if folder_exists(spark, _entry(path, stream, batch)):
        return None
    seen = Observation()
    rows.withColumn("run", F.lit(run)).observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(_data(path, stream, batch))
    n = seen.get["n"]
    if not n:
        remove_folder(spark, _data(path, stream, batch))
    return n


def enter(spark: SparkSession, path: str, stream: str, run: str, batch: int, rows: int) -> None:
    """The ledger's entry: from here on the batch counts."""
    spark.createDataFrame([(stream, run, batch, rows)], ENTRY).coalesce(1).write.mode("overwrite").parquet(_entry(path, stream, batch))


def write_run(df: DataFrame, path: str, checkpoint: str, run: str, trigger: dict | None = None) -> StreamingQuery:
    """Start a run that logs the stream's rows below ``path`` under the name ``run``."""
    def commit(rows: DataFrame, batch: int) -> None:
        spark = rows.sparkSession
        stream = spark.sparkContext.getLocalProperty("sql.streaming.queryId")
        n = write_batch(rows, path, stream, run, batch)
        if n:
            enter(spark, path, stream, run, batch, n)

    return df.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint).outputMode("append").trigger(**(trigger or {"availableNow": True})).start()


def ledger(spark: SparkSession, path: str) -> DataFrame:
    """stream, run, batch, rows of every batch that counts; empty before the first one."""
    if not folder_exists(spark, f"{path}/ledger"):
        return spark.createDataFrame([], ENTRY)
    return spark.read.schema(ENTRY).option("recursiveFileLookup", True).parquet(f"{path}/ledger")


def read_log(spark: SparkSession, path: str, run: str | None = None) -> DataFrame:
    """The logged rows of all runs or one, with ``stream``, ``run`` and ``batch``; rows without a ledger entry do not show."""
    entered = ledger(spark, path).select("stream", "batch", *([] if run is None else ["run"]))
    if run is not None:
        entered = entered.where(F.col("run") == run).drop("run")
    rows = spark.read.parquet(f"{path}/data").withColumns({"stream": F.col("stream").cast("string"), "batch": F.col("batch").cast("long")})
    return rows.join(entered, ["stream", "batch"], "left_semi")


def export_run(spark: SparkSession, path: str, run: str, target: str, order: list[str]) -> bool:
    """One run's log as CSV at ``target``, in order; False, and no file, for a run without rows."""
    if not ledger(spark, path).where(F.col("run") == run).limit(1).count():
        return False
    write_sorted_csv(read_log(spark, path, run).drop("stream", "batch").orderBy(*order), target)
    return True
