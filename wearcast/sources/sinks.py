"""Sinks (S3, S4): result tables to CSV or Parquet, overwritten.

CSV timestamps are written with microseconds (Spark's default keeps
milliseconds), so a written table reads back unchanged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

TS_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    (df.write.mode(mode).option("header", True)
       .option("timestampFormat", TS_FORMAT + "XXX").option("timestampNTZFormat", TS_FORMAT)
       .csv(path))


def write_sorted_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """An ``orderBy`` result written as range-ordered part files (part order = row order)."""
    write_csv(df, path, mode)
