"""Readings in stored order (O1): a table bucketed by (machine, block), each bucket sorted by time.

The blocks of ``series.py`` are worked out once, when the table is written, and
stay in it. Windows over ``(machine, block)`` then find their rows together:
rolling and serving features, sequences and fills read the table without an
exchange of the readings. Only the rows at the borders of blocks and a row of
counts a block are moved. A machine of any size is spread over the buckets of
its blocks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from wearcast import schema as S
from wearcast.operators import series
from wearcast.session import shuffle_partitions


def write(df: DataFrame, table: str, path: str, buckets: int | None = None, key: str = S.KEY, time: str = S.TIME, row_id: str = S.ROW_ID,
          block_rows: int = series.BLOCK_ROWS) -> None:
    """Write the readings as ``table`` with its files at ``path`` (shared storage): one exchange, one file a bucket."""
    n = buckets or shuffle_partitions(df.sparkSession)
    blocked = series.with_block(df, key, time, block_rows, row_id).repartition(n, key, series.BLOCK)
    blocked.write.mode("overwrite").bucketBy(n, key, series.BLOCK).sortBy(key, series.BLOCK, time, row_id).option("path", path).saveAsTable(table)


def read(spark: SparkSession, table: str) -> DataFrame:
    """The stored readings with their blocks; pass them to any operator over a machine's series."""
    return spark.table(table)
