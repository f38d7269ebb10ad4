"""Spark session helpers.

On a cluster the session is created by the platform; ``get_session`` only adds
what the library relies on (UTC session time, AQE). The checkpoint folder is
read from ``spark.checkpoint.dir``; a folder is only chosen here when the
setting is unset, as in local tests.
"""

from __future__ import annotations

import io
import os
import tempfile
import zipfile

from pyspark.sql import DataFrame, SparkSession

_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_session(master: str | None = None, app_name: str = "wearcast",
                shuffle_partitions: int | None = None, extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
        if master.startswith("local"):
            # local mode runs everything in the driver JVM; on a cluster the platform sizes it
            builder = builder.config("spark.driver.memory", os.environ.get("WEARCAST_DRIVER_MEMORY", "16g"))
    for k, v in _DEFAULTS.items():
        builder = builder.config(k, v)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in (extra or {}).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    checkpoint_dir(spark)
    ship_package(spark)
    return spark


ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def bound_batches(spark: SparkSession, most: int = 8 << 20) -> None:
    """Arrow batches of ``most`` bytes at most (a larger row comes alone) where the session leaves Spark's 64 MB: rows of
    long texts are few a batch then, on either side of a Python worker."""
    if str(spark.conf.get(ARROW_BYTES)).rstrip("b") == str(64 << 20):
        spark.conf.set(ARROW_BYTES, str(most))


def ship_package(spark: SparkSession) -> None:
    """Make ``wearcast`` importable in every Python worker (streaming state, foreachBatch).

    The package is zipped once per SparkContext and added with ``addPyFile``,
    which distributes it from the driver; nothing has to be installed on executors.
    """
    bound_batches(spark)
    sc = spark.sparkContext
    if getattr(sc, "_wearcast_shipped", False):  # kept on the context itself: a new context starts anew
        return
    pkg = os.path.dirname(os.path.abspath(__file__))
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w", zipfile.ZIP_DEFLATED) as zf:
        for root, _, files in os.walk(pkg):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(root, f)
                    zf.write(full, os.path.relpath(full, os.path.dirname(pkg)))
    fd, path = tempfile.mkstemp(prefix="wearcast-", suffix=".zip")
    with os.fdopen(fd, "wb") as out:
        out.write(buf.getvalue())
    sc.addPyFile(path)
    sc._wearcast_shipped = True


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by ``spark.checkpoint.dir``.

    Only a ``local[...]`` master, whose executors are this process, gets a
    scratch folder when the setting is unset; on a cluster that would be a
    different folder on every machine, so there it is an error.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        configured = tempfile.mkdtemp(prefix="wearcast-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def pin(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder and cut its lineage.

    Used where a later step must see exactly the same rows as an earlier one
    (for example block ids that came from sampled range bounds), so that a
    lost executor recomputes nothing that could come out differently.
    """
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def remove_folder(spark: SparkSession, path: str) -> None:
    """Delete a scratch folder below the checkpoint folder, wherever that is."""
    sc = spark.sparkContext
    target = sc._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(sc._jsc.hadoopConfiguration()).delete(target, True)


def folder_exists(spark: SparkSession, path: str) -> bool:
    """Whether there is something at ``path``, wherever that is."""
    sc = spark.sparkContext
    target = sc._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(sc._jsc.hadoopConfiguration()).exists(target)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
