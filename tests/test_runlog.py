"""A batch that fails halfway, one that fails after its entry, empty runs, exports."""

import os

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from wearcast.streaming import live, runlog


def numbers(spark, folder, lo, hi):
    spark.range(lo, hi).selectExpr("id", "id % 3 AS part").coalesce(1).write.mode("append").parquet(folder)


@pytest.fixture
def place(spark, tmp_path):
    src = str(tmp_path / "in")
    numbers(spark, src, 0, 0)

    def run(name):
        stream = live.reading_stream(spark, src, spark.range(1).selectExpr("id", "id % 3 AS part").schema)
        query = runlog.write_run(stream, str(tmp_path / "log"), str(tmp_path / "ckpt"), name)
        try:
            query.awaitTermination()
        except StreamingQueryException:
            return False
        return True

    return src, str(tmp_path / "log"), run


def logged(spark, path):
    return sorted((r["id"], r["run"]) for r in runlog.read_log(spark, path).collect())


def test_a_batch_that_fails_halfway(spark, place, monkeypatch):
    src, path, run = place
    numbers(spark, src, 0, 5)
    assert run("a")
    numbers(spark, src, 5, 9)
    enter = runlog.enter
    monkeypatch.setattr(runlog, "enter", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
    assert not run("b")  # its rows are written, its entry is not
    assert logged(spark, path) == [(i, "a") for i in range(5)]
    monkeypatch.setattr(runlog, "enter", enter)
    assert run("c")  # the batch is replayed by another run
    assert logged(spark, path) == [(i, "a") for i in range(5)] + [(i, "c") for i in range(5, 9)]
    assert sorted((r["run"], r["rows"]) for r in runlog.ledger(spark, path).collect()) == [("a", 5), ("c", 4)]


def test_a_batch_that_fails_after_its_entry(spark, place, monkeypatch):
    src, path, run = place
    numbers(spark, src, 0, 4)
    enter = runlog.enter

    def entered_then_lost(*a):
        enter(*a)
        raise RuntimeError("lost")

    monkeypatch.setattr(runlog, "enter", entered_then_lost)
    assert not run("a")
    monkeypatch.setattr(runlog, "enter", enter)
    assert run("b")  # the retry adds nothing
    assert logged(spark, path) == [(i, "a") for i in range(4)]


def test_an_empty_run_leaves_no_file(spark, place, tmp_path):
    src, path, run = place
    assert run("none") and runlog.ledger(spark, path).count() == 0
    assert not runlog.export_run(spark, path, "none", str(tmp_path / "none"), ["id"]) and not os.path.exists(tmp_path / "none")
    numbers(spark, src, 0, 3)
    assert run("some")
    files = sum(len(f) for _, _, f in os.walk(path))
    assert run("none") and sum(len(f) for _, _, f in os.walk(path)) == files
    assert runlog.export_run(spark, path, "some", str(tmp_path / "some"), ["id"])
    back = spark.read.option("header", True).option("inferSchema", True).csv(str(tmp_path / "some")).collect()
    assert sorted((r["id"], r["part"], r["run"]) for r in back) == [(i, i % 3, "some") for i in range(3)]


def test_batches_are_limited_by_bytes(spark, tmp_path):
    src = str(tmp_path / "in")
    for i in range(6):
        numbers(spark, src, 1000 * i, 1000 * (i + 1))
    size = max(os.path.getsize(os.path.join(src, f)) for f in os.listdir(src) if f.endswith(".parquet"))
    schema = spark.read.parquet(src).schema
    for limit, most in ((size * 2, 2), (1, 1)):  # a file that is larger than the limit comes alone
        seen = []
        stream = live.reading_stream(spark, src, schema, bytes_per_trigger=limit)
        query = stream.writeStream.foreachBatch(lambda df, b, _s=seen: _s.append(df.select(F.input_file_name()).distinct().count())).option("checkpointLocation", str(tmp_path / f"ckpt-{limit}"))
        query.trigger(availableNow=True).start().awaitTermination()
        assert sum(seen) == 6 and max(seen) <= most and len(seen) >= 6 // most
