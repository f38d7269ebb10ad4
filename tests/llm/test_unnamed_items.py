"""Benchmark rows without an id: the registered query against its SQL, and the pipeline's stage."""

import duckdb

import corpus_pipeline as C
from wearcast.llm import queries as Q


def test_rows_without_an_id_are_hit(spark, tmp_path):
    ten = " ".join(f"w{i}" for i in range(10))
    docs = spark.createDataFrame([(1, f"a {ten} b"), (2, f"x y z and {ten}"), (3, "clean"), (4, "x y z"), (5, None)], "doc_id long, text string")
    items = spark.createDataFrame([(None, ten), (7, "x y z"), (None, "y z and")], "item_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    items.write.parquet(f"{tmp_path}/benchmark.parquet")
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{tmp_path}/{name}.parquet/*.parquet')")
    got = sorted(map(tuple, Q.QUERIES["op3_decontamination"](spark, str(tmp_path)).collect()))
    assert got == sorted(con.execute(Q.ORACLES["op3_decontamination"]).fetchall())
    assert [r[2] for r in got] == [10, 14, 0, 3, 0]
    assert [r["doc_id"] for r in C.stage_decontamination(spark, docs, str(tmp_path)).orderBy("doc_id").collect()] == [3, 5]
