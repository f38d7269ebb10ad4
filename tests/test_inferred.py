"""The lattice of types, files of several shapes, and rows that cannot be read."""

import json

import pytest

from wearcast.sources import inferred as I

DECLARED = {"machine_id": "string", "v": "double"}
REQUIRED = ["machine_id", "v"]


def write(tmp_path, **files):
    for name, text in files.items():
        (tmp_path / f"{name}.csv").write_text(text, encoding="utf-8")
    return str(tmp_path)


def read(spark, path, **kw):
    return I.read_csv(spark, path, DECLARED, REQUIRED, **kw)


def test_types_of_one_column(spark, tmp_path):
    cells = {"whole": ["1", "-2", ""], "real": ["1", "2.5", "1e3"], "flag": ["true", "False", " "], "at": ["2024-01-02", "2024-01-02 03:04:05", "2024-01-02T03:04:05.000006"],
             "words": ["1", "x", "true"], "mixed": ["1", "true", ""], "nothing": ["", "NaN", " "], "big": ["9223372036854775807", "9223372036854775808", "1"]}
    lines = ["machine_id,v," + ",".join(cells)] + [f"m{i},{i}," + ",".join(c[i] for c in cells.values()) for i in range(3)]
    got = I.infer(spark, write(tmp_path, a="\n".join(lines) + "\n"), DECLARED, REQUIRED).types
    assert got == DECLARED | {"whole": "bigint", "real": "double", "flag": "boolean", "at": "timestamp_ntz", "words": "string", "mixed": "string", "nothing": "string", "big": "double"}


def test_a_share_of_bad_cells(spark, tmp_path):
    text = "machine_id,v,n\n" + "".join(f"m,{i},{i if i else 'x'}\n" for i in range(20))
    path = write(tmp_path, a=text)
    assert I.infer(spark, path, DECLARED, REQUIRED).types["n"] == "string"
    rows = read(spark, path, bad_share=0.05)
    bad = I.quarantined(rows).collect()
    assert dict(rows.dtypes)["n"] == "bigint" and [json.loads(r["_rescued"]) for r in bad] == [{"n": "x"}] and bad[0]["v"] == 0.0
    assert I.accepted(rows).count() == 19


def test_files_of_several_shapes(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    write(tmp_path / "deep", c="﻿v,machine_id,extra\r\n3,c,7\r\n,c2,\r\n")
    path = write(tmp_path, a="machine_id,v\na,1\n\"a,2\",2\n", b="v,other,machine_id\n5,\"x \"\"y\"\"\",b\noops,z,b2\n6,z,b3,1,2\n7\n")
    rows = read(spark, path)
    assert dict(rows.dtypes)["extra"] == "bigint"
    good = sorted(tuple(r) for r in I.accepted(rows).select("machine_id", "v", "other", "extra").collect() if r["machine_id"])
    assert good == [("a", 1.0, None, None), ("a,2", 2.0, None, None), ("b", 5.0, 'x "y"', None), ("c", 3.0, None, 7), ("c2", None, None, None)]
    assert [(r["v"], r["other"]) for r in I.accepted(rows).collect() if not r["machine_id"]] == [(7.0, None)]  # a short row misses its last cells
    bad = {r["_reason"]: json.loads(r["_rescued"]) for r in I.quarantined(rows).collect()}
    assert bad["v: not double"] == {"v": "oops"}
    assert bad["more cells than names"]["cells"][:3] == ["6", "z", "b3"] and len(bad) == 2
    assert {r["_file"].split("/")[-1] for r in I.quarantined(rows).collect()} == {"b.csv"}


def test_files_without_a_header(spark, tmp_path):
    path = write(tmp_path, a="machine_id,v\na,1\n", b="b,2\n")
    bad = I.quarantined(read(spark, path)).collect()
    assert [r["_reason"] for r in bad] == ["no header"] and json.loads(bad[0]["_rescued"])["cells"][:2] == ["b", "2"]
    (tmp_path / "none").mkdir()
    with pytest.raises(ValueError):
        read(spark, write(tmp_path / "none", b="b,2\n"))


def test_only_a_header(spark, tmp_path):
    assert read(spark, write(tmp_path, a="machine_id,v,n\n")).count() == 0
