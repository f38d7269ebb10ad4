"""CSV files with columns of their own, inferred types and a quarantine.

Files below a folder may differ in their columns and in the columns' order: a
cell belongs to the name at its place in its own file's header. Header lines
are found by the required names they hold, wherever Spark cuts the files.

Types come from one aggregation over all cells of all columns. They form a
lattice: nothing but missing cells lies under ``boolean``, under ``bigint`` <
``double``, and under ``timestamp_ntz``; ``string`` lies over all. A column has
the lowest type that at most ``bad_share`` of its cells do not fit; declared
columns (the telemetry schema by default) have their type.

No cell ends a job. A cell that its column's type does not fit is NULL and is
kept as text in the row's ``_rescued`` (a JSON object by column); rows of more cells than
their header has names, and rows of files without a header, are kept there whole.
``accepted`` are the rows without such faults, ``quarantined`` the others with
file and reason.

Missing cells are empty, blank or ``NaN``. Rows shorter than their header miss
the last cells. Only the different header lines reach the driver (``MAX_HEADERS``
at most, more are an error) and one row of counts.
"""

from __future__ import annotations

import csv
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wearcast import schema as S

MAX_HEADERS = 1000
#: The lattice from the narrowest type up; bigint lies under double, the others under string alone.
TYPES = ("boolean", "bigint", "double", "timestamp_ntz", "string")
DECLARED = {S.TIME: "timestamp_ntz", S.KEY: "string", **dict.fromkeys(S.SENSORS, "double"), S.LABEL: "int"}
FAULTS = ("_file", "_reason", "_rescued")


def _text(cell: Column) -> Column:
    """The cell's text, NULL if it is missing."""
    trimmed = F.trim(cell)
    return F.when((trimmed != "") & (F.lower(trimmed) != "nan"), trimmed)


def parse(text: Column, kind: str) -> Column:
    """A cell as a value of the type, NULL where it does not fit."""
    if kind == "string":
        return text
    if kind == "boolean":
        return F.when(F.lower(text).isin("true", "false"), F.lower(text) == "true")
    if kind == "timestamp_ntz":
        return F.when(text.rlike(r"^\d{4}-\d\d?-\d\d?"), text.try_cast("timestamp_ntz"))
    if kind == "int":  # 0.0 and 1.0 are whole numbers, as other writers put them
        number = text.try_cast("double")
        return F.when(number == F.floor(number), number).try_cast("int")
    return text.try_cast(kind)


@dataclass
class Inferred:
    """Text cells by column, and each column's type."""

    rows: DataFrame  # _file, _known (the file has a header), _wide (more cells than names), _cells, and the columns as text
    types: dict[str, str]

    def read(self) -> DataFrame:
        """Typed columns, then ``_file``, ``_reason`` (NULL in a sound row) and ``_rescued``."""
        cells = {c: F.col(f"`{c}`") for c in self.types}
        typed = {c: parse(cells[c], kind) for c, kind in self.types.items()}
        bad = {c: cells[c].isNotNull() & typed[c].isNull() for c, kind in self.types.items() if kind != "string"}
        faults = [F.when(~F.col("_known"), F.lit("no header"))]
        faults += [F.when(F.col("_wide"), F.lit("more cells than names"))]
        faults += [F.when(b, F.lit(f"{c}: not {self.types[c]}")) for c, b in bad.items()]
        reason = F.array_join(F.array_compact(F.array(*faults)), "; ")
        odd = ~F.col("_known") | F.col("_wide")
        rescued = F.when(odd, F.to_json(F.struct(F.col("_cells").alias("cells")))).when(
            reason != "", F.to_json(F.struct(*[F.when(b, cells[c]).alias(c) for c, b in bad.items()])))
        return self.rows.select(*[F.when(~odd, v).alias(c) for c, v in typed.items()], F.col("_file"), F.when(reason != "", reason).alias("_reason"), rescued.alias("_rescued"))


def _headers(spark: SparkSession, path: str, required: Sequence[str]) -> tuple[DataFrame, list[list[str]]]:
    """(file, number of its header) and the different headers."""
    lines = spark.read.option("recursiveFileLookup", True).text(path).select(F.col("_metadata.file_path").alias("_file"), F.regexp_replace("value", "^﻿|\r$", "").alias("line"))
    for name in required:
        lines = lines.where(F.col("line").contains(name))
    found = lines.select("line").distinct().limit(MAX_HEADERS + 1).collect()
    names = {r["line"]: [c.strip() for c in next(csv.reader([r["line"]]))] for r in found}
    known = sorted(line for line, own in names.items() if set(required) <= set(own))
    if len(found) > MAX_HEADERS:
        raise ValueError(f"{path}: more than {MAX_HEADERS} different headers")
    if not known:
        raise ValueError(f"{path}: no header with {', '.join(required)}")
    number = F.create_map(*[x for i, line in enumerate(known) for x in (F.lit(line), F.lit(i))])
    files = lines.where(F.col("line").isin(known)).groupBy("_file").agg(F.min(F.try_element_at(number, F.col("line"))).alias("_header"))
    return files, [names[line] for line in known]


def infer(spark: SparkSession, path: str, declared: Mapping[str, str] = DECLARED, required: Sequence[str] = S.REQUIRED_COLUMNS,
          bad_share: float = 0.0) -> Inferred:
    """Read all files below ``path`` as text by name, and find the type of every column."""
    files, headers = _headers(spark, path, required)
    width = max(len(h) for h in headers) + 1
    places = [f"c{i}" for i in range(width)]
    raw = spark.read.schema(T.StructType([T.StructField(p, T.StringType()) for p in places])).option("header", False).option("recursiveFileLookup", True) \
        .option("mode", "PERMISSIVE").option("escape", '"').csv(path).select(F.col("_metadata.file_path").alias("_file"), F.array(*places).alias("_cells"))
    rows = raw.join(files, "_file", "left")
    names = list(dict.fromkeys(n for h in headers for n in h if n))

    def cell(name):
        out = F.lit(None).cast("string")
        for i, h in enumerate(headers):
            if name in h:
                out = F.when(F.col("_header") == i, F.col("_cells")[h.index(name)]).otherwise(out)
        return out

    wide = F.lit(False)
    for i, h in enumerate(headers):
        wide = F.when(F.col("_header") == i, F.exists(F.slice("_cells", len(h) + 1, width), lambda x: x.isNotNull())).otherwise(wide)
    named = rows.select("_file", F.col("_header").isNotNull().alias("_known"), wide.alias("_wide"), "_cells", *[cell(n).alias(n) for n in names])
    is_header = F.lit(True)
    for n in required:
        is_header = is_header & F.coalesce(F.regexp_replace(F.trim(F.col(f"`{n}`")), "^﻿", "") == n, F.lit(False))
    named = named.where(~is_header).select("_file", "_known", "_wide", "_cells", *[_text(F.col(f"`{n}`")).alias(n) for n in names])

    open_names = [n for n in names if n not in declared]
    if not open_names:
        return Inferred(named, {n: declared[n] for n in names})
    sound = named.where(F.col("_known") & ~F.col("_wide"))
    fits = [F.struct(F.count(F.col(f"`{n}`")).alias("cells"), *[F.count(parse(F.col(f"`{n}`"), kind)).alias(kind) for kind in TYPES]).alias(f"t{i}") for i, n in enumerate(open_names)]
    counts = sound.agg(*fits).first()  # one row
    types = {}
    for i, n in enumerate(open_names):
        c = counts[f"t{i}"]
        types[n] = next(kind for kind in TYPES if c["cells"] - c[kind] <= bad_share * c["cells"]) if c["cells"] else "string"
    return Inferred(named, {n: declared.get(n) or types[n] for n in names})


def read_csv(spark: SparkSession, path: str, declared: Mapping[str, str] = DECLARED, required: Sequence[str] = S.REQUIRED_COLUMNS, bad_share: float = 0.0) -> DataFrame:
    """All rows of all files, typed, with their faults."""
    return infer(spark, path, declared, required, bad_share).read()


def accepted(rows: DataFrame) -> DataFrame:
    return rows.where("_reason IS NULL").drop(*FAULTS)


def quarantined(rows: DataFrame) -> DataFrame:
    """The rows with faults, all columns as far as they could be read."""
    return rows.where("_reason IS NOT NULL")
