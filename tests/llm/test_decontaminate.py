"""One automaton over the benchmark against a direct window search, and the defined edge cases."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from tests.conftest import SF_SMALL
from wearcast.llm import decontaminate as D

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))


def brute(text, items, window):
    doc = words(text)
    hit, found = set(), set()
    for i, t in items:
        w = words(t)
        runs = [w] if 0 < len(w) < window else [w[k:k + window] for k in range(len(w) - window + 1)]
        for r in runs:
            for p in range(len(doc) - len(r) + 1):
                if doc[p:p + len(r)] == r:
                    hit.update(range(p, p + len(r)))
                    found.add(str(i))
    return len(doc), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


ITEMS = [(1, "a b c d e f"), (2, "B c"), (3, ""), (4, None), (10, "x-y é1 z"), (2, "c a"), (None, "q q")]
TEXTS = ["A b, C! d e f a b c d e f", "b c b c", None, "", "q q", "x y É1 z x.y é1 z", "c a b c d", "ab c", "b" * 50_000 + " c a " * 300]


@pytest.mark.parametrize("window", [2, 3, 10])
def test_equals_direct_search(spark, window):
    docs = spark.createDataFrame([(i % 4 if i else None, t, i) for i, t in enumerate(TEXTS)], "doc_id long, text string, hits int")
    items = spark.createDataFrame(ITEMS, "item_id long, text string").withColumn("window", F.lit(1))
    got = sorted(map(tuple, D.report(D.scan(docs, items, window)).collect()), key=str)
    want = sorted(((i % 4 if i else None, *brute(t, [x for x in ITEMS if x[0] is not None], window)) for i, t in enumerate(TEXTS)), key=str)
    assert got == want


def test_offsets_are_those_of_the_original_text(spark):
    docs = spark.createDataFrame([(1, "É—Ünö!  the  QUICK--brown, fox! ran")], "doc_id long, text string")
    items = spark.createDataFrame([(7, "quick, brown fox")], "item_id long, text string")
    hit, = D.scan(docs, items, 3).first()["hits"]
    assert docs.first()["text"][hit["start_char"]:hit["end_char"]] == "QUICK--brown, fox"


def test_empty_tables_and_the_item_bound(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert D.scan(none, items).count() == 0
    docs = spark.createDataFrame([(1, "b c")], "doc_id long, text string")
    assert tuple(D.report(D.scan(docs, items.limit(0))).first())[1:3] == (2, 0)
    with pytest.raises(ValueError):
        D.scan(docs, items, max_item_bytes=10)


def test_clean_rows_stay_whole(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    items = spark.read.parquet(f"{SF_SMALL}/benchmark.parquet")
    kept = D.remove_contaminated(docs, items)
    assert kept.columns == docs.columns
    flagged = D.report(D.scan(docs, items)).filter("contaminated").select("doc_id")
    assert kept.count() == docs.count() - flagged.count()
    assert kept.join(flagged, "doc_id").count() == 0
