"""Base spans against plain regular expressions, trees against Spark's own scores, and the defined edge cases."""

import hashlib
import random
import re

import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from tests.conftest import SF_MID
from wearcast.llm import pii as P

PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
         "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def valid(kind, v):
    d = [int(c) for c in v if c in "0123456789"]
    if kind == "ip":
        return all(int(x) <= 255 for x in v.split("."))
    if kind == "card":
        return 14 <= len(d) <= 19 and sum(x if i % 2 == 0 else 2 * x - 9 * (x > 4) for i, x in enumerate(reversed(d))) % 10 == 0
    return kind == "email" or 10 <= len(d) <= 15


def brute(text):
    found = [(m.start(), k, m.end()) for k, kind in enumerate(P.KINDS) for m in re.finditer(PLAIN[kind], text or "") if valid(kind, m.group())]
    found.sort()
    joined = ",".join(f"{P.KINDS[k]}:{a}:{z}" for a, k, z in found)
    return *(sum(k == n for _, k, _ in found) for n in range(4)), hashlib.sha256(joined.encode()).hexdigest(), joined


def made(rng):
    bits = ["a.b@c.d", "x@y", "me@a.b.c@d.e_q@r.s", "1.2.3.4", "1.2.3.4.5.6.7.8", "256.1.1.1", "0255.1.01.1", "4111 1111 1111 1111", "4111-1111-1111-1112", "4041894974608795",
            "+1 (988) 555-2485", "+44.20.7946.0958 99", "++1234567890", "+1", "é𝄞", " ", "\n", "no", "@", "a@b..c", "%@a.b-", "12345678901234", "  1 2  3-4 5", ".", "-", "1-", "7", "[at]", "x [at] y.z"]
    return "".join(rng.choice(bits) for _ in range(rng.randint(0, 25)))


@pytest.fixture(scope="module")
def judge(spark):
    return P.fit(spark.read.parquet(f"{SF_MID}/documents.parquet"))


def test_base_equals_plain_patterns(spark):
    rng = random.Random(1)
    texts = [made(rng) for _ in range(400)] + [None, "", "1" * 30_000, "1 " * 9000, "a" * 30_000 + "@b.c", "+" + "1 " * 8000, ".1" * 9000, "a.b@c.d " * 1500, "x@" + "y." * 5000 + "z"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in P.report(P.find(docs, P.Judge(None, {}))).collect()}
    for i, t in enumerate(texts):
        assert tuple(got[i][c] for c in ("n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans")) == brute(t), repr(t)[:300]


def test_whole_table(spark, judge):
    from wearcast.llm.queries import QUERIES
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF_MID}/documents.parquet").collect()}
    for r in QUERIES["op7_pii"](spark, SF_MID).collect():
        want = brute(texts[r["doc_id"]])
        assert (r["n_email"], r["n_ip"], r["n_card"], r["n_phone"], r["base_sha256"]) == want[:5]
        assert set(filter(None, want[5].split(","))) <= set(r["spans"].split(","))


def test_trees_as_an_expression(spark, judge):
    rows = P._sample(spark.read.parquet(f"{SF_MID}/documents.parquet").select("text"), F.col("text"), 400)
    ready = VectorAssembler(inputCols=list(P.FEATURES), outputCol="features").transform(rows)
    margin = P.tree_sum(judge.model, [F.col(f) for f in P.FEATURES])
    out = judge.model.transform(ready).select(F.element_at(P_array("probability"), 2).alias("p"), (1 / (1 + F.exp(-2 * margin))).alias("q")).collect()
    assert out and max(abs(r["p"] - r["q"]) for r in out) < 1e-9


def P_array(c):
    from pyspark.ml.functions import vector_to_array
    return vector_to_array(F.col(c))


def test_candidates_beyond_the_rules(spark, judge):
    found = [("email", "joe [at] mail.example.com"), ("email", "ann.b(at)mail3.example(dot)com"), ("email", "eve @ mail.example.com"), ("ip", "10[.]20[.]30[.]40"),
             ("card", "4111  1111  1111  1111"), ("card", "4111.1111.1111.1111"), ("card", "4111/1111/1111/1111"),
             ("phone", "030 2094 7781"), ("phone", "(988) 555-2485"), ("phone", "1 988 555-2485")]
    plain = ["plain prose, nothing here", "see joe [at] home", "in 1990, 1991 and 12345", "1234567890123", "version 1.2.3 of 300.1.2.900", "4111  1111  1111  1112", "on 2024-01-15 at 10:30:00", "12/05/2021 14:00",
             "4785380592391130 is no card"]
    texts = [f"write to {v} now" for _, v in found] + plain
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, spans string")
    rows = {r["doc_id"]: r["spans"] for r in P.find(docs, judge).collect()}
    got = {i: [(s["kind"], s["value"], s["base"]) for s in r] for i, r in rows.items()}
    assert {i: got[i] for i in range(len(found))} == {i: [(k, v, False)] for i, (k, v) in enumerate(found)}
    assert {t: got[len(found) + i] for i, t in enumerate(plain)} == {t: [] for t in plain}
    assert all(P.PRECISION / 2 <= s["score"] <= 1 for r in rows.values() for s in r)


def test_spans_added_on_the_whole_table(spark, judge):
    docs = spark.read.parquet(f"{SF_MID}/documents.parquet")
    spans = docs.join(P.find(docs, judge), "doc_id").select(F.explode("spans").alias("s")).select("s.*").collect()
    added = [s for s in spans if not s["base"]]
    assert added and all(P_check(s["kind"], s["value"]) for s in added)


def P_check(kind, v):
    return valid(kind, re.sub(r"[^0-9.]", "", v) if kind != "email" else v)


def test_labels_are_checks_on_normalised_spans(spark):
    rows = [("email", "a [at] b.com", "", 1.0), ("email", "a@b", "", 0.0), ("ip", "1[.]2[.]3[.]4", "", 1.0), ("ip", "1:2:3:4", "", 0.0), ("card", "4111/1111/1111/1111", "", 1.0),
            ("card", "4111111111111112", "", 0.0), ("phone", "+44 20 7946 0958", "", 1.0), ("phone", "030 2094 7781", "Tel: ", 1.0), ("phone", "030 2094 7781", "hotel ", None),
            ("phone", "12 34 56", "", 0.0), ("phone", "03020947781", "", 0.0)]
    df = spark.createDataFrame([(i, k, v, b) for i, (k, v, b, _) in enumerate(rows)], "i int, kind string, value string, before string").withColumn("x", F.struct("value", "before"))
    for kind in P.KINDS:
        for r in df.filter(F.col("kind") == kind).select("i", P.verdict(kind, F.col("x")).alias("v")).collect():
            assert r["v"] == rows[r["i"]][3], rows[r["i"]]


def test_edge_rows(spark, judge):
    docs = spark.createDataFrame([(1, None), (None, "a.b@c.d"), (1, "a.b@c.d and 1.2.3.4"), (1, "a.b@c.d and 1.2.3.4")], "doc_id long, text string")
    out = sorted(((r["doc_id"] or 0, r["n_email"], r["n_ip"]) for r in P.report(P.find(docs, judge)).collect()))
    assert out == [(0, 1, 0), (1, 0, 0), (1, 1, 1), (1, 1, 1)]
    assert P.find(docs.limit(0), judge).count() == 0 and P.fit(docs.limit(0)).model is None
    assert {r["text"] for r in P.redact(docs, P.Judge(None, {})).collect()} == {"", "[email]", "[email] and [ip]"}


def test_all_candidates_are_learnt_from(spark):
    docs = spark.range(6000).select(F.concat(F.lit("write to a"), "id", F.lit("@b.cd")).alias("text"))
    seen = P._labelled(docs, F.col("text")).filter("kind = 0").agg(F.sum("n")).first()[0]
    assert seen == 12_000  # each address, and once more as rewritten
