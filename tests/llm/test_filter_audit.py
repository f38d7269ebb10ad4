"""Every step against a plain walk through the filters; the oracle on sf0.01; edge rows."""

import random
import re
from collections import Counter
from itertools import permutations

import numpy as np

from tests.conftest import SF_MID
from tests.oracle import compare
from wearcast.llm import filter_audit as A

FIELDS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")


def plain(docs, labels):
    """docs: (id, text, lang); labels: (id, quality, toxic)."""
    good = {i for i, q, _ in labels if i is not None and q == 1}
    toxic = {i for i, _, t in labels if i is not None and t == 1}
    least = {}
    for i, text, _ in docs:
        if i is not None:
            least[text or ""] = min(i, least.get(text or "", i))
    rows = []
    for i, text, lang in docs:
        t = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = set()
        fails |= {"A"} if len(w) < 200 else set()
        fails |= {"B"} if 100 * len(set(w)) < 50 * len(w) else set()
        fails |= {"C"} if 100 * len(re.findall("[A-Z]", t)) > 3 * len(t) else set()
        fails |= {"D"} if re.search(r"[#$%&*|]", t) else set()
        fails |= {"E"} if i is not None and i > least[t] else set()
        rows.append((lang or "", fails, i in good, i in toxic))
    out, value = {}, Counter()
    for part in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == part]
        for order in permutations("ABCDE"):
            left = own
            for s, f in enumerate(order):
                gone = [r for r in left if f in r[1]]
                failing = [r for r in own if f in r[1]]
                left = [r for r in left if f not in r[1]]
                value[part, f] += len(gone)
                out[part, "".join(order), s + 1] = (len(left), len(gone), len(failing) - len(gone), sum(r[1] == {f} for r in own), sum(r[2] for r in gone), sum(r[3] for r in gone))
    return {k: (*v, value[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def audited(spark, docs, labels):
    d = spark.createDataFrame([(i, t, p, "x", 7) for i, t, p in docs], "doc_id long, text string, lang string, cell string, n int")
    found = A.audit(A.contingency(d, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))).collect()
    return {(r["part"], r["filter_order"], r["step"]): tuple(r[c] for c in (*FIELDS, "shapley")) for r in found}


def test_random_documents(spark):
    rng = random.Random(5)
    texts = [" ".join(rng.choice(["a", "B", "cd", "é", "X#", "{}".format(rng.randint(0, 9999))]) for _ in range(n)) for n in (0, 1, 150, 199, 200, 201, 400)]
    texts += [" ".join(str(k) for k in range(n)) for n in (199, 200, 300)] + ["a " * 250, "A" * 33 + "a" * 967, None, "", "\x0b\t "]
    docs = [(rng.choice([None, *range(120)]), rng.choice(texts), rng.choice(["en", "de", None, ""])) for _ in range(200)]
    labels = [(rng.choice([None, *range(120)]), rng.choice([0, 1, None]), rng.choice([0, 1, None])) for _ in range(120)]
    assert audited(spark, docs, labels) == plain(docs, labels)


def test_empty_tables(spark):
    assert audited(spark, [], [(1, 1, 1)]) == {}
    docs = [(1, "x", "en")] * 3
    got = audited(spark, docs, [])
    assert len(got) == 600 and got == plain(docs, [])  # rows that repeat an id are no copies of each other


def test_contractions_are_sums():
    rng = np.random.default_rng(1)
    tensor = rng.integers(0, 50, (1, 2, 2, 2, 2, 2))
    steps, chosen = A.selections(5)
    got = A.contract(tensor, chosen["removed"])[0]
    for (order, step, axis), n in zip(steps, got):
        cut = [slice(None)] * 5
        for f in order[:step - 1]:
            cut[A.FILTERS.index(f)] = slice(0, 1)
        cut[axis] = slice(1, 2)
        assert n == tensor[0][tuple(cut)].sum()


def test_oracle(spark, duck_mid):
    from wearcast.llm.queries import ORACLES, QUERIES
    ok, msg = compare(QUERIES["op12_filter_audit"](spark, SF_MID), duck_mid, ORACLES["op12_filter_audit"])
    assert ok, msg
