"""Base spans against plain patterns, inferred automata on planted formats, held-out credentials, edge rows."""

import hashlib
import random
import re
import string

import numpy as np

from tests.conftest import SF_MID
from wearcast.llm import secret_scan as S


def brute(text):
    found = []
    for m in re.finditer(r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text or ""):
        if len(m.group(2)) >= 6:
            found.append((m.start(), 0, m.end()))
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text or "") if len(m.group()) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text or "") if len(m.group()) >= 24]
    found.sort()
    joined = ",".join(f"{S.KINDS[k]}:{a}:{z}" for a, k, z in found)
    return *(sum(k == n for _, k, _ in found) for n in range(3)), hashlib.sha256(joined.encode()).hexdigest(), joined


def hexa(rng, n):
    return "".join(rng.choice("0123456789abcdef") for _ in range(n))


def key(rng, n=16):
    return "".join(rng.choice(string.ascii_letters + string.digits) for _ in range(n))


def word(rng, n):
    return "".join(rng.choice(("an", "the", "ing", "ol", "men", "tion", "er")) for _ in range(n))


def corpus(rng, n=300):
    out = []
    for i in range(n):
        text = [word(rng, rng.randint(1, 7)) for _ in range(30)] + [str(rng.randint(10**15, 10**16 - 1)), f"{word(rng, 3)}.{word(rng, 2)}.example.com"]
        text += [f"token = \"{hexa(rng, rng.choice([18, 40]))}\"", f"api_key: sk_live_{key(rng)}", f"AKIA{''.join(rng.choice(string.ascii_uppercase + string.digits) for _ in range(16))}"] if i % 3 == 0 else []
        rng.shuffle(text)
        out.append(" ".join(text))
    return out


def made(spark, texts):
    return spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, spans string")


def test_base_equals_plain_patterns(spark):
    rng = random.Random(1)
    bits = ["token", "TOKEN", "apikey", "api_KEY", "\"", "'", " ", ":", "=", "==", "abc123", "x", "AKIA", "AKIAAKIA", "ABCDEFGHIJ0123456789", "0123456789abcdef", "deadbeef", "é𝄞", "ſecret", "toKen", "\n", ".", "secret=aaaaaa"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 25))) for _ in range(500)]
    texts += [None, "", "a" * 300_000, "." * 100_000, "token" * 20_000, "password" + " " * 100_000 + "x", "token=" + "=" * 50_000, "a." * 50_000]
    got = {r["doc_id"]: r for r in S.report(S.find(made(spark, texts), S.Grammar({}, None, {}))).collect()}
    for i, t in enumerate(texts):
        assert tuple(got[i][c] for c in ("n_assign", "n_access", "n_hex", "base_sha256", "spans")) == brute(t), repr(t)[:300]


def test_whole_table(spark):
    from wearcast.llm.queries import QUERIES
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF_MID}/documents.parquet").collect()}
    for r in QUERIES["op11_secret_scan"](spark, SF_MID).collect():
        want = brute(texts[r["doc_id"]])
        assert (r["n_assign"], r["n_access"], r["n_hex"], r["base_sha256"]) == want[:4]
        assert set(filter(None, want[4].split(","))) <= set(r["spans"].split(","))


def test_secrets_beyond_the_patterns_and_nothing_else(spark):
    rng = random.Random(4)
    grammar = S.fit(made(spark, corpus(rng)))
    assert set(grammar.kinds) == set(S.KINDS)
    hidden = [hexa(rng, 20) for _ in range(100)] + [f"sk_live_{key(rng)}" for _ in range(100)]
    plain = [word(rng, 8) for _ in range(100)] + [str(rng.randint(10**15, 10**16 - 1)) for _ in range(100)] + [f"{word(rng, 4)}.{word(rng, 2)}.example.com" for _ in range(100)] + [word(rng, 7).upper() for _ in range(100)]
    texts = [f"see {v} here" for v in hidden + plain]
    found = {r["doc_id"]: [s["value"] for s in r["spans"]] for r in S.find(made(spark, texts), grammar).collect()}
    hit = [found[i] == [v] for i, v in enumerate(hidden)]
    assert sum(hit) >= 0.9 * len(hidden)  # formats learned from labelled credentials, without their keyword
    assert sum(bool(found[len(hidden) + i]) for i in range(len(plain))) <= 0.01 * len(plain)


def test_automaton_is_a_distribution_and_keeps_the_format():
    rng = random.Random(6)
    words = [S.symbols(f"AKIA{hexa(rng, 8).upper()}").tobytes() for _ in range(400)]
    machine = S.Automaton.infer(words)
    total = (2.0 ** machine.weight).sum(axis=1) + 2.0 ** machine.end
    assert np.allclose(total[:-1], 1, atol=0.01) and len(total) < 12
    like, unlike = machine.score([S.symbols("AKIA01234567"), S.symbols("XKIA01234567")])
    assert like > unlike + 5
    long = S.symbols("AKIA" + "0" * (S.LONG_RUN + 10))
    short = machine.score([long[:S.LONG_RUN]])[0] - machine.end[-1]
    assert machine.score([long, long[:S.LONG_RUN]])[1] == machine.score([long[:S.LONG_RUN]])[0] and np.isfinite(short)
    whole = sum(machine.weight[s, c] for s, c in walk(machine, long)) + machine.end[last(machine, long)]
    assert abs(machine.score([long])[0] - whole) < 1e-6


def walk(machine, word):
    s = 0
    for c in word.tolist():
        yield s, c
        s = machine.step[s, c]


def last(machine, word):
    s = 0
    for c in word.tolist():
        s = machine.step[s, c]
    return s


def test_fit_does_not_depend_on_partitions_or_copies(spark):
    texts = corpus(random.Random(7), 120)
    once = S.fit(made(spark, texts).repartition(1))
    again = S.fit(made(spark, texts + texts[:40] * 5).repartition(7))
    assert once.threshold == again.threshold
    assert all((once.kinds[k].weight == again.kinds[k].weight).all() for k in once.kinds)


def test_learns_from_every_value_to_its_end(spark):
    rng = random.Random(8)
    secrets = [hexa(rng, S.DEPTH + rng.randint(20, 60)) for _ in range(2_500)]  # more and longer than a sample would hold
    texts = [f"token={v} {word(rng, 8)}" for v in secrets]
    found = S.values(made(spark, texts + texts[:500]).repartition(5)).collect()
    assert sorted(r["value"] for r in found if r["kind"] == "assign") == sorted(secrets)
    assert len(secrets) / 5 < sum(r["held"] for r in found if r["kind"] == "assign") < len(secrets) / 3
    grammar = S.fit(made(spark, texts))
    assert set(grammar.kinds) == {"assign", "hex"}
    kept = [S.symbols(r["value"]) for r in found if r["kind"] == "hex" and not r["held"]]
    count, falls = S.walk(np.where(grammar.kinds["hex"].step[:-1] == len(grammar.kinds["hex"].step) - 1, -1, grammar.kinds["hex"].step[:-1]), kept)
    assert not len(falls) and count.sum() == sum(len(w) + 1 for w in kept)  # every symbol of every value has its state
    share = 0.5 / (S.SYMBOLS + 1)
    assert np.allclose(2 ** grammar.kinds["hex"].weight[:-1], ((count + share) / (count.sum(1) + 0.5)[:, None])[:, :-1])


def test_prefixes_and_walks_count_all(spark):
    rng = random.Random(9)
    words = {("hex", hexa(rng, rng.randint(1, 5))) for _ in range(400)} | {("assign", "ab" * rng.randint(1, 300)) for _ in range(60)}
    want = {}
    for kind, w in words:
        x = S.symbols(w).tobytes()
        for d in range(min(len(x), S.DEPTH - 1) + 1):
            own = want.setdefault((kind, x[:d]), {})
            c = x[d] if d < len(x) else S.END
            own[c] = own.get(c, 0) + 1
    want = {k: own for k, own in want.items() if sum(own.values()) >= 8}
    df = spark.createDataFrame(sorted(words), "kind string, value string").repartitionByRange(7, "kind", "value").sortWithinPartitions("kind", "value")
    got = {}
    for r in S.prefixes(df, {"hex": 8, "assign": 8}).collect():
        got.setdefault((r["kind"], bytes(r["prefix"])), {})[r["symbol"]] = r["n"]
    assert got == want
    step = np.full((2, S.SYMBOLS), 1, np.int32)
    step[1, S.symbols("z")[0]] = -1
    long = "a" * (S.LONG_RUN + 5)
    count, falls = S.walk(step, [S.symbols(x) for x in ("az", "azb", "aa", "", long, long + "zq")])
    a, z, b, q = (int(S.symbols(x)[0]) for x in "azbq")
    assert falls.tolist() == sorted([[1, z, S.END, 1], [1, z, b, 1], [1, z, q, 1]])
    assert (count[0, a], count[0, S.END], count[1, a], count[1, z], count[1, S.END], count.sum()) == (5, 1, 1 + 2 * (len(long) - 1), 3, 2, 5 + 1 + 1 + 2 * (len(long) - 1) + 3 + 2)


def test_edge_rows(spark):
    docs = spark.createDataFrame([(1, None), (None, "token=abcdef"), (1, "token=abcdef"), (1, "token=abcdef")], "doc_id long, text string")
    grammar = S.fit(docs)
    assert grammar.kinds == {}  # too few labels: base spans only
    assert sorted((r["doc_id"] or 0, r["spans"]) for r in S.report(S.find(docs, grammar)).collect()) == [(0, "assign:0:12"), (1, ""), (1, "assign:0:12"), (1, "assign:0:12")]
    assert S.find(docs.limit(0), grammar).count() == 0 and S.fit(docs.limit(0)).kinds == {}
