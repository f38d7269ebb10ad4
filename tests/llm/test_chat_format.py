"""Linking, order, validation and canonical form against a direct per-conversation version, and the defined edge cases."""

import json
import random

from pyspark.sql import functions as F

from wearcast.llm import chat_format as C

SCHEMAS = {"add": {"type": "object", "required": ["x"], "properties": {"x": {"type": "integer", "minimum": 0}, "tag": {"enum": ["a", "b"]}, "after": {"type": "array", "items": {"type": "string"}}},
                   "additionalProperties": False}}


def call(cid, args, name="add"):
    return json.dumps({"tool_calls": [{"id": cid, "type": "function", "function": {"name": name, "arguments": args}}]})


def result(cid, content="ok"):
    return json.dumps({"tool_call_id": cid, "content": content})


def brute(rows, schemas=SCHEMAS):
    """rows: (conv, turn, role, text) -> {(conv, turn, json): (status, rank, depth)} by peeling the calls that wait for nobody."""
    ev = [(c, e) for c, t, r, x in rows for e in C.events_of(t, r, x, schemas)]
    out = []
    for conv in {c for c, _ in ev}:
        own = [e for c, e in ev if c == conv]
        spot = lambda e: (e["turn"], e["part"], e["json"])
        calls, results = {}, {}
        for e in own:
            if e["kind"] in ("call", "result") and e["call_id"] is not None:
                d = calls if e["kind"] == "call" else results
                d[e["call_id"]] = min(d.get(e["call_id"], spot(e)), spot(e))
        deps = {k: set() for k in calls}
        for e in own:
            if e["kind"] == "call" and e["call_id"] is not None:
                deps[e["call_id"]] |= {a for a in e["after"] if a in calls}
        at, left = {}, set(calls)
        while ready := [k for k in left if not deps[k] & left]:  # what waits for nobody left; the rest waits for a cycle
            for k in ready:
                last = max((at[d] for d in deps[k]), default=None)
                at[k] = (calls[k][0], 0)
                if last is not None and at[k] <= last:
                    at[k] = (last[0], last[1] + 1)
            left -= set(ready)
        cyc = left
        at |= {k: (calls[k][0], 0) for k in cyc}
        for e in own:
            k = e["call_id"]
            if e["kind"] == "message":
                s = "message"
            elif e["kind"] == "result" and k not in calls:
                s = "orphan"
            elif k is not None and spot(e) != (calls if e["kind"] == "call" else results)[k]:
                s = "duplicate"
            elif e["kind"] == "call" and k in cyc:
                s = "cycle"
            elif e["kind"] == "call" and k not in results:
                s = "open"
            else:
                s = "linked"
            pos = (e["turn"], 0)
            if s in ("linked", "open") and k in at:
                if e["kind"] == "call":
                    pos = (at[k][0], 2 * at[k][1])
                elif at[k][0] >= e["turn"]:
                    pos = (at[k][0], 2 * at[k][1] + 1)
            out.append((conv, e["turn"], e["part"], s, pos, tuple(e["errors"]), e["json"]))
    return sorted(out, key=str)


def made(rng):
    rows = []
    for conv in range(12):
        ids = [f"c{k}" for k in range(rng.randint(1, 5))]
        for turn in range(rng.randint(0, 14)):
            k = rng.random()
            if k < 0.45:
                args = {"x": rng.choice([1, -1, "1", 2.0, True]), "after": rng.sample(ids, rng.randint(0, min(2, len(ids))))}
                if rng.random() < 0.3:
                    args[rng.choice(["tag", "zzz"])] = rng.choice(["a", "q"])
                rows.append((conv, turn, "assistant", call(rng.choice(ids), rng.choice([args, json.dumps(args)]), rng.choice(["add", "add", "sub"]))))
            elif k < 0.8:
                rows.append((conv, turn, "tool", result(rng.choice(ids + ["other"]))))
            else:
                rows.append((conv, turn, rng.choice(["user", "assistant", "tool"]), rng.choice(["hé {", "{", '{"tool_calls": []}', "", '{"x": NaN}'])))
    return rows


def test_equals_direct_version(spark):
    rows = made(random.Random(6))
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, rank int").repartition(4)
    got = sorted(((r["conv_id"], r["turn"], r["part"], r["status"], (r["rank"], r["depth"]), tuple(r["errors"]), r["json"]) for r in C.format_chats(df, SCHEMAS).collect()), key=str)
    assert got == brute(rows)


def test_order_puts_dependencies_first(spark):
    rows = [(1, 0, "assistant", call("late", {"x": 1, "after": ["early"]})), (1, 1, "tool", result("late")), (1, 2, "assistant", call("early", {"x": 2})), (1, 3, "tool", result("early")),
            (2, 0, "assistant", call("p", {"x": 1, "after": ["q"]})), (2, 1, "assistant", call("q", {"x": 1, "after": ["p"]})), (2, 2, "assistant", call("s", {"x": 1, "after": ["s"]}))]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = C.format_chats(df, SCHEMAS).collect()
    one = [(r["kind"], r["call_id"]) for r in sorted((r for r in out if r["conv_id"] == 1), key=lambda r: (r["rank"], r["depth"], r["turn"], r["part"]))]
    assert one.index(("call", "early")) < one.index(("call", "late")) < one.index(("result", "late"))
    assert {r["status"] for r in out if r["conv_id"] == 2} == {"cycle"}


def test_short_cycle_in_a_long_conversation(spark, monkeypatch):
    n, rounds = 20_000, []
    plain = C._looped
    monkeypatch.setattr(C, "_looped", lambda place: rounds.append(1) or plain(place))
    after = F.when(F.col("id") == 7, F.array(F.lit("c9"))).when(F.col("id") == 9, F.array(F.lit("c7"))).when(F.col("id") == 11, F.array(F.lit("c9"))) \
        .when(F.col("id") > 100, F.array(F.concat(F.lit("c"), (F.col("id") - 1).cast("string")))).otherwise(F.array().cast("array<string>"))
    calls = spark.range(n).select(F.lit(1).alias("conv_id"), F.concat(F.lit("c"), F.col("id").cast("string")).alias("call_id"), F.col("id").alias("turn"), after.alias("after"))
    out = C._positions(calls)
    assert {r["call_id"] for r in out.filter("cycle").collect()} == {"c7", "c9", "c11"} and len(rounds) <= 2
    assert out.filter("not cycle and (depth > 0 or concat('c', rank) <> call_id)").count() == 0 and out.count() == n


def test_many_rounds_keep_estimates_small(spark, monkeypatch):
    n, sizes, plain = 10, [], C.pin

    def pin(df):
        out = plain(df)
        sizes.append(out._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
        return out

    monkeypatch.setattr(C, "pin", pin)
    rows = [(1, k, f"c{k}", [f"c{k + 1}"]) for k in range(n)] + [(2, 0, "p", ["q"]), (2, 1, "q", ["p"]), (2, 2, "r", ["q"])]
    out = C._positions(spark.createDataFrame(rows, "conv_id long, turn long, call_id string, after array<string>")).collect()
    assert {(r["call_id"], r["rank"], r["depth"]) for r in out if r["conv_id"] == 1} == {(f"c{k}", n - 1, n - 1 - k) for k in range(n)}
    assert {(r["call_id"], r["rank"], r["depth"]) for r in out if r["cycle"]} == {("p", 0, 0), ("q", 1, 0), ("r", 2, 0)}
    assert len(sizes) > n and max(s.bit_length() for s in sizes) < 128  # an unknown table counts as 2**63 bytes


def test_query_reaches_every_case(spark):
    from tests.conftest import SF_MID
    from wearcast.llm.queries import REPLY, QUERIES, turns_as_calls
    out = QUERIES["op9_chat_formatting"](spark, SF_MID).collect()
    rows = [(r["conv_id"], r["turn"], r["role"], r["text"]) for r in turns_as_calls(spark.read.parquet(f"{SF_MID}/conversations.parquet")).collect()]
    got = sorted(((r["conv_id"], r["turn"], r["part"], r["status"], (r["rank"], r["depth"]), tuple(r["errors"]), r["json"]) for r in out), key=str)
    assert got == brute(rows, REPLY)
    assert {"linked", "cycle"} <= {r["status"] for r in out} and any(r["rank"] > r["turn"] for r in out)
    assert {"unknown tool", "$.turn: not integer"} <= {e for r in out for e in r["errors"]}


def test_canonical_form_and_schema():
    assert C.canonical({"b": [1, None], "a": "é"}) == '{"a":"é","b":[1,null]}'
    assert C.violations({"x": 1.0, "after": ["a", 1]}, SCHEMAS["add"]) == ["$.after[1]: not string"]
    assert C.violations({}, SCHEMAS["add"]) == ["$.x: missing"]
    assert C.events_of(0, "assistant", call("a", "nope"), SCHEMAS)[0]["errors"] == ["not an object"]


def test_edge_rows(spark, tmp_path):
    df = spark.createDataFrame([(None, None, None, None), (None, 1, "tool", result("a")), (1, 0, "assistant", call(None, {"x": 1})), (1, 1, "tool", "{" * 5000), (1, 2, "user", "w" * 100_000),
                                (1, 3, "assistant", call("a", {"x": 1})), (1, 3, "assistant", call("a", {"x": 1}))], "conv_id long, turn long, role string, text string")
    out = C.format_chats(df, SCHEMAS)
    assert out.count() == 7 and C.format_chats(df.limit(0), SCHEMAS).count() == 0
    C.write_chats(out, str(tmp_path / "chats"), 3)
    lines = [json.loads(r["value"]) for r in spark.read.text(str(tmp_path / "chats")).collect()]
    assert len(lines) == 7 and {x.get("conv_id") for x in lines} == {1, None}
