"""Chat formatting: tool calls linked with their results, ordered, validated, as canonical JSON.

Messages are rows (conv_id, turn, role, text). An assistant's text that is a
JSON object with ``tool_calls`` (each an id, a function name and arguments, as
an object or as JSON text) holds calls; a tool's text that is a JSON object with
``tool_call_id`` is a result; any other text is a plain message.

* Link: calls and results meet in a hash join on (conversation, identifier). The
  first call and the first result of an identifier belong together; further
  ones are marked as duplicates, results without a call as orphans, calls
  without a result as open.
* Order: a call comes after the calls whose identifiers its argument ``after``
  names, a result after its call; otherwise turns decide. Where a turn comes too
  early for what it depends on, it moves behind it: position (rank, depth) is
  (own turn, 0), or that of the latest dependency with depth + 1 if that is
  later, found by rounds over the dependencies that are still violated (none if
  the turns are in order already; else as many as the longest chain of calls that
  must move, or wait for a cycle). Calls that wait for themselves, or for such
  calls, are marked as a cycle and keep their turn; pointers to the dependency
  that moved a call, doubled, find them.
* Validate: arguments against the tool's schema (type, required, properties,
  additionalProperties, items, enum, minLength, minimum, maximum).
* Serialise: keys sorted, no spaces, UTF-8 as it is, one line an event.

The result is a row an event, ordered by (conv_id, rank, depth, turn, part), so a
conversation that holds a third of all rows is never gathered in one task.

Defined cases: null text is an empty message, null role ``unknown``; text that
is not JSON, or not of these shapes, is a plain message; arguments that are not
a JSON object fail validation (``not an object``), unknown tools too
(``unknown tool``); a null id links with nothing; null turns sort first and null
conversations form one of their own for order, but link nothing; repeated rows
give repeated events, the later ones marked duplicate (all but one of equal
rows); empty tables give empty results; extra columns are ignored.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wearcast.session import pin

EVENTS = "turn long, part int, kind string, call_id string, name string, after array<string>, errors array<string>, json string"
_TYPES = {"object": dict, "array": list, "string": str, "boolean": bool, "null": type(None)}


def canonical(value) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def _refuse(name):
    raise ValueError(f"{name} is not JSON")


def _json(text):
    try:
        value = json.loads(text, parse_constant=_refuse)
        canonical(value).encode()  # numbers out of range and lone surrogates have no canonical form
        return value
    except (ValueError, RecursionError):
        return None


def _is(value, kind: str) -> bool:
    if kind in ("integer", "number"):
        whole = isinstance(value, int) or isinstance(value, float) and value.is_integer()
        return not isinstance(value, bool) and (whole if kind == "integer" else isinstance(value, (int, float)))
    return isinstance(value, _TYPES[kind])


def violations(value, schema: dict, path: str = "$") -> list[str]:
    """What a value breaks of a schema, in a fixed order."""
    kinds = schema.get("type")
    kinds = [kinds] if isinstance(kinds, str) else kinds or []
    if kinds and not any(_is(value, k) for k in kinds):
        return [f"{path}: not {' or '.join(kinds)}"]
    out = []
    if "enum" in schema and not any(canonical(value) == canonical(x) for x in schema["enum"]):
        out.append(f"{path}: not one of the allowed")
    if isinstance(value, str) and len(value) < schema.get("minLength", 0):
        out.append(f"{path}: too short")
    if isinstance(value, (int, float)) and not isinstance(value, bool) and not schema.get("minimum", value) <= value <= schema.get("maximum", value):
        out.append(f"{path}: out of range")
    if isinstance(value, list) and "items" in schema:
        for i, x in enumerate(value):
            out += violations(x, schema["items"], f"{path}[{i}]")
    if isinstance(value, dict):
        known = schema.get("properties", {})
        out += [f"{path}.{k}: missing" for k in sorted(schema.get("required", [])) if k not in value]
        for k in sorted(value):
            if k in known:
                out += violations(value[k], known[k], f"{path}.{k}")
            elif schema.get("additionalProperties") is False:
                out.append(f"{path}.{k}: not allowed")
    return out


def events_of(turn: int | None, role: str | None, text: str | None, schemas: dict) -> list[dict]:
    """The events of one message."""
    role, text = role or "unknown", text or ""
    found = _json(text) if role in ("assistant", "tool") and text.lstrip().startswith("{") else None
    plain = [{"turn": turn, "part": 0, "kind": "message", "call_id": None, "name": None, "after": [], "errors": [],
              "json": canonical({"content": text, "role": role, "turn": turn})}]
    if not isinstance(found, dict):
        return plain
    if role == "tool" and isinstance(found.get("tool_call_id"), str):
        own = {"content": found.get("content"), "id": found["tool_call_id"], "role": "tool", "turn": turn}
        return [{"turn": turn, "part": 0, "kind": "result", "call_id": own["id"], "name": None, "after": [], "errors": [], "json": canonical(own)}]
    calls = found.get("tool_calls")
    if role != "assistant" or not isinstance(calls, list) or not calls or not all(isinstance(c, dict) and isinstance(c.get("function"), dict) for c in calls):
        return plain
    out = []
    for part, call in enumerate(calls):
        name, args = call["function"].get("name"), call["function"].get("arguments")
        args = _json(args) if isinstance(args, str) else args
        name = name if isinstance(name, str) else None
        own_id = call.get("id") if isinstance(call.get("id"), str) else None
        if not isinstance(args, dict):
            errors = ["not an object"]
        elif name not in schemas:
            errors = ["unknown tool"]
        else:
            errors = violations(args, schemas[name])
        after = args.get("after") if isinstance(args, dict) else None
        after = sorted({x for x in after if isinstance(x, str)}) if isinstance(after, list) else []
        own = {"arguments": args, "id": own_id, "name": name, "role": "assistant", "turn": turn}
        out.append({"turn": turn, "part": part, "kind": "call", "call_id": own_id, "name": name, "after": after, "errors": errors, "json": canonical(own)})
    return out


def parse(messages: DataFrame, schemas: dict) -> DataFrame:
    """One row an event: conv_id and the columns of EVENTS."""
    own = messages.select("conv_id", F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    kind = pa.schema([("turn", pa.int64()), ("part", pa.int32()), ("kind", pa.string()), ("call_id", pa.string()), ("name", pa.string()),
                      ("after", pa.list_(pa.string())), ("errors", pa.list_(pa.string())), ("json", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [events_of(*row, schemas) for row in zip(*(b.column(c).to_pylist() for c in ("turn", "role", "text")))]
            of = pa.array([i for i, x in enumerate(found) for _ in x], pa.int64())
            rows = pa.RecordBatch.from_pylist([e for x in found for e in x], kind)
            yield pa.record_batch([b.column("conv_id").take(of), *rows.columns], ["conv_id", *kind.names])

    return own.mapInArrow(run, f"conv_id {own.schema['conv_id'].dataType.simpleString()}, {EVENTS}")


def _once(df: DataFrame, *key: str) -> DataFrame:
    """Rows whose ``key`` is unique already, said so to Spark.

    A join with them is then taken to be as large as its other side. Otherwise it is taken for the product of both, and in a
    loop, where every frame comes from the one before, the estimate itself doubles its digits a round until it fills the driver.
    """
    return df.dropDuplicates(list(key))


def _looped(place: DataFrame) -> DataFrame:
    """conv_id, call_id of the calls whose chain of latest dependencies never ends.

    Each call points to the dependency that set its position, if one did. Pointers double: after k steps a pointer skips
    2**k calls, and whoever still has one has at least so many before it. A chain that ends holds calls with any smaller
    number before them, so some of it drop out with every step; when none does, all that are left wait for themselves or
    for such calls.
    """
    at = pin(place.filter("by is not null").select("conv_id", "call_id", "by"))
    n, before = at.count(), None
    while n and n != before:
        onward = _once(at.select("conv_id", F.col("call_id").alias("by"), F.col("by").alias("next")), "conv_id", "by")
        at = pin(at.join(onward, ["conv_id", "by"]).select("conv_id", "call_id", F.col("next").alias("by")))
        n, before = at.count(), n
    return at.select("conv_id", "call_id")


def _positions(calls: DataFrame) -> DataFrame:
    """conv_id, call_id, rank, depth, cycle of each identifier's first call.

    Rounds move the calls that come too early; every time the number of rounds has doubled, calls that wait for themselves
    are looked for among the moved ones and taken out, so that a cycle costs rounds by its length, not by the calls around it.
    """
    nodes = calls.groupBy("conv_id", "call_id").agg(F.min("turn").alias("turn"))
    edges = calls.select("conv_id", "call_id", F.explode("after").alias("dep")).distinct()
    edges = pin(edges.join(nodes.select("conv_id", F.col("call_id").alias("dep")), ["conv_id", "dep"]))  # what nobody calls is not waited for
    start = F.struct(F.col("turn").alias("rank"), F.lit(0).cast("long").alias("depth"))
    place = pin(nodes.select("conv_id", "call_id", F.col("turn").alias("own"), start.alias("at"), F.lit(None).cast("string").alias("by"), F.lit(False).alias("cycle")))
    rounds, look = 0, 2
    while True:
        dep = _once(place.select("conv_id", F.col("call_id").alias("dep"), F.col("at").alias("dep_at"), F.col("cycle").alias("dep_cycle")), "conv_id", "dep")
        late = edges.join(dep, ["conv_id", "dep"]).join(_once(place, "conv_id", "call_id"), ["conv_id", "call_id"]).filter("not cycle and (dep_cycle or at <= dep_at)") \
            .groupBy("conv_id", "call_id").agg(F.max(F.struct("dep_at", "dep")).alias("m"), F.max("dep_cycle").alias("stuck")) \
            .select("conv_id", "call_id", F.struct(F.col("m.dep_at.rank").alias("rank"), (F.col("m.dep_at.depth") + 1).alias("depth")).alias("new"), F.col("m.dep").alias("new_by"), "stuck")
        late = pin(late)
        if late.isEmpty():
            return place.select("conv_id", "call_id", "at.rank", "at.depth", "cycle")
        place = pin(_moved(place.join(_once(late, "conv_id", "call_id"), ["conv_id", "call_id"], "left")))
        rounds += 1
        if rounds == look:
            look *= 2
            stuck = _looped(place).select("conv_id", "call_id", F.lit(True).alias("stuck"), F.lit(None).cast("struct<rank:bigint,depth:bigint>").alias("new"),
                                                 F.lit(None).cast("string").alias("new_by"))
            place = pin(_moved(place.join(_once(stuck, "conv_id", "call_id"), ["conv_id", "call_id"], "left")))


def _moved(place: DataFrame) -> DataFrame:
    """Positions after a round: ``new`` where there is one; calls of a cycle go back to their turn."""
    stuck = F.coalesce("stuck", F.lit(False))
    at = F.when(stuck, F.struct(F.col("own").alias("rank"), F.lit(0).cast("long").alias("depth"))).otherwise(F.coalesce("new", "at"))
    return place.select("conv_id", "call_id", "own", at.alias("at"), F.when(~stuck, F.coalesce("new_by", "by")).alias("by"), (F.col("cycle") | stuck).alias("cycle"))


def format_chats(messages: DataFrame, schemas: dict) -> DataFrame:
    """conv_id, turn, part, kind, call_id, status, errors, rank, depth, json; see the module's text.

    ``status``: message, linked, open, orphan, duplicate, cycle.
    """
    events = pin(parse(messages, schemas))
    key = ["conv_id", "call_id"]
    calls, results = (events.filter((F.col("kind") == k) & F.col("call_id").isNotNull() & F.col("conv_id").isNotNull()) for k in ("call", "result"))
    spot = F.struct("turn", "part", "json")
    first_call = calls.groupBy(*key).agg(F.min(spot).alias("c"), F.count(F.lit(1)).alias("n_calls"))
    first_result = results.groupBy(*key).agg(F.min(spot).alias("r"), F.count(F.lit(1)).alias("n_results"))
    links = first_call.join(first_result.hint("shuffle_hash"), key, "full").join(_positions(calls), key, "left")
    out = events.join(links.hint("shuffle_hash"), key, "left")
    own, is_call = F.struct("turn", "part", "json"), F.col("kind") == "call"
    later = F.when(is_call, own != F.col("c")).otherwise(own != F.col("r"))
    status = F.when(F.col("kind") == "message", "message").when(~is_call & F.col("c").isNull(), "orphan").when(F.coalesce(later, F.lit(False)), "duplicate") \
        .when(is_call & F.coalesce("cycle", F.lit(False)), "cycle").when(is_call & F.col("r").isNull(), "open").otherwise("linked")
    out = out.withColumn("status", status)
    moved = F.col("status").isin("linked", "open") & F.col("rank").isNotNull()
    behind = moved & (~is_call) & (F.col("rank") >= F.col("turn"))
    rank = F.when(moved & is_call, F.col("rank")).when(behind, F.col("rank")).otherwise(F.col("turn"))
    depth = F.when(moved & is_call, 2 * F.col("depth")).when(behind, 2 * F.col("depth") + 1).otherwise(F.lit(0)).cast("long")
    return out.select("conv_id", "turn", "part", "kind", "call_id", "status", "errors", rank.alias("rank"), depth.alias("depth"), "json")


def write_chats(formatted: DataFrame, path: str, files: int) -> None:
    """The JSON lines, ordered over all files; a long conversation spreads over several."""
    keys = ["conv_id", "rank", "depth", "turn", "part"]
    owner = F.to_json(F.struct("conv_id"), {"ignoreNullFields": "false"})  # {"conv_id":...}
    formatted.repartitionByRange(files, *keys).sortWithinPartitions(*keys, "json") \
        .select(F.concat(owner.substr(F.lit(1), F.length(owner) - 1), F.lit(',"event":'), "json", F.lit("}")).alias("value")).write.text(path)
