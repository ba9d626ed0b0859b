"""Chat formatting with linked tool calls.

An assistant's message may be JSON with ``tool_calls`` (id, name, arguments) and
``content``; a message of role ``tool`` is JSON with ``tool_call_id`` and ``content``.
Calls and results meet by (conversation, id) in a hash join; of several calls with one
id the first counts, of several results the first. An argument that is the string
``$id`` needs that call's result, which orders the calls of a conversation: level 1
needs none, each other call comes one level above the highest it needs; calls in a
circle, or that need one, have none. Arguments are checked against the tool's schema.
Every message and every call is one row of canonical JSON (sorted keys, no spaces), so a
conversation of any length is never gathered in one place.

Defined cases: null text is null content; text that is not such JSON is plain content;
a call without an id or with non-object arguments is invalid; a null conv_id or turn is
carried along and its calls link with nothing; rows that repeat are formatted each;
an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, written

#: Tables of settled calls that are read together before they are written as one.
PARTS = 40
#: Bound of the lengths around circles, which would double without end; far above any number of calls.
LONGEST = 1 << 60
_TYPES = {
    "string": lambda v: isinstance(v, str),
    "integer": lambda v: isinstance(v, int) and not isinstance(v, bool),
    "number": lambda v: isinstance(v, int | float) and not isinstance(v, bool),
    "boolean": lambda v: isinstance(v, bool),
    "array": lambda v: isinstance(v, list),
    "object": lambda v: isinstance(v, dict),
    "null": lambda v: v is None,
}
_PARSED = "conv_id long, turn long, role string, kind string, pos int, id string, name string, body string, needs array<string>, error string"


def canonical(value: object) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def violation(value: object, schema: dict, where: str = "arguments") -> str | None:
    """The first way in which ``value`` breaks a schema (type, enum, required, properties, additionalProperties, items)."""
    kinds = schema.get("type")
    kinds = [kinds] if isinstance(kinds, str) else kinds
    reference = isinstance(value, str) and value.startswith("$")
    if kinds and not reference and not any(_TYPES[k](value) for k in kinds):
        return f"{where}: not {'/'.join(kinds)}"
    if "enum" in schema and value not in schema["enum"]:
        return f"{where}: not allowed"
    if isinstance(value, dict):
        known = schema.get("properties", {})
        for k in sorted(schema.get("required", [])):
            if k not in value:
                return f"{where}.{k}: missing"
        for k in sorted(value):
            if k in known:
                if bad := violation(value[k], known[k], f"{where}.{k}"):
                    return bad
            elif schema.get("additionalProperties") is False:
                return f"{where}.{k}: unknown"
    if isinstance(value, list) and "items" in schema:
        for i, x in enumerate(value):
            if bad := violation(x, schema["items"], f"{where}[{i}]"):
                return bad
    return None


def references(value: object) -> list[str]:
    """Ids of the calls whose results ``value`` needs."""
    if isinstance(value, str):
        return [value[1:]] if value.startswith("$") and len(value) > 1 else []
    parts = value.values() if isinstance(value, dict) else value if isinstance(value, list) else []
    return sorted({r for x in parts for r in references(x)})


def _object(text: str | None) -> dict:
    if not text or not text.lstrip().startswith("{"):
        return {}
    try:
        got = json.loads(text)
    except ValueError:
        return {}
    return got if isinstance(got, dict) else {}


def parse_message(role: str | None, text: str | None, schemas: dict[str, dict]) -> list[tuple]:
    """(kind, pos, id, name, body, needs, error) of a message and its calls."""
    got = _object(text)
    if role == "tool" and "tool_call_id" in got:
        body = canonical({"content": got.get("content"), "role": "tool", "tool_call_id": str(got["tool_call_id"])})
        return [("result", 0, str(got["tool_call_id"]), None, body, [], None)]
    calls = got.get("tool_calls")
    if role != "assistant" or not isinstance(calls, list):
        return [("message", 0, None, None, canonical({"content": text, "role": role}), [], None)]
    out, ids = [], []
    for pos, c in enumerate(calls):
        c = c if isinstance(c, dict) else {}
        own = None if c.get("id") is None else str(c["id"])
        name, args = c.get("name"), c.get("arguments", {})
        if isinstance(args, str):
            args = _object(args) if args.strip() else {}
        ids.append(own)
        error = "no id" if own is None else None
        if not isinstance(name, str) or name not in schemas:
            error = error or ("no name" if not isinstance(name, str) else "unknown tool" if schemas else None)
        elif isinstance(args, dict):
            error = error or violation(args, schemas[name])
        if not isinstance(args, dict):
            error = error or "arguments: not object"
        body = canonical({"arguments": args, "id": own, "name": name})
        out.append(("call", pos, own, name if isinstance(name, str) else None, body, references(args), error))
    message = canonical({"content": got.get("content"), "role": role, "tool_calls": ids})
    return [("message", 0, None, None, message, [], None), *out]


def parsed(conversations: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv_id", "turn", "role", "kind", "pos", "id", "name", "body", "needs", "error"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.list_(pa.string()), pa.string()]
        for b in batches:
            rows = [(*r[:3], *x) for r in zip(*(c.to_pylist() for c in b.columns), strict=True) for x in parse_message(r[2], r[3], schemas)]
            cols = list(zip(*rows, strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)

    base = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string"))
    return base.mapInArrow(run, _PARSED)


def _levels(calls: DataFrame) -> DataFrame:
    """conv_id, id and level of the calls that no circle holds up.

    A round settles the calls whose needs are all settled, and lets each need of a call
    with one need left jump to that one (its level is the larger of a number and the
    other's level plus a length, and such functions compose), so chains halve each round.
    """
    every = calls.select("conv_id", "id")
    needs = calls.select("conv_id", "id", F.explode(F.array_distinct("needs")).alias("need"))
    there = every.select("conv_id", F.col("id").alias("need"))
    needs = needs.join(there, ["conv_id", "need"], "left_semi")  # of ids that no call has, none can be waited for
    #  ``length``: levels above the need; ``least``: the level that settled needs ask for.
    edges = written(needs.select("conv_id", "id", "need", F.lit(1).cast("long").alias("length"), F.lit(1).cast("long").alias("least")), "needs")
    settled = written(every.join(edges.select("conv_id", "id").distinct(), ["conv_id", "id"], "left_anti").withColumn("level", F.lit(1).cast("long")), "levels")
    parts = [settled]
    while edges.limit(1).count() and settled.limit(1).count():
        known = settled.select("conv_id", F.col("id").alias("need"), F.lit(None).cast("string").alias("to"), F.lit(0).cast("long").alias("more"), F.col("level").alias("at"))
        single = edges.groupBy("conv_id", "id").agg(F.count("*").alias("n"), F.min("need").alias("to"), F.min("length").alias("more"), F.max("least").alias("at")).where("n = 1")
        #  A need that is settled just now is taken in first, as nothing could meet it later.
        single = single.join(settled.select("conv_id", F.col("id").alias("to")), ["conv_id", "to"], "left_anti")
        known = known.union(single.select("conv_id", F.col("id").alias("need"), "to", "more", "at"))
        met = edges.join(known, ["conv_id", "need"], "left")
        least = F.greatest("least", F.when(F.col("at").isNotNull(), F.least(F.col("at") + F.col("length"), F.lit(LONGEST))))
        on = F.when(F.col("at").isNull(), F.col("need")).otherwise(F.col("to"))
        met = met.select("conv_id", "id", on.alias("need"), F.least(F.col("length") + F.coalesce("more", F.lit(0)), F.lit(LONGEST)).alias("length"), least.alias("least"))
        met = written(met.groupBy("conv_id", "id", "need").agg(F.max("length").alias("length"), F.max("least").alias("least")), "met")
        of = met.groupBy("conv_id", "id").agg(F.max("least").alias("level"), F.count("need").alias("left"))
        of = written(of, "rounds")
        settled = written(of.where("left = 0").select("conv_id", "id", "level"), "levels")
        rest = met.where("need is not null").join(of.where("left > 0").select("conv_id", "id", "level"), ["conv_id", "id"])
        nxt = written(rest.select("conv_id", "id", "need", "length", F.col("level").alias("least")), "needs")
        dropped(edges), dropped(met), dropped(of)
        edges = nxt
        parts.append(settled)
        if len(parts) > PARTS:
            parts = [written(reduce(DataFrame.union, parts), "levels")]
    return reduce(DataFrame.union, parts)


def linked(conversations: DataFrame, schemas: dict[str, dict] | None = None) -> DataFrame:
    """One row per message and per call: conv_id, turn, role, kind, pos, call_id, level, linked, error and json."""
    rows = written(parsed(conversations, schemas or {}), "messages")
    same = ["conv_id", "id"]
    order = F.struct("turn", "pos", "body")
    calls = rows.where("kind = 'call' and id is not null and conv_id is not null and turn is not null")
    first = calls.groupBy(*same).agg(F.min(F.struct("turn", "pos", "body", "needs")).alias("c"))
    first = first.select(*same, F.struct("c.turn", "c.pos", "c.body").alias("first"), F.col("c.needs").alias("needs"))
    first = written(first, "calls")
    results = rows.where("kind = 'result' and conv_id is not null and turn is not null").groupBy(*same).agg(F.min(F.struct("turn", "body")).alias("r"))
    known = first.join(_levels(first), same, "left").join(results, same, "left")
    known = known.select(*same, "first", "level", "r").withColumn("hit", F.lit(True))
    #  Bodies may be long, so the tables shuffle; rows without an id have nothing to meet and stay where they are.
    meets = F.col("id").isNotNull() & F.col("conv_id").isNotNull()
    known = written(known, "linked")
    out = rows.where(meets).join(known, same, "left")
    out = out.unionByName(rows.where(~meets), allowMissingColumns=True)
    own = (F.col("kind") == "call") & (order == F.col("first"))
    result = F.when(own & (F.col("r.turn") > F.col("turn")), F.col("r.body"))
    error = F.when(F.col("kind") != "call", None).otherwise(F.coalesce("error", F.when(F.col("id").isNotNull() & F.col("conv_id").isNotNull() & ~F.coalesce(own, F.lit(False)), "id repeats"), F.when(own & F.col("level").isNull(), "circular")))
    done = F.when(F.col("kind") == "call", result.isNotNull()).when(F.col("kind") == "result", F.coalesce(F.col("hit") & (F.col("turn") > F.col("first.turn")), F.lit(False)))
    body = F.when(result.isNotNull(), F.concat(F.lit('{"call":'), F.col("body"), F.lit(',"result":'), result, F.lit("}"))).otherwise(F.col("body"))
    return out.select("conv_id", "turn", "role", "kind", F.col("pos").cast("long").alias("pos"), F.col("id").alias("call_id"), F.when(own, F.col("level")).alias("level"), done.alias("linked"), error.alias("error"), body.alias("json"))
