"""Chat formatting with linked tool calls.

Calls and results are joined by hash on (conversation, call identifier); each call's
arguments are validated against its tool's JSON schema; a conversation's calls are put
in topological order of what they depend on (smaller turn, then smaller identifier, first
among those that are ready); and each conversation is serialised as canonical JSON: keys
sorted, no blanks, UTF-8, numbers of equal value as equal text (integral ones without
fraction or exponent). Schemas that hold other keywords than those known here are refused.

Messages that carry calls or results as JSON are read as such; a conversation without any
is seen as calls of `reply` (see `as_calls`).

Cases: a call without a result is `unanswered`; a result without a call is an orphan and
listed apart; calls and results with a null identifier link to nothing, each is listed on
its own; of several calls or results with one identifier the one of the smallest (turn,
text) counts and the others are counted as `repeated`; calls in a cycle of dependencies
follow all others in order of turn and are marked `cycle`; dependencies on unknown calls
are ignored; arguments that are null, no JSON, no object, nested too deep, or that hold
NaN, numbers beyond double precision's range or lone surrogates give an error and stay as
text, as an unknown tool gives one; of keys that an object repeats the last counts; null
texts of messages stay null and texts stay whole, however long; messages of equal turns
go by role (user, tool, assistant), then text; rows with a null conversation are left
out; repeated messages stay; empty tables give no rows; further columns are ignored.
"""

from __future__ import annotations

import heapq
import json
import math
import re
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

CALLS = "conv_id bigint, call_id string, turn bigint, name string, arguments string, depends array<string>"
RESULTS = "conv_id bigint, call_id string, turn bigint, content string"
MESSAGES = "conv_id bigint, turn bigint, role string, text string"

#: Tools and the schemas of their arguments.
TOOLS = {"reply": {"type": "object", "properties": {"prompt": {"type": "string", "minLength": 1}, "turn": {"type": "integer", "minimum": 0}}, "required": ["prompt", "turn"], "additionalProperties": False}}

_KINDS = {"object": dict, "array": list, "string": str, "boolean": bool, "null": type(None)}


def _plain(value: Any) -> Any:
    """Integral numbers as integers, all through a value."""
    if isinstance(value, float):
        return int(value) if value.is_integer() else value
    if isinstance(value, dict):
        return {k: _plain(v) for k, v in value.items()}
    return [_plain(v) for v in value] if isinstance(value, list) else value


def canonical(value: Any) -> str:
    return json.dumps(_plain(value), sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def _is(value: Any, kind: str) -> bool:
    if kind == "integer":
        return not isinstance(value, bool) and (isinstance(value, int) or isinstance(value, float) and value.is_integer())
    if kind == "number":
        return isinstance(value, (int, float)) and not isinstance(value, bool)
    return isinstance(value, _KINDS[kind])


_BOUNDS = [
    ("minLength", str, lambda v, b: len(v) >= b), ("maxLength", str, lambda v, b: len(v) <= b), ("pattern", str, lambda v, b: re.search(b, v) is not None),
    ("minItems", list, lambda v, b: len(v) >= b), ("maxItems", list, lambda v, b: len(v) <= b), ("uniqueItems", list, lambda v, b: not b or len({canonical(x) for x in v}) == len(v)),
    ("minProperties", dict, lambda v, b: len(v) >= b), ("maxProperties", dict, lambda v, b: len(v) <= b),
    ("minimum", float, lambda v, b: v >= b), ("maximum", float, lambda v, b: v <= b), ("exclusiveMinimum", float, lambda v, b: v > b), ("exclusiveMaximum", float, lambda v, b: v < b),
    ("multipleOf", float, lambda v, b: v % b == 0 if isinstance(v, int) and isinstance(b, int) else math.isclose(v / b, round(v / b), rel_tol=1e-12, abs_tol=1e-12)),
]
_ONE, _MANY, _NAMED = ("items", "additionalProperties", "not"), ("anyOf", "allOf", "oneOf"), ("properties",)
_KEYWORDS = {"type", "enum", "const", "required", *_ONE, *_MANY, *_NAMED, *(k for k, _, _ in _BOUNDS), "title", "description", "default", "examples", "$schema", "$comment"}


def check_schema(schema: Any, path: str = "$") -> None:
    """Refuses a schema with keywords or types that `validate` doesn't know."""
    if isinstance(schema, bool):
        return
    if unknown := sorted(set(schema) - _KEYWORDS):
        raise ValueError(f"schema {path}: {', '.join(unknown)} not supported")
    kinds = schema.get("type", [])
    if bad := sorted(set([kinds] if isinstance(kinds, str) else kinds) - {*_KINDS, "integer", "number"}):
        raise ValueError(f"schema {path}: types {', '.join(bad)} not known")
    re.compile(schema.get("pattern", ""))
    for k, x in [(k, schema[k]) for k in _ONE if k in schema] + [(f"{k}[{i}]", x) for k in _MANY for i, x in enumerate(schema.get(k, []))] + [(n, x) for k in _NAMED for n, x in schema.get(k, {}).items()]:
        check_schema(x, f"{path}.{k}")


def validate(value: Any, schema: Any, path: str = "$") -> list[str]:
    """What is wrong with a value, by path."""
    if isinstance(schema, bool):
        return [] if schema else [f"{path}: unknown"]
    kinds = schema.get("type")
    if kinds is not None and not any(_is(value, k) for k in ([kinds] if isinstance(kinds, str) else kinds)):
        return [f"{path}: not of type {kinds if isinstance(kinds, str) else '|'.join(kinds)}"]
    errors = []
    if "enum" in schema and not any(canonical(value) == canonical(e) for e in schema["enum"]):
        errors.append(f"{path}: not one of the enum")
    if "const" in schema and canonical(value) != canonical(schema["const"]):
        errors.append(f"{path}: not the constant")
    if isinstance(value, dict):
        known = schema.get("properties", {})
        errors += [f"{path}.{k}: missing" for k in sorted(schema.get("required", [])) if k not in value]
        for k in sorted(value):
            errors += validate(value[k], known.get(k, schema.get("additionalProperties", True)), f"{path}.{k}")
    elif isinstance(value, list) and "items" in schema:
        for i, x in enumerate(value):
            errors += validate(x, schema["items"], f"{path}[{i}]")
    for key, kind, good in _BOUNDS:
        if key in schema and (_is(value, "number") if kind is float else isinstance(value, kind)) and not good(value, schema[key]):
            errors.append(f"{path}: breaks {key}")
    for x in schema.get("allOf", []):
        errors += validate(value, x, path)
    fits = lambda k: sum(not validate(value, x, path) for x in schema[k])
    if "anyOf" in schema and not fits("anyOf"):
        errors.append(f"{path}: breaks anyOf")
    if "oneOf" in schema and fits("oneOf") != 1:
        errors.append(f"{path}: breaks oneOf")
    if "not" in schema and not validate(value, schema["not"], path):
        errors.append(f"{path}: breaks not")
    return errors


def _refuse(name: str) -> None:
    raise ValueError(name)


def _finite(digits: str) -> float:
    value = float(digits)
    return value if math.isfinite(value) else _refuse(digits)


def check_arguments(name: str | None, arguments: str | None, tools: dict[str, dict]) -> tuple[Any, list[str]]:
    """The parsed arguments (their text where they can't be parsed) and what is wrong with them."""
    try:
        value = json.loads(arguments, parse_constant=_refuse, parse_float=_finite) if arguments is not None else None
        canonical([[[[value]]]]).encode()  # what a chat can't hold is refused here: lone surrogates, and nesting too deep
        if name not in tools:
            return value, ["unknown tool"]
        if not isinstance(value, dict):
            return value, ["$: not of type object"]
        return value, validate(value, tools[name])
    except (ValueError, RecursionError):
        return arguments, ["$: not JSON"]


def topological(calls: list[dict]) -> list[tuple[dict, bool]]:
    """Calls in order of their dependencies; True for those in or behind a cycle, which come last in order of turn."""
    calls = sorted(calls, key=lambda c: (c["turn"] if c["turn"] is not None else -1, c["call_id"] is not None, c["call_id"] or "", c.get("name") or "", c.get("arguments") or ""))
    of = {c["call_id"]: k for k, c in enumerate(calls) if c["call_id"] is not None}
    needs = [{of[d] for d in c["depends"] or () if d in of} for c in calls]
    needed: dict[int, list[int]] = {}
    for k, ds in enumerate(needs):
        for d in ds:
            needed.setdefault(d, []).append(k)
    left = [len(ds) for ds in needs]
    ready = [k for k, n in enumerate(left) if not n]
    out, done = [], set()
    while ready:
        k = heapq.heappop(ready)
        done.add(k)
        out.append((calls[k], False))
        for j in needed.get(k, ()):
            left[j] -= 1
            if not left[j]:
                heapq.heappush(ready, j)
    return out + [(c, True) for k, c in enumerate(calls) if k not in done]


def link(calls: DataFrame, results: DataFrame) -> DataFrame:
    """Calls joined with their results: one row for each (conv_id, call_id) of either side, and for each without call_id."""
    made = calls.where("conv_id is not null").select("conv_id", "call_id", F.struct("turn", "arguments", "name", "depends").alias("c"))
    got = results.where("conv_id is not null").select("conv_id", "call_id", F.struct("turn", "content").alias("r"))
    left, right = (df.where("call_id is not null").groupBy("conv_id", "call_id").agg(F.min(x).alias(x), F.count("*").alias(n)) for df, x, n in ((made, "c", "n_calls"), (got, "r", "n_results")))
    joined = left.hint("shuffle_hash").join(right, ["conv_id", "call_id"], "full_outer")
    for df in (made, got):
        joined = joined.unionByName(df.where("call_id is null"), allowMissingColumns=True)
    status = F.when(F.col("c").isNull(), "orphan").when(F.col("r").isNull(), "unanswered").otherwise("linked")
    repeated = F.coalesce(F.col("n_calls") - 1, F.lit(0)) + F.coalesce(F.col("n_results") - 1, F.lit(0))
    return joined.select("conv_id", "call_id", F.col("c.turn").alias("turn"), F.col("c.name").alias("name"), F.col("c.arguments").alias("arguments"), F.col("c.depends").alias("depends"), F.col("r.turn").alias("result_turn"), F.col("r.content").alias("content"), status.alias("status"), repeated.alias("repeated"))


def format_chats(messages: DataFrame, calls: DataFrame, results: DataFrame, tools: dict[str, dict] | None = None) -> DataFrame:
    """(conv_id, n_messages, n_calls, n_linked, n_valid, n_orphans, chat) of every conversation that has a message, call or result."""
    tools = TOOLS if tools is None else tools
    for name, schema in tools.items():
        check_schema(schema, name)
    linked = link(calls, results).groupBy("conv_id").agg(F.collect_list(F.struct("call_id", "turn", "name", "arguments", "depends", "result_turn", "content", "status", "repeated")).alias("calls"))
    said = messages.where("conv_id is not null").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("messages"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for conv, said, calls in zip(*(batch.column(i).to_pylist() for i in range(3))):
                out, orphans, valid, answered = [], [], 0, 0
                for c, cycle in topological([c for c in calls or () if c["status"] != "orphan"]):
                    value, errors = check_arguments(c["name"], c["arguments"], tools)
                    valid += not errors
                    answered += c["status"] == "linked"
                    call = {"arguments": value, "errors": errors, "id": c["call_id"], "name": c["name"], "result": c["content"], "status": c["status"]}
                    if cycle:
                        call["cycle"] = True
                    if c["repeated"]:
                        call["repeated"] = c["repeated"]
                    out.append(call)
                for c in sorted((c for c in calls or () if c["status"] == "orphan"), key=lambda c: (c["result_turn"] if c["result_turn"] is not None else -1, c["call_id"] is not None, c["call_id"] or "", c["content"] or "")):
                    orphans.append({"content": c["content"], "id": c["call_id"]} | ({"repeated": c["repeated"]} if c["repeated"] else {}))
                chat = {"calls": out, "conversation": conv, "messages": [{"role": m["role"], "text": m["text"]} for m in said or ()], "orphans": orphans}
                rows.append((conv, len(said or ()), len(out), answered, valid, len(orphans), canonical(chat)))
            cols = list(zip(*rows)) or [()] * 7
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:6]), pa.array(cols[6], pa.string())], names=["conv_id", "n_messages", "n_calls", "n_linked", "n_valid", "n_orphans", "chat"])

    return said.join(linked, "conv_id", "full_outer").select("conv_id", "messages", "calls").mapInArrow(run, "conv_id bigint, n_messages bigint, n_calls bigint, n_linked bigint, n_valid bigint, n_orphans bigint, chat string")


_CALLS_IN = "tool_calls array<struct<id: string, name: string, arguments: string, depends_on: array<string>>>"
_RESULT_IN = "tool_call_id string, content string"


def _carried(messages: DataFrame) -> DataFrame:
    """With `made` and `got`: the calls and the result that a message carries, null for most."""
    made = F.when((F.col("role") == "assistant") & F.col("text").contains('"tool_calls"'), F.from_json("text", _CALLS_IN)["tool_calls"])
    got = F.when((F.col("role") == "tool") & F.col("text").contains('"tool_call_id"'), F.from_json("text", _RESULT_IN))
    return messages.select("*", made.alias("made"), got.alias("got"))


def extract(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results that messages carry as JSON: {"tool_calls": [{"id", "name", "arguments", "depends_on"}]} of an assistant,
    {"tool_call_id", "content"} of a tool. Other texts carry none."""
    carried = messages if "made" in messages.columns else _carried(messages)
    made = carried.select("conv_id", "turn", F.explode("made").alias("c")).selectExpr("conv_id", "c.id call_id", "turn", "c.name name", "c.arguments arguments", "c.depends_on depends")
    return made, carried.where("got is not null").selectExpr("conv_id", "got.tool_call_id call_id", "turn", "got.content content")


def as_calls(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A plain conversation seen as calls: a user's turn calls `reply`, and depends on the user's turn before; what the
    assistant says next is the result."""
    order = Window.partitionBy("conv_id").orderBy("turn", F.desc("role"), "text")
    asked = messages.where("role = 'user'").select("conv_id", "turn", "text", F.lag("turn").over(order).alias("before"))
    call = lambda c: F.concat(F.lit("call-"), c)
    calls = asked.select("conv_id", call(F.col("turn").cast("string")).alias("call_id"), "turn", F.lit("reply").alias("name"), F.to_json(F.struct(F.col("text").alias("prompt"), "turn"), {"ignoreNullFields": "false"}).alias("arguments"), F.when(F.col("before").isNotNull(), F.array(call(F.col("before").cast("string")))).alias("depends"))
    latest = F.last_value(F.when(F.col("role") == "user", F.col("turn")), ignoreNulls=F.lit(True)).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    said = messages.select("conv_id", "turn", "role", "text", latest.alias("of")).where("role = 'assistant'")
    return calls, said.select("conv_id", call(F.coalesce(F.col("of").cast("string"), F.lit("none"))).alias("call_id"), "turn", F.col("text").alias("content"))


def format_conversations(table: DataFrame) -> DataFrame:
    """`format_chats` over a table (conv_id, turn, role, text): by the calls that its messages carry; conversations without any seen as calls."""
    messages = table.selectExpr("cast(conv_id as bigint) conv_id", "cast(turn as bigint) turn", "cast(role as string) role", "cast(text as string) text")
    carrying = F.max(F.col("made").isNotNull() | F.col("got").isNotNull()).over(Window.partitionBy("conv_id"))
    every = _carried(messages.where("conv_id is not null")).select("*", carrying.alias("carrying"))
    calls, results = (a.unionByName(b) for a, b in zip(extract(every.where("carrying")), as_calls(every.where("not carrying"))))
    return format_chats(messages, calls, results)


SQL = """
with t as (select conv_id, turn, role, text, last_value(case when role = 'user' then turn end ignore nulls) over (partition by conv_id order by turn nulls first, role desc nulls last, text nulls first rows between unbounded preceding and current row) as asked
           from conversations where conv_id is not null),
messages as (select conv_id, count(*) n_messages, string_agg('{"role":' || to_json(role) || ',"text":' || to_json(text) || '}', ',' order by turn, role, text) j from t group by conv_id),
results as (select conv_id, asked, count(*) n, arg_min(text, (turn, text)) result, min(turn) first from t where role = 'assistant' group by conv_id, asked),
joined as (select c.conv_id, c.turn, c.text, r.result, r.n from t c left join results r on r.conv_id = c.conv_id and r.asked = c.turn where c.role = 'user'),
calls as (select conv_id, count(*) n_calls, count(n) n_linked, count(*) filter (length(text) > 0 and turn >= 0) n_valid,
    string_agg('{"arguments":{"prompt":' || to_json(text) || ',"turn":' || turn || '},"errors":' || case when length(text) > 0 then '[]' else '["$.prompt: breaks minLength"]' end || ',"id":"call-' || turn || '","name":"reply",'
        || case when n > 1 then '"repeated":' || (n - 1) || ',' else '' end || '"result":' || case when n is null then 'null' else to_json(result) end || ',"status":"' || case when n is null then 'unanswered' else 'linked' end || '"}', ',' order by turn) j
    from joined group by conv_id),
orphans as (select conv_id, count(*) n, string_agg('{"content":' || to_json(result) || ',"id":"call-none"' || case when n > 1 then ',"repeated":' || (n - 1) else '' end || '}', ',') j from results where asked is null group by conv_id)
select m.conv_id, m.n_messages, coalesce(c.n_calls, 0) n_calls, coalesce(c.n_linked, 0) n_linked, coalesce(c.n_valid, 0) n_valid, coalesce(o.n, 0) n_orphans,
    '{"calls":[' || coalesce(c.j, '') || '],"conversation":' || m.conv_id || ',"messages":[' || m.j || '],"orphans":[' || coalesce(o.j, '') || ']}' chat
from messages m left join calls c on c.conv_id = m.conv_id left join orphans o on o.conv_id = m.conv_id"""
