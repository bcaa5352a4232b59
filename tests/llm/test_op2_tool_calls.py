import itertools
import json
import random

import pytest

from tessella.llm import tool_calls as C

WEATHER = {"weather": {"type": "object", "properties": {"city": {"type": "string", "minLength": 1}, "days": {"type": "integer", "minimum": 1, "maximum": 7}, "unit": {"enum": ["c", "f"]}, "at": {"type": "array", "items": {"type": "number"}, "maxItems": 2}}, "required": ["city"], "additionalProperties": False}}


@pytest.mark.parametrize(
    "arguments, errors",
    [
        ('{"city": "a", "days": 3, "unit": "c", "at": [1, 2.5]}', []),
        ('{"days": 0}', ["$.city: missing", "$.days: breaks minimum"]),
        ('{"city": "", "unit": "k", "x": 1}', ["$.city: breaks minLength", "$.unit: not one of the enum", "$.x: unknown"]),
        ('{"city": 5, "at": [true, 1, 2]}', ["$.at[0]: not of type number", "$.at: breaks maxItems", "$.city: not of type string"]),
        ('{"city": "a", "days": 1e400}', ["$: not JSON"]), ('{"city": "\\ud800"}', ["$: not JSON"]), ("[" * 100_000, ["$: not JSON"]), ('{"city": "a", "at": ' + "[" * 900 + "]" * 900 + "}", ["$.at[0]: not of type number"]),
        ("[1]", ["$: not of type object"]), ("{", ["$: not JSON"]), (None, ["$: not of type object"]), ('{"city": NaN}', ["$: not JSON"]),
    ],
)
def test_validation(arguments, errors):
    assert C.check_arguments("weather", arguments, WEATHER)[1] == errors


@pytest.mark.parametrize(
    "schema, good, bad",
    [
        ({"const": 1}, [1, 1.0], [2, "1", True]), ({"pattern": "^a+$"}, ["aa", 5], ["ab"]), ({"anyOf": [{"type": "string"}, {"minimum": 3}]}, ["x", 3], [2]),
        ({"oneOf": [{"type": "integer"}, {"minimum": 3}]}, [2, 3.5], [4, 1.5]), ({"allOf": [{"minimum": 1}, {"exclusiveMaximum": 2}]}, [1, 1.5], [0, 2]), ({"not": {"type": "null"}}, [0], [None]),
        ({"multipleOf": 0.1}, [0.3, 7], [0.35]), ({"exclusiveMinimum": 0}, [0.5], [0]), ({"uniqueItems": True}, [[1, 2]], [[1, 1.0]]), ({"minProperties": 1, "maxProperties": 1}, [{"a": 1}], [{}, {"a": 1, "b": 2}]),
        ({"properties": {"a": False}}, [{"b": 1}], [{"a": 1}]),
    ],
)
def test_keywords(schema, good, bad):
    C.check_schema(schema)
    assert all(not C.validate(v, schema) for v in good) and all(C.validate(v, schema) for v in bad)


@pytest.mark.parametrize("schema", [{"$ref": "#/x"}, {"properties": {"a": {"contains": {}}}}, {"type": "text"}, {"anyOf": [{"if": {}}]}])
def test_unknown_keywords_are_refused(schema):
    with pytest.raises(ValueError):
        C.check_schema(schema)


def test_numbers_of_equal_value_are_equal_text():
    assert C.canonical({"b": 1.0, "a": [-0.0, 1e3, 0.5, 10**25, 1e25]}) == '{"a":[0,1000,0.5,10000000000000000000000000,10000000000000000905969664],"b":1}'


def test_order_is_the_smallest_topological_one():
    r = random.Random(1)
    for _ in range(60):
        n = r.randrange(1, 6)
        calls = [{"call_id": f"c{i}", "turn": r.randrange(3), "depends": [f"c{j}" for j in range(n) if r.random() < 0.25] + ["gone"]} for i in range(n)]
        needs = {c["call_id"]: [d for d in c["depends"] if d != "gone"] for c in calls}
        got = [c["call_id"] for c, cycle in C.topological(calls) if not cycle]
        orders = [o for o in itertools.permutations(got) if all(o.index(d) < o.index(i) for i in o for d in needs[i] if d in o) and all(d in got for i in got for d in needs[i])]
        turn = {c["call_id"]: (c["turn"], c["call_id"]) for c in calls}
        assert got == list(min(orders, key=lambda o: [turn[i] for i in o])) if got else True
        assert len(C.topological(calls)) == n


def test_linking_marks_every_case(spark):
    calls = spark.createDataFrame([(1, "b", 3, "weather", '{"city": "x"}', ["a"]), (1, "a", 5, "weather", '{"days": 9}', None), (1, "a", 1, "weather", '{"city": "é"}', None), (1, "p", 0, "other", "{}", ["q"]), (1, "q", 0, "weather", "{", ["p"]), (2, "z", 1, None, None, []), (2, None, 2, "weather", '{"city": "a"}', ["z"]), (2, None, 2, "weather", '{"city": "b"}', []), (None, "a", 1, "weather", "{}", None)], C.CALLS)
    results = spark.createDataFrame([(1, "a", 2, "one"), (1, "a", 1, "zero"), (1, "lost", 4, None), (1, None, 9, "no id"), (1, None, 9, "nor this"), (1, "", 9, "empty"), (3, "b", 1, "alone")], C.RESULTS)
    messages = spark.createDataFrame([(1, 0, "user", 'say "hi"\n'), (1, 1, None, None), (4, 0, "user", ""), (4, 0, "user", "")], C.MESSAGES)
    got = {r.conv_id: r for r in C.format_chats(messages, calls, results, WEATHER).collect()}
    assert set(got) == {1, 2, 3, 4}
    chat = json.loads(got[1].chat)
    assert got[1].chat == C.canonical(chat)
    assert [(c["id"], c["status"], c.get("cycle", False)) for c in chat["calls"]] == [("a", "linked", False), ("b", "unanswered", False), ("p", "unanswered", True), ("q", "unanswered", True)]
    assert chat["calls"][0]["result"] == "zero" and chat["calls"][0]["repeated"] == 2 and chat["calls"][0]["arguments"] == {"city": "é"}
    assert [(o["id"], o["content"]) for o in chat["orphans"]] == [("lost", None), (None, "no id"), (None, "nor this"), ("", "empty")]
    assert (got[1].n_calls, got[1].n_linked, got[1].n_valid, got[1].n_orphans) == (4, 1, 2, 4)
    assert [(c["id"], c["status"], c["arguments"]) for c in json.loads(got[2].chat)["calls"]] == [("z", "unanswered", None), (None, "unanswered", {"city": "a"}), (None, "unanswered", {"city": "b"})]
    assert json.loads(got[4].chat)["messages"] == [{"role": "user", "text": ""}] * 2


def test_calls_in_messages(spark):
    made = json.dumps({"tool_calls": [{"id": "k", "name": "weather", "arguments": '{"city": "x"}', "depends_on": ["j"]}]})
    messages = spark.createDataFrame([(1, 0, "assistant", made), (1, 1, "tool", '{"tool_call_id": "k", "content": "sun"}'), (1, 2, "assistant", "plain"), (2, 0, None, None)], C.MESSAGES)
    calls, results = C.extract(messages)
    assert [(r.call_id, r.depends) for r in calls.collect()] == [("k", ["j"])]
    assert C.format_chats(messages, calls, results, WEATHER).where("conv_id = 1").first().n_valid == 1


def test_a_table_of_both_kinds_of_conversations(spark):
    made = json.dumps({"tool_calls": [{"id": "k", "name": "reply", "arguments": {"prompt": "x", "turn": 1}}, {"id": "l", "name": "none", "arguments": "{}", "depends_on": ["k"]}, {"name": "reply", "arguments": '{"prompt": "\\ud800"}'}]})
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", made), (1, 2, "tool", '{"tool_call_id": "k", "content": "sun"}'), (1, 3, "tool", '{"tool_call_id": null, "content": "lost"}'), (2, 1, "assistant", "b"), (2, 1, "user", "a"), (3, 0, "assistant", '{"tool_calls": broken')]
    got = {r.conv_id: r for r in C.format_conversations(spark.createDataFrame(rows, C.MESSAGES)).collect()}
    assert [tuple(got[k])[1:6] for k in (1, 2, 3)] == [(4, 3, 1, 1, 1), (2, 1, 1, 1, 0), (1, 0, 0, 0, 1)]
    chat = json.loads(got[1].chat)
    assert [(c["id"], c["errors"], c["result"]) for c in chat["calls"]] == [(None, ["$: not JSON"], None), ("k", [], "sun"), ("l", ["unknown tool"], None)]
    assert chat["orphans"] == [{"content": "lost", "id": None}]


def test_plain_conversations_with_further_columns_and_none(spark):
    rows = [(1, 0, "assistant", "early", "x"), (1, 1, "user", "a", None), (1, 2, "assistant", "b", "x"), (1, 3, "assistant", "c", "x"), (1, 4, "user", None, "x"), (None, 0, "user", "z", "x")]
    kind = "conv_id bigint, turn bigint, role string, text string, call_id string"
    got = C.format_conversations(spark.createDataFrame(rows, kind)).collect()
    assert [tuple(g)[:6] for g in got] == [(1, 5, 2, 1, 1, 1)]
    assert C.format_conversations(spark.createDataFrame([], kind)).count() == 0
