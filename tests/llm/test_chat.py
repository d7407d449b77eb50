import json

import pytest

from tests.llm.conftest import SF
from veilframe.llm import chat as C
from veilframe.llm.queries import QUERIES

ROW = "conv_id long, turn long, role string, text string"
SCHEMA = {"f": {"type": "object", "required": ["x"], "additionalProperties": False, "properties": {"x": {"type": "integer", "minimum": 0}, "after": {"type": "string"}}}}


def call(i, **arguments):
    return json.dumps({"tool_call": {"id": i, "name": "f", "arguments": arguments}})


def answer(i, content):
    return json.dumps({"tool_result": {"id": i, "content": content}})


def test_query_round_trip(spark, table):
    rows = QUERIES["op4_chat_formatting"](spark, SF).collect()
    source = {}
    for r in table("conversations").collect():
        source.setdefault(r.conv_id, {})[r.turn] = (r.role, r.text)
    assert sorted(r.conv_id for r in rows) == sorted(source)
    for r in rows:
        whole, own = json.loads(r.chat), source[r.conv_id]
        assert C.canonical(whole) == r.chat
        users = sorted(t for t, (role, _) in own.items() if role == "user")
        assert [c["arguments"]["turn"] for c in whole["calls"]] == users and r.n_calls == len(users)
        for c in whole["calls"]:
            turn = c["arguments"]["turn"]
            assert c["valid"] and c["arguments"]["prompt"] == own[turn][1]
            reply = own.get(turn + 1, ("", ""))
            assert ("result" in c) == (reply[0] == "assistant") and c.get("result", reply[1]) == reply[1]
        assert [m["content"] for m in whole["messages"]] == [text for t, (role, text) in sorted(own.items()) if role not in ("user", "assistant")]


def test_order_validation_and_orphans(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "a", call("z", x=1, after="${m}")), (1, 2, "a", call("m", x=-1)), (1, 3, "tool", answer("m", {"b": 1, "a": "é"})),
            (1, 4, "tool", answer("m", "late")), (1, 5, "tool", answer("lost", 1)), (1, 6, "a", call("p", x=1, after="${q}")), (1, 7, "a", call("q", x=1, after="${p}")),
            (1, 8, "a", call("m", x=5)), (2, 0, "a", call("m", y=1)), (2, 1, "tool", answer("z", 1))]
    got = {r.conv_id: r for r in C.format_chats(spark.createDataFrame(rows, ROW), SCHEMA).collect()}
    whole = json.loads(got[1].chat)
    assert [c["id"] for c in whole["calls"]] == ["m", "z", "p", "q"]
    assert whole["calls"][0]["result"] == {"a": "é", "b": 1} and whole["calls"][0]["errors"] == ["$.x: out of range"]
    assert [(o["kind"], o["id"], o["turn"]) for o in whole["orphans"]] == [("result", "m", 4), ("result", "lost", 5), ("call", "m", 8)]
    assert (got[1].n_messages, got[1].n_calls, got[1].n_results, got[1].n_linked, got[1].n_invalid, got[1].n_cyclic) == (9, 5, 3, 1, 1, 2)
    assert json.loads(got[2].chat)["calls"][0]["errors"] == ["$.x: missing", "$.y: unknown"]
    assert (got[2].n_linked, got[2].n_results) == (0, 1)


def test_edges(spark):
    from pyspark.sql import functions as F

    rows = [(None, None, None, None), (None, 1, "user", "x"), (3, None, "user", "null turn"), (3, 0, "user", None), (4, 0, "a", '{"tool_call": 5'), (4, 1, "a", '{"tool_call": {"id": "k"}} tail'),
            (4, 2, "a", '{"tool_call": {"name": "no id"}}'), (5, 0, "a", "y"), (5, 0, "a", "y"), (6, 0, "a", "x" * 500_000)]
    df = spark.createDataFrame(rows, ROW).withColumn("kind", F.lit(1)).withColumn("key", F.lit(1)).withColumn("call_id", F.lit(1))
    got = C.format_chats(df, SCHEMA).collect()
    assert sorted((str(r.conv_id), r.n_messages) for r in got) == [("3", 2), ("4", 3), ("5", 1), ("6", 1), ("None", 1), ("None", 1)]
    assert [m["content"] for m in json.loads(next(r.chat for r in got if r.conv_id == 3))["messages"]] == ["null turn", ""]
    assert C.format_chats(spark.createDataFrame([], ROW), SCHEMA).collect() == []
    assert C.as_tool_log(df).count() == len(rows)


@pytest.mark.parametrize("value,schema,wrong", [
    (1, {"type": "integer"}, []), (True, {"type": "integer"}, ["$: not integer"]), ("a", {"enum": ["b"]}, ["$: not in enum"]),
    ([1, "x"], {"type": "array", "items": {"type": "number"}}, ["$[1]: not number"]), ({"a": {"b": 1}}, {"properties": {"a": {"required": ["c"]}}}, ["$.a.c: missing"]),
    ("", {"type": "string", "minLength": 1}, ["$: length"]), (7, {"maximum": 5}, ["$: out of range"]), (None, {"type": "null"}, [])])
def test_schema_errors(value, schema, wrong):
    assert C.errors(value, schema) == wrong


def test_topological_order_is_by_rank_among_the_ready():
    calls = {"a": ((3,), {"d"}), "b": ((1,), set()), "c": ((2,), {"a"}), "d": ((9,), {"gone"}), "e": ((0,), {"f"}), "f": ((5,), {"e"}), "g": ((4,), {"e"})}
    assert C.ordered(calls) == (["b", "d", "a", "c"], ["e", "g", "f"])


def strings(value):
    """All strings of a JSON value."""
    if isinstance(value, dict | list):
        return {x for v in (value.values() if isinstance(value, dict) else value) for x in strings(v)}
    return {value} if isinstance(value, str) else set()


def test_no_text_is_lost(spark):
    broken = ['{"tool_call": {"id": "b", "name": "f", "arguments": {"x": 01}}}', '{"tool_result": {"id": "b", "content": "tab\there"}}']
    texts = [("a", call("m", x=1)), ("tool", answer("m", "first")), ("tool", answer("m", "second")), ("a", call("m", x=77, after="again")), ("tool", answer("lost", "no call")),
             ("a", broken[0]), ("tool", broken[1]), ("a", '{"tool_call": {"id": "n", "name": "f", "arguments": {"x": 1}, "note": "beside"}}'),
             ("tool", '{"tool_result": {"id": "n", "content": 1, "content": 2}}'), ("user", "plain")]
    rows = [(1, i, role, text) for i, (role, text) in enumerate(texts)]
    row = C.format_chats(spark.createDataFrame(rows, ROW), SCHEMA).first()
    got = json.loads(row.chat)
    calls = {c["id"]: c for c in got["calls"]}
    assert calls["m"] == {"id": "m", "name": "f", "arguments": {"x": 1}, "valid": True, "result": "first"}  # nothing to add where all is said
    assert {t for _, t in texts[2:]} <= strings(got) and row.n_messages == len(texts)


def test_no_turn_of_the_query_is_lost(spark):
    rows = [(1, 0, "system", "rules"), (1, 1, "assistant", "after system"), (1, 2, "user", "question"), (1, 3, "assistant", "reply"), (1, 4, "assistant", "one more"),
            (1, 5, "assistant", "and more"), (1, 6, "user", "left"), (1, 6, "user", "said twice"), (1, 7, "assistant", "x1"), (1, 7, "assistant", "x2"), (1, None, "assistant", "no turn")]
    got = json.loads(C.format_chats(C.as_tool_log(spark.createDataFrame(rows, ROW)), C.SCHEMAS).first().chat)
    found = strings(got) | {v for o in got["orphans"] for v in strings(json.loads(o["text"]))}
    assert {r[3] for r in rows} <= found


def test_values_that_are_no_json_are_kept_as_text(spark):
    def strict(text):
        return json.loads(text, parse_constant=lambda x: pytest.fail(x))

    deep = lambda n: '{"tool_call": {"id": "k", "name": "f", "arguments": ' + "[" * n + "]" * n + "}}"
    texts = [deep(990), deep(100_000), '{"tool_call": {"id": "k", "name": "f", "arguments": {"x": "\\ud800"}}}', '{"tool_call": {"id": "k", "name": "f", "arguments": {"x": 1e999}}}',
             '{"tool_call": {"id": "k", "name": "f", "arguments": {"x": NaN}}}', '{"tool_call": {"id": "k", "name": "f", "arguments": {"x": -Infinity}}}']
    rows = [(k, 0, "a", t) for k, t in enumerate(texts)] + [(k, 1, "tool", '{"tool_result": {"id": "k", "content": 1e999}}') for k in range(len(texts))]
    got = {r.conv_id: strict(r.chat) for r in C.format_chats(spark.createDataFrame(rows, ROW), SCHEMA).collect()}
    for k, t in enumerate(texts):
        held = got[k]["calls"] + got[k].get("orphans", []) + [{"text": m["content"]} for m in got[k]["messages"]]
        assert any(c.get("text") == t for c in held), k
        assert all(c["errors"] == ["$: not JSON"] and not c["valid"] for c in got[k]["calls"])


def test_lists_of_types_and_unknown_keywords(spark):
    schema = {"type": "object", "properties": {"x": {"type": ["integer", "null"]}, "y": {"type": "array", "items": {"type": ["string", "boolean"]}}}}
    assert C.errors({"x": None, "y": ["a", True]}, schema) == []
    assert C.errors({"x": "1", "y": [1]}, schema) == ["$.x: not integer or null", "$.y[0]: not string or boolean"]
    C.check_schema(schema)
    for bad in ({"pattern": "a"}, {"properties": {"x": {"const": 1}}}, {"items": {"anyOf": []}}, {"type": "date"}, {"exclusiveMinimum": 1}, {"additionalProperties": {}}):
        with pytest.raises(ValueError):
            C.format_chats(spark.createDataFrame([], ROW), {"f": bad})
    assert C.uses({"a": ["${m}", {"b": "${n}"}], "c": "no ${o}"}) == {"m", "n"}
