"""Chat formatting with linked tool calls.

Messages carry calls and results in an envelope of plain JSON.  Calls and results are hash-joined on (conversation, call id); arguments are
validated against the tools' schemas; calls that use other calls' results are put in topological order; each conversation becomes one
canonical JSON string (sorted keys, no spare spaces).
"""

from __future__ import annotations

import heapq
import json
import math
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CALL, RESULT = "tool_call", "tool_result"
_TYPES = {"string": str, "integer": int, "number": (int, float), "boolean": bool, "object": dict, "array": list, "null": type(None)}
_USES = re.compile(r"^\$\{([^{}]+)\}$")

#: The schema of the tool that ``as_tool_log`` writes.
SCHEMAS = {"reply": {"type": "object", "required": ["prompt", "turn"], "additionalProperties": False,
                     "properties": {"prompt": {"type": "string", "minLength": 1}, "turn": {"type": "integer", "minimum": 0}, "after": {"type": "string"}}}}


def canonical(value) -> str:
    """JSON with sorted keys, no spare spaces and no escapes but the necessary ones."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


DEEPEST = 200      # levels of a JSON value that is read; deeper ones are text
KEYWORDS = {"type", "enum", "required", "properties", "additionalProperties", "items", "minLength", "maxLength", "minimum", "maximum", "title", "description", "default"}


def parts(value):
    """All values inside a JSON value with their levels, itself included; no recursion."""
    stack = [(value, 0)]
    while stack:
        value, level = stack.pop()
        yield value, level
        if isinstance(value, dict):
            stack += [(x, level + 1) for x in value.values()]
            stack += [(x, level + 1) for x in value]
        elif isinstance(value, list):
            stack += [(x, level + 1) for x in value]


def parsed(text: str, once: bool = False):
    """The JSON value of a text.  ValueError for what can't be written as JSON again: numbers that aren't finite, lone surrogates, and values nested
    deeper than ``DEEPEST`` levels; with ``once`` also for repeated keys."""
    def refuse(word: str):
        raise ValueError(f"{word} is no JSON number")

    def number(word: str) -> float:
        value = float(word)
        return value if math.isfinite(value) else refuse(word)

    def pairs(found):
        if once and len({k for k, _ in found}) < len(found):
            raise ValueError("repeated key")
        return dict(found)

    try:
        value = json.loads(text, parse_constant=refuse, parse_float=number, object_pairs_hook=pairs)
    except RecursionError:
        raise ValueError("nested too deep") from None
    for part, level in parts(value):
        if level > DEEPEST:
            raise ValueError("nested too deep")
        if isinstance(part, str):
            part.encode("utf-8")        # UnicodeEncodeError is a ValueError
    return value


def envelope(text: str, key: str) -> dict:
    """What stands under the key; empty if the text is no such JSON after all."""
    try:
        body = parsed(text)[key]
    except (ValueError, TypeError, KeyError):
        return {}
    return body if isinstance(body, dict) else {}


def whole(text: str, key: str, call_id: str, fields: set[str]) -> bool:
    """Whether the envelope's id and fields are all that the text says."""
    try:
        value = parsed(text, once=True)
        return set(value) == {key} and set(value[key]) <= {"id", *fields} and value[key]["id"] == call_id and isinstance(value[key].get("name", ""), str)
    except (ValueError, TypeError, KeyError, AttributeError):
        return False


def check_schema(schema: dict) -> None:
    """ValueError for a schema that says more than ``errors`` checks."""
    stack = [schema]
    while stack:
        own = stack.pop()
        if not isinstance(own, dict) or set(own) - KEYWORDS:
            raise ValueError(f"schema with unknown keywords: {sorted(set(own) - KEYWORDS) if isinstance(own, dict) else own!r}")
        kinds = own.get("type", [])
        if unknown := {*([kinds] if isinstance(kinds, str) else kinds)} - set(_TYPES):
            raise ValueError(f"schema with unknown types: {sorted(unknown)}")
        if not isinstance(own.get("additionalProperties", True), bool):
            raise ValueError("additionalProperties is true or false")
        stack += [*own.get("properties", {}).values(), *([own["items"]] if "items" in own else [])]


def _is(value, kind: str) -> bool:
    return isinstance(value, _TYPES[kind]) and not (isinstance(value, bool) and kind in ("integer", "number"))


def errors(value, schema: dict, at: str = "$") -> list[str]:
    """What is wrong with a JSON value (of ``DEEPEST`` levels at most) under a schema: type, enum, required, properties, items and bounds."""
    kind = schema.get("type")
    if kind and not any(_is(value, k) for k in ([kind] if isinstance(kind, str) else kind)):
        return [f"{at}: not {kind if isinstance(kind, str) else ' or '.join(kind)}"]
    found = []
    if "enum" in schema and value not in schema["enum"]:
        found.append(f"{at}: not in enum")
    if isinstance(value, dict):
        known = schema.get("properties", {})
        found += [f"{at}.{k}: missing" for k in schema.get("required", []) if k not in value]
        for k in sorted(value):
            if k in known:
                found += errors(value[k], known[k], f"{at}.{k}")
            elif schema.get("additionalProperties") is False:
                found.append(f"{at}.{k}: unknown")
    elif isinstance(value, list) and "items" in schema:
        found += [x for i, v in enumerate(value) for x in errors(v, schema["items"], f"{at}[{i}]")]
    elif isinstance(value, str):
        if not schema.get("minLength", 0) <= len(value) <= schema.get("maxLength", len(value)):
            found.append(f"{at}: length")
    elif isinstance(value, int | float) and not isinstance(value, bool):
        if not schema.get("minimum", value) <= value <= schema.get("maximum", value):
            found.append(f"{at}: out of range")
    return found


def uses(value) -> set[str]:
    """Ids of the calls whose results a call's arguments refer to, written "${id}"."""
    values = [x for x, _ in parts(value) if isinstance(x, str)]
    return {name for x in values for name in _USES.findall(x)}


def ordered(calls: dict[str, tuple[tuple, set[str]]]) -> tuple[list[str], list[str]]:
    """Topological order of {id: (rank, used ids)}, the smallest rank first among the ready; and the ids on or behind a cycle."""
    waits = {k: {u for u in used if u in calls} for k, (_, used) in calls.items()}
    users: dict[str, list[str]] = {}
    for k, need in waits.items():
        for u in need:
            users.setdefault(u, []).append(k)
    ready = [(calls[k][0], k) for k, need in waits.items() if not need]
    heapq.heapify(ready)
    out = []
    while ready:
        _, k = heapq.heappop(ready)
        out.append(k)
        for user in users.get(k, []):
            waits[user].discard(k)
            if not waits[user]:
                heapq.heappush(ready, (calls[user][0], user))
    done = set(out)
    return out, sorted((k for k in calls if k not in done), key=lambda k: (calls[k][0], k))


def as_tool_log(conversations: DataFrame) -> DataFrame:
    """Messages (conv_id, turn, role, text) with each user turn as a call of ``reply`` and the assistant turn after it as its result.

    A call names the call before it, so later calls depend on earlier ones.  Messages of other roles stay as they are.
    """
    turn = F.coalesce(F.col("turn").cast("long"), F.lit(-1))
    name = lambda t: F.concat(F.lit("call-"), t.cast("string"))
    prompt = F.coalesce(F.col("text").cast("string"), F.lit(""))
    arguments = F.struct(prompt.alias("prompt"), turn.alias("turn"), F.when(turn >= 2, F.concat(F.lit("${"), name(turn - 2), F.lit("}"))).alias("after"))
    call = F.to_json(F.struct(F.struct(name(turn).alias("id"), F.lit("reply").alias("name"), arguments.alias("arguments")).alias(CALL)))
    result = F.to_json(F.struct(F.struct(name(turn - 1).alias("id"), prompt.alias("content")).alias(RESULT)))
    text = F.when(F.col("role") == "user", call).when(F.col("role") == "assistant", result).otherwise(F.col("text").cast("string"))
    role = F.when(F.col("role") == "assistant", "tool").otherwise(F.col("role"))
    return conversations.select("conv_id", "turn", F.when(F.col("role") == "user", "assistant").otherwise(role).alias("role"), text.alias("text"))


def format_chats(messages: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """(conv_id, n_messages, n_calls, n_results, n_linked, n_invalid, n_cyclic, chat): one row per conversation.

    ``messages``: conv_id, turn, role, text; other columns are not read.  A message whose text is a JSON object with the one key
    "tool_call" ({id, name, arguments}) is a call, with "tool_result" ({id, content}) a result; any other is plain.  A
    call is linked to the first result of its id (by turn, then text); further results, results without a call, and repeated calls of an id
    (the first by turn, then text, counts) stay unlinked and are listed as "orphans" with their role and whole text.  A call or result that says more than
    its fields, or that isn't quite JSON, keeps its whole text too ("text", "result_text").  ``chat`` holds the plain messages by (turn, role, text) and the calls in topological order
    of the results that they use, those on a cycle last.  Null turns come first, null texts are empty, a message without conv_id is a
    conversation of its own.  Repeated rows are one message.  An empty table gives no rows.  A conversation is one string, so it
    must fit into a task.  Envelopes that can't be written as JSON again (numbers that aren't finite, lone surrogates, more than ``DEEPEST`` levels) are
    "not JSON" and keep their text.  A schema with keywords that aren't checked is refused (ValueError).
    """
    for schema in schemas.values():
        check_schema(schema)
    own = messages.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
                          F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).distinct()
    own = own.withColumn("key", F.coalesce(F.col("conv_id").cast("string"), F.concat(F.lit("-"), F.sha2(F.to_json(F.struct("turn", "role", "text")), 256))))
    # only texts that open with an envelope's key are parsed
    kind = F.when(F.col("text").rlike(r'^\s*\{\s*"tool_call"\s*:'), "call").when(F.col("text").rlike(r'^\s*\{\s*"tool_result"\s*:'), "result")
    named = F.coalesce(F.get_json_object("text", f"$.{CALL}.id"), F.get_json_object("text", f"$.{RESULT}.id"))
    marked = own.withColumn("kind", kind).withColumn("call_id", F.when(F.col("kind").isNotNull(), named))
    marked = marked.withColumn("kind", F.when(F.col("call_id").isNotNull(), F.col("kind")).otherwise("plain"))

    def firsts(kind: str) -> DataFrame:
        found = marked.where(F.col("kind") == kind).groupBy("key", "call_id").agg(F.min(F.struct("turn", "text", "role")).alias(kind))
        return found.hint("shuffle_hash")

    linked = firsts("call").join(firsts("result"), ["key", "call_id"], "left").select(
        "key", "call_id", F.lit("linked").alias("kind"), F.col("call.turn").alias("turn"), F.col("call.role").alias("role"), F.col("call.text").alias("text"), "result")
    rest = marked.select("key", "call_id", "kind", "turn", "role", "text", "conv_id")

    def chat(g: pd.DataFrame) -> pd.DataFrame:
        def place(turn, text, role) -> tuple:
            return -1 if pd.isna(turn) else int(turn), text, role

        rows = list(g.itertuples(index=False))
        messages = [r for r in rows if r.kind != "linked"]
        entries, calls, counted, bad = {}, {}, set(), 0
        for r in (r for r in rows if r.kind == "linked"):
            body = envelope(r.text, CALL)
            name, arguments = str(body.get("name")), body.get("arguments")
            wrong = ["$: not JSON"] if not body else errors(arguments, schemas[name]) if name in schemas else ["$: unknown tool"]
            bad += bool(wrong)
            entries[r.call_id] = {"id": r.call_id, "name": name, "arguments": arguments, "valid": not wrong} | ({"errors": wrong} if wrong else {})
            if not whole(r.text, CALL, r.call_id, {"name", "arguments"}):
                entries[r.call_id]["text"] = r.text
            calls[r.call_id] = (place(r.turn, r.text, r.role), uses(arguments))
            counted.add(("call", *calls[r.call_id][0]))
            if r.result is not None:
                counted.add(("result", *place(r.result["turn"], r.result["text"], r.result["role"])))
                entries[r.call_id]["result"] = envelope(r.result["text"], RESULT).get("content")
                if not whole(r.result["text"], RESULT, r.call_id, {"content"}):
                    entries[r.call_id]["result_text"] = r.result["text"]
        plain, orphans, total = [], [], {"plain": 0, "call": 0, "result": 0}
        for r in sorted(messages, key=lambda r: (*place(r.turn, r.role, r.text), str(r.call_id))):
            at = place(r.turn, r.text, r.role)
            total[r.kind] += 1
            if r.kind == "plain":
                plain.append({"role": r.role, "content": r.text})
            elif (r.kind, *at) not in counted:
                orphans.append({"kind": r.kind, "id": r.call_id, "turn": at[0], "role": r.role, "text": r.text})
        done, cyclic = ordered(calls)
        written = {"messages": plain, "calls": [entries[k] for k in [*done, *cyclic]]} | ({"orphans": orphans} if orphans else {})
        linked = sum("result" in e for e in entries.values())
        return pd.DataFrame({"conv_id": pd.array([messages[0].conv_id], "Int64"), "n_messages": sum(total.values()), "n_calls": total["call"], "n_results": total["result"],
                             "n_linked": linked, "n_invalid": bad, "n_cyclic": len(cyclic), "chat": canonical(written)})

    both = rest.withColumn("result", F.lit(None).cast(linked.schema["result"].dataType)).unionByName(linked.withColumn("conv_id", F.lit(None).cast("long")))
    return both.groupBy("key").applyInPandas(
        chat, "conv_id long, n_messages long, n_calls long, n_results long, n_linked long, n_invalid long, n_cyclic long, chat string")
