"""Chat formatting: tool calls linked to their results, ordered, validated and written as canonical JSON."""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from askframe.llm.common import Scratch, cut, map_texts

_TYPES: dict[str, Callable[[Any], bool]] = {
    "object": lambda v: isinstance(v, dict),
    "array": lambda v: isinstance(v, list),
    "string": lambda v: isinstance(v, str),
    "boolean": lambda v: isinstance(v, bool),
    "null": lambda v: v is None,
    "number": lambda v: isinstance(v, int | float) and not isinstance(v, bool),
    "integer": lambda v: not isinstance(v, bool) and (isinstance(v, int) or (isinstance(v, float) and v.is_integer())),
}


def canonical(value: Any) -> str:
    """JSON with sorted keys, no spaces and characters as they are; numbers that aren't finite raise ValueError."""
    return json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"), allow_nan=False)


def problems(value: Any, schema: Mapping[str, Any] | bool, at: str = "$") -> list[str]:
    """What is wrong with a value under a JSON schema.

    Known are type, enum, const, required, properties, additionalProperties, items, the bounds of numbers, strings and
    arrays, allOf, anyOf, oneOf and not; other words of a schema are ignored.
    """
    if isinstance(schema, bool):
        return [] if schema else [f"{at}: nothing is allowed"]
    found = []
    if (kinds := schema.get("type")) is not None:
        kinds = [kinds] if isinstance(kinds, str) else kinds
        if not any(_TYPES.get(k, lambda _: False)(value) for k in kinds):
            return [f"{at}: not of type {' or '.join(kinds)}"]
    if "enum" in schema and canonical(value) not in {canonical(x) for x in schema["enum"]}:
        found.append(f"{at}: not one of the values listed")
    if "const" in schema and canonical(value) != canonical(schema["const"]):
        found.append(f"{at}: not the value asked for")
    if isinstance(value, dict):
        known = schema.get("properties", {})
        found += [f"{at}.{k}: missing" for k in schema.get("required", []) if k not in value]
        for k, v in value.items():
            found += problems(v, known.get(k, schema.get("additionalProperties", True)), f"{at}.{k}")
    if isinstance(value, list) and "items" in schema:
        found += [x for i, v in enumerate(value) for x in problems(v, schema["items"], f"{at}[{i}]")]
    size = value if _TYPES["number"](value) else len(value) if isinstance(value, str | list) else None
    low, high = {str: ("minLength", "maxLength"), list: ("minItems", "maxItems")}.get(type(value), ("minimum", "maximum"))
    if size is not None:
        found += [f"{at}: below {low}"] if size < schema.get(low, size) else []
        found += [f"{at}: above {high}"] if size > schema.get(high, size) else []
    found += [x for part in schema.get("allOf", []) for x in problems(value, part, at)]
    for word, right in (("anyOf", lambda n: n >= 1), ("oneOf", lambda n: n == 1)):
        if word in schema and not right(sum(not problems(value, part, at) for part in schema[word])):
            found.append(f"{at}: fails {word}")
    if "not" in schema and not problems(value, schema["not"], at):
        found.append(f"{at}: is what must not be")
    return found


def _calls(body: dict) -> list[dict]:
    """The calls of a message: id, name, arguments as canonical JSON, and what is wrong with them without a schema."""
    calls = []
    for call in body["tool_calls"]:
        call = call if isinstance(call, dict) else {}
        inner = call["function"] if isinstance(call.get("function"), dict) else call
        name, given, wrong = inner.get("name"), inner.get("arguments", {}), None
        if isinstance(given, str):
            try:
                given = json.loads(given)
                canonical(given)
            except (ValueError, RecursionError):
                given, wrong = {}, "$: not JSON"
        ident = call.get("id")
        named = isinstance(name, str)
        calls.append({"id": None if ident is None else str(ident), "name": name if named else None, "arguments": given, "problem": wrong or (None if named else "unknown tool")})
    return calls


def _tools(body: Any) -> list[dict]:
    """The tools that a system message defines: names and schemas of their arguments, as canonical JSON."""
    found = []
    for tool in body["tools"] if isinstance(body, dict) and isinstance(body.get("tools"), list) else ():
        inner = tool["function"] if isinstance(tool, dict) and isinstance(tool.get("function"), dict) else tool
        if isinstance(inner, dict) and isinstance(inner.get("name"), str):
            schema = inner.get("parameters", {})
            found.append({"name": inner["name"], "schema": canonical(schema if isinstance(schema, dict | bool) else {})})
    return found


def parse(role: str | None, text: str) -> dict:
    """One message: the tools that it defines, its calls, the call that it answers, and its canonical JSON.

    A system's text that is a JSON object with ``tools`` defines tools. An assistant's or tool's that is one with
    ``tool_calls`` holds calls, with ``tool_call_id`` it answers a call, and it may do both. Any other text is content as
    it is, JSON or not.
    """
    body = None
    if role in ("assistant", "tool", "system") and text.lstrip()[:1] == "{":
        try:
            body = json.loads(text)
            canonical(body)
        except (ValueError, RecursionError):
            body = None
    out = {"tools": _tools(body) if role == "system" else [], "calls": [], "answers": None, "json": canonical({"role": role, "content": text})}
    if role == "system" or not isinstance(body, dict):
        return out
    calls = _calls(body) if isinstance(body.get("tool_calls"), list) else None
    ident = None if body.get("tool_call_id") is None else str(body["tool_call_id"])
    if calls is None and ident is None:
        return out
    said: dict[str, Any] = {"role": role, "content": body.get("content")}
    if calls is not None:
        said["tool_calls"] = [{k: c[k] for k in ("id", "name", "arguments")} for c in calls]
        out["calls"] = [c | {"arguments": canonical(c["arguments"])} for c in calls]
    if ident is not None:
        said["tool_call_id"] = out["answers"] = ident
    return out | {"json": canonical(said)}


_CALL = pa.struct([("id", pa.string()), ("name", pa.string()), ("arguments", pa.string()), ("problem", pa.string())])
_TOOL = pa.struct([("name", pa.string()), ("schema", pa.string())])


def _checked(texts: list[str]) -> list[pa.Array]:
    """Whether arguments fail a schema, from JSON arrays of both."""
    return [pa.array([bool(problems(json.loads(given), json.loads(schema))) for given, schema in map(json.loads, texts)], pa.bool_())]


def _invalid(linked: DataFrame, tools: DataFrame, schemas: Mapping[str, Any], scratch: Scratch) -> DataFrame:
    """The number of invalid calls of each message that has any.

    Tools are joined to calls by conversation and name. A conversation's own definition comes before that in
    ``schemas``; where either defines any tool, a call of another is invalid.
    """
    spark = linked.sparkSession
    each = linked.select("uid", "conv", F.explode("calls").alias("c")).select("uid", "conv", "c.name", "c.arguments", "c.problem")
    known = spark.createDataFrame([(k, canonical(v)) for k, v in schemas.items()], "name_ string, given string")
    own = tools.select(F.col("conv").alias("conv_"), F.col("name").alias("name_"), "schema")
    some = tools.select(F.col("conv").alias("conv_")).distinct().withColumn("any", F.lit(True))
    each = each.join(own, each["conv"].eqNullSafe(own["conv_"]) & (each["name"] == own["name_"]), "left").drop("conv_", "name_")
    each = each.join(some, each["conv"].eqNullSafe(some["conv_"]), "left").drop("conv_")
    each = each.join(F.broadcast(known), each["name"] == known["name_"], "left")
    each = scratch.cut(each.select("uid", "problem", "arguments", F.coalesce("schema", "given").alias("schema"), (F.col("any") | F.lit(bool(schemas))).alias("any")))
    wrong = F.col("problem").isNotNull() | (F.col("schema").isNull() & F.coalesce("any", F.lit(False)))
    plain = each.where("schema is null or problem is not null").select("uid", wrong.alias("bad"))
    pairs = each.where("schema is not null and problem is null").select("uid", F.to_json(F.array("arguments", "schema")).alias("both"))
    bad = plain.unionByName(map_texts(pairs, "uid", "both", "bad boolean", _checked))
    return bad.where("bad").groupBy("uid").agg(F.count(F.lit(1)).alias("n_invalid"))


def _ordered(linked: DataFrame, parents: DataFrame, scratch: Scratch) -> DataFrame:
    """``uid`` with ``order_turn`` and ``order_rank`` for messages with calls or results.

    An answer follows the message that it answers, which may be an answer itself. Chains are walked in doubling steps:
    ``up`` is where a message's stretch of ancestors ends, ``top`` the latest turn in it, ``far`` the steps to the
    furthest that has it and ``base`` the rank that this one has by itself. Messages in a circle keep their own turn.
    """
    none = F.lit(-(2**63)).cast("long")
    own = linked.select("uid", F.coalesce(F.col("turn").cast("long"), none).alias("top"), F.col("answers").isNotNull().cast("int").alias("base"))
    first = own.join(parents.select("uid", F.col("call_uid").alias("up")), "uid", "left").select("uid", "up", "top", F.lit(0).alias("far"), "base", F.lit(1).alias("size"))
    state, left = scratch.cut(first), 1
    rounds = max(1, linked.count()).bit_length() + 1
    while rounds and left:
        b = state.select(F.col("uid").alias("up"), F.col("up").alias("up_"), F.col("top").alias("top_"), F.col("far").alias("far_"), F.col("base").alias("base_"), F.col("size").alias("size_"))
        longer = F.col("top_") >= F.col("top")
        step = state.where("up is not null").join(b, "up").select(
            "uid",
            F.col("up_").alias("up"),
            F.greatest("top", "top_").alias("top"),
            F.when(longer, F.col("size") + F.col("far_")).otherwise(F.col("far")).alias("far"),
            F.when(longer, F.col("base_")).otherwise(F.col("base")).alias("base"),
            (F.col("size") + F.col("size_")).alias("size"),
        )
        after = scratch.cut(state.where("up is null").unionByName(step))
        scratch.drop(state)
        state, rounds = after, rounds - 1
        left = state.where("up is not null").count()
    ended = state.where("up is null").select("uid", "top", (F.col("far") + F.col("base")).alias("order_rank"))
    circle = state.where("up is not null").select("uid").join(own, "uid").select("uid", "top", F.col("base").alias("order_rank"))
    return ended.unionByName(circle).select("uid", F.nullif(F.col("top"), none).alias("order_turn"), "order_rank")


def format_chats(
    df: DataFrame,
    schemas: Mapping[str, Any] | None = None,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
) -> DataFrame:
    """A row for each message: conversation, turn, role, ``order_turn``, ``order_rank``, counts and ``json``.

    Calls and results are joined by conversation and call id. ``order_turn`` and ``order_rank`` order a conversation
    topologically: a message that answers none has its own turn and rank 0. One that does has rank 1 at its own turn, or
    the latest turn of those that it follows, however long the chain, with a rank above all of them there; ties go by
    turn. ``n_calls`` counts a message's calls, ``n_invalid`` those whose arguments fail the schema that the conversation's
    system messages define for the tool, or ``schemas`` where they don't (or that call no tool of either, where there are
    any), ``n_answered`` those with a result, ``n_orphans`` is 1 for a result without a call.

    If an id is used by several calls of a conversation, results belong to the first by turn; of several definitions of
    a tool the first counts. Every row stays, repeated ones too; null roles and turns stay null, a null text is an empty
    content, a null conversation is one like others. Other columns are ignored; an empty table gives an empty result. A
    conversation is never gathered in one task: only messages with calls or results are joined, by conversation and id
    together.
    """
    scratch = Scratch(df.sparkSession)
    key = F.struct(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), F.col(role_col).cast("string").alias("role"))
    # the role is needed beside the text, so both travel as one JSON array
    both = F.to_json(F.array(F.col(role_col).cast("string"), F.coalesce(F.col(text_col).cast("string"), F.lit(""))), {"ignoreNullFields": "false"})

    def run(texts: list[str]) -> list[pa.Array]:
        out = [parse(*json.loads(t)) for t in texts]
        return [
            pa.array([x["tools"] for x in out], pa.list_(_TOOL)),
            pa.array([x["calls"] for x in out], pa.list_(_CALL)),
            pa.array([x["answers"] for x in out], pa.string()),
            pa.array([x["json"] for x in out], pa.string()),
        ]

    source = df.select(key.alias("key"), both.alias("both"))
    kinds = "tools array<struct<name: string, schema: string>>, calls array<struct<id: string, name: string, arguments: string, problem: string>>"
    flat = map_texts(source, "key", "both", f"{kinds}, answers string, json string", run).select("key.*", "tools", "calls", "answers", "json")
    plain = flat.where("size(calls) = 0 and answers is null")
    special = scratch.cut(flat.where("size(calls) > 0 or answers is not null or size(tools) > 0").withColumn("uid", F.monotonically_increasing_id()))
    linked = special.where("size(calls) > 0 or answers is not null")
    defined = special.select("conv", "turn", "uid", F.explode("tools").alias("t"))
    tools = defined.groupBy("conv", F.col("t.name").alias("name")).agg(F.min(F.struct(F.col("turn").isNull().alias("none"), "turn", "uid", "t.schema")).alias("first"))
    tools = scratch.cut(tools.select("conv", "name", "first.schema"))
    calls = linked.select("conv", "turn", "uid", F.explode("calls.id").alias("id")).where("id is not null")
    first = calls.groupBy("conv", "id").agg(F.min(F.struct(F.col("turn").isNull().alias("none"), "turn", "uid")).alias("first"))
    first = scratch.cut(first.select(F.col("conv").alias("conv_"), F.col("id").alias("id_"), F.col("first.uid").alias("call_uid")))
    results = linked.where("answers is not null").select("conv", "uid", F.col("answers").alias("id"))
    parents = scratch.cut(results.join(first, results["conv"].eqNullSafe(first["conv_"]) & (results["id"] == first["id_"])).select("uid", "call_uid", "id"))
    answered = parents.select("call_uid", "id").distinct().groupBy(F.col("call_uid").alias("uid")).agg(F.count(F.lit(1)).alias("n_answered"))
    facts = _ordered(linked, parents, scratch)
    facts = facts.join(_invalid(linked, tools, dict(schemas or {}), scratch), "uid", "left").join(answered, "uid", "left")
    facts = facts.join(parents.select("uid", F.lit(1).alias("n_parents")), "uid", "left")
    shown = linked.select("uid", "conv", "turn", "role", F.size("calls").alias("n_calls"), F.col("answers").isNotNull().cast("int").alias("is_answer"), "json")
    done = cut(shown.join(facts, "uid"))
    scratch.close()
    none = F.lit(0)
    rows = done.unionByName(
        plain.select("conv", "turn", "role", "json", F.col("turn").cast("long").alias("order_turn"), *[none.alias(c) for c in ("order_rank", "n_calls", "is_answer")]),
        allowMissingColumns=True,
    )
    orphan = F.col("is_answer") - F.coalesce("n_parents", none)
    return rows.select(
        F.col("conv").alias(conv_col),
        F.col("turn").alias(turn_col),
        F.col("role").alias(role_col),
        F.col("order_turn").cast(df.schema[turn_col].dataType),
        F.col("order_rank").cast("int"),
        F.col("n_calls").cast("long"),
        F.coalesce("n_invalid", none).cast("long").alias("n_invalid"),
        F.coalesce("n_answered", none).cast("long").alias("n_answered"),
        orphan.cast("long").alias("n_orphans"),
        "json",
    )


#: The rows for a table of messages without tool calls or results, as the given ones. SQL can't write canonical JSON of
#: nested arguments or check schemas: tests/llm/test_calls.py holds the query to brute force on a table that has them.
SQL = """
SELECT conv_id, turn, role, turn AS order_turn, CAST(0 AS INTEGER) AS order_rank, CAST(0 AS BIGINT) AS n_calls, CAST(0 AS BIGINT) AS n_invalid,
       CAST(0 AS BIGINT) AS n_answered, CAST(0 AS BIGINT) AS n_orphans,
       CAST(json_object('content', coalesce(text, ''), 'role', role) AS VARCHAR) AS json
FROM conversations
"""
