"""The chat query on conversations with tools, calls, results and chains of both, against brute force."""

import json
import random

from askframe.llm import chat, queries

SCHEMA = {"type": "object", "required": ["x"], "properties": {"x": {"type": "integer"}, "to": {"type": "array", "items": {"type": "string"}}}, "additionalProperties": False}


def made(rng):
    rows = []
    for conv in [*range(25), None]:
        turns = list(range(rng.randrange(4, 14)))
        if rng.random() < 0.6:
            tools = [{"name": "f", "parameters": SCHEMA}, {"function": {"name": "g", "parameters": {"type": "object"}}}]
            rows.append((conv, -1, "system", json.dumps({"tools": tools})))
        rng.shuffle(turns)
        ids = []
        for turn in turns:
            body = {"content": rng.choice([None, "said", {"b": 1, "a": [2, None]}])}
            if ids and rng.random() < 0.6:
                body["tool_call_id"] = rng.choice([*ids, "nobody", 7])
            if rng.random() < 0.6:
                body["tool_calls"] = []
                for _ in range(rng.randrange(1, 3)):
                    ids.append(f"c{rng.randrange(12)}")
                    given = rng.choice([{"x": 1}, {"to": ["b", "a"], "x": 2}, {"x": "no"}, {}, "{bad", '{"x": 3}', {"x": 1, "y": 2}])
                    name = rng.choice(["f", "f", "g", "h", None])
                    body["tool_calls"].append({"id": ids[-1], "function": {"name": name, "arguments": given}})
            role = rng.choice(["assistant", "tool"]) if len(body) > 1 else rng.choice(["user", "assistant"])
            rows.append((conv, turn, role, json.dumps(body) if len(body) > 1 else rng.choice(["hi", "{", "", "plain \u00e9"])))
    return rows


def brute(rows):
    """Rows as the query returns them, message by message."""
    out = []
    for conv in {r[0] for r in rows}:
        said = sorted((r for r in rows if r[0] == conv), key=lambda r: r[1])
        tools = {t["name"]: json.loads(t["schema"]) for r in said for t in chat.parse(r[2], r[3])["tools"]}
        parsed = [chat.parse(r[2], r[3]) for r in said]
        first = {}
        for i, p in enumerate(parsed):
            for c in p["calls"]:
                if c["id"] is not None:
                    first.setdefault(c["id"], i)
        parent = [first.get(p["answers"]) if p["answers"] is not None else None for p in parsed]

        def key(i):
            seen, j = [i], parent[i]
            while j is not None and j not in seen:
                seen.append(j)
                j = parent[j]
            base = lambda k: int(parsed[k]["answers"] is not None)
            if j is not None:  # a circle
                return said[i][1], base(i)
            place = (said[seen[-1]][1], base(seen[-1]))
            for k in reversed(seen[:-1]):
                place = max((said[k][1], 1), (place[0], place[1] + 1))
            return place

        for i, (r, p) in enumerate(zip(said, parsed, strict=True)):
            bad = 0
            for c in p["calls"]:
                unknown = bool(tools) and c["name"] not in tools
                fails = c["name"] in tools and bool(chat.problems(json.loads(c["arguments"]), tools[c["name"]]))
                bad += bool(c["problem"]) or unknown or fails
            answered = {parsed[j]["answers"] for j in range(len(said)) if parent[j] == i}
            orphan = int(p["answers"] is not None and parent[i] is None)
            out.append((*r[:3], *key(i), len(p["calls"]), bad, len(answered), orphan, p["json"]))
    return out


def test_query_on_calls(spark):
    rows = made(random.Random(31))
    path = spark.sparkContext.getCheckpointDir() + "/calls"
    spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").repartition(3).write.mode("overwrite").parquet(f"{path}/conversations.parquet")
    names = ["conv_id", "turn", "role", "order_turn", "order_rank", "n_calls", "n_invalid", "n_answered", "n_orphans", "json"]
    found = [tuple(r[c] for c in names) for r in queries.op5_chat_format(spark, path).collect()]
    wanted = brute(rows)
    assert sorted(map(str, found)) == sorted(map(str, wanted))
    total = lambda c: sum(r[names.index(c)] for r in found)
    assert all(total(c) > 5 for c in ("n_calls", "n_invalid", "n_answered", "n_orphans")) and max(r[4] for r in found) > 2
    for r in found:
        if r[9][0] == "{":
            assert json.dumps(json.loads(r[9]), ensure_ascii=False, sort_keys=True, separators=(",", ":")) == r[9]


def test_order_follows_links(spark):
    """In every conversation an answer comes after the message that it answers, along chains of any length."""
    rows = [(1, 20 - i, "tool", json.dumps({"tool_call_id": f"k{i - 1}", "tool_calls": [{"id": f"k{i}", "name": "f"}]})) for i in range(1, 20)]
    rows.append((1, 20, "assistant", json.dumps({"tool_calls": [{"id": "k0", "name": "f"}]})))
    rows.append((2, 1, "tool", json.dumps({"tool_call_id": "a", "tool_calls": [{"id": "a", "name": "f"}]})))
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    got = sorted((r.order_turn, r.order_rank, r.turn) for r in chat.format_chats(df).where("conv_id = 1").collect())
    assert [t for *_, t in got] == list(range(20, 0, -1)) and [r for _, r, _ in got] == list(range(20))
    assert [(r.order_turn, r.order_rank) for r in chat.format_chats(df).where("conv_id = 2").collect()] == [(1, 1)]
