"""Hashes of conversations: what counts as the same turn, whatever form it is sent in."""

import hashlib
import json
import random
import time

from palimpsest.operators import identity


def hashes(*turns):
    """Of (role, content) turns, content a text or provider content; the chain written out."""
    out, before = [], ""
    for role, content in turns:
        form = identity.said(None, json.dumps(content), role) if not isinstance(content, str) else identity.said(content, None, role)
        before = hashlib.sha256(f"{before}\0{form}".encode()).hexdigest()
        out.append(before)
    return out


def text(t, **more):
    return {"type": "text", "text": t, **more}


def test_what_does_not_count():
    mark = {"cache_control": {"type": "ephemeral", "ttl": "1h"}}
    small, large = "<system-reminder>date</system-reminder>", "<system-reminder>notes,\nmemory, date</system-reminder>"
    for role, forms in [
        ("assistant", ["hi", [text("hi")], [text("hi", **mark)], [{"text": "hi", "type": "text"}], [{"type": "thinking", "thinking": "", "signature": "s" * 300}, text("hi")], [{"type": "redacted_thinking", "data": "d"}, text("hi")], [text(""), text("hi")]]),
        ("user", ["ask", [text(small), text("ask")], [text(large), text("ask")], [text(f"{large}\n\nask")], f"{small}\nask\n{large}"]),
        ("user", [[{"type": "tool_result", "tool_use_id": "t", "content": [text("ok", **mark), text(large)]}], [{"tool_use_id": "t", "content": [text("ok")], "type": "tool_result"}]]),
        ("user", [[{"type": "tool_result", "tool_use_id": "t", "content": f"done\n{small}"}], [{"type": "tool_result", "tool_use_id": "t", "content": "done"}]]),
    ]:
        assert len({hashes((role, f))[0] for f in forms}) == 1, role


def test_what_counts():
    image = lambda data: [text("see"), {"type": "image", "source": {"type": "base64", "data": data}}]
    for a, b in [
        ([("user", "ab"), ("user", "c")], [("user", "a"), ("user", "bc")]),
        ([("user", "hi")], [("assistant", "hi")]),
        ([("user", [text("hi")])], [("user", [text("ho")])]),
        ([("user", image("A"))], [("user", image("B"))]),
        ([("assistant", "<system-reminder>a</system-reminder> marks notes")], [("assistant", "<system-reminder>b</system-reminder> marks notes")]),
        ([("user", [text("1"), text("2")])], [("user", [text("2"), text("1")])]),
        ([("user", "a\n\n\n\nb")], [("user", "a\n\nb")]),
    ]:
        assert hashes(*a)[-1] != hashes(*b)[-1]
    one, other = hashes(*[("user", c) for c in "abcd"]), hashes(*[("user", c) for c in "aBcd"])
    assert one[0] == other[0] and all(x != y for x, y in zip(one[1:], other[1:], strict=True))
    assert hashes(*[("user", c) for c in "abc"]) == one[:3]


def test_any_depth_and_shape():
    deep = "x"
    for _ in range(50_000):
        deep = [deep]
    assert identity.canonical(deep, "user").count("[") == 50_001
    rnd = random.Random(3)

    def value(depth):
        kind = rnd.randrange(6 if depth else 4)
        return [None, rnd.random() * 10, rnd.choice("aé\n\"\\/\u0001"), True, None, None][kind] if kind < 4 else [value(depth - 1) for _ in range(3)] if kind == 4 else {rnd.choice("abcd"): value(depth - 1) for _ in range(3)}

    for _ in range(300):
        v = value(4)
        assert identity.written_json(v) == json.dumps(v, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def test_chain_over_tables(spark):
    raw = json.dumps([text("b", cache_control={"type": "ephemeral"})])
    rows = [(1, 0, "user", "a", None), (1, 1, "assistant", "x", raw), (2, 0, "user", "a", "[not json"), (2, 1, None, None, None), (None, 0, "user", "a", None)]
    df = spark.createDataFrame(rows, "conv_id long, turn_index long, role string, content string, raw string")
    got = {(r.conv_id, r.turn_index): r.hash for r in identity.chain_hashes(df, "raw").collect()}
    first, second = hashes(("user", "a"), ("assistant", "b"))
    assert got[1, 0] == got[None, 0] == first and got[1, 1] == second and got[2, 0] == hashes(("user", "[not json"))[0] and len(got) == 5
    assert identity.chain_hashes(df.limit(0)).count() == 0


def test_a_long_conversation_takes_linear_time(spark):
    df = spark.range(100_000).selectExpr("1L as conv_id", "id as turn_index", "'user' as role", "concat('turn ', id) as content")
    start = time.perf_counter()
    assert identity.chain_hashes(df).selectExpr("count(distinct hash) as n").first().n == 100_000
    assert time.perf_counter() - start < 30
