"""Levels of long chains, ladders and circles, against brute force; tables of bodies are not broadcast."""

import json

import numpy as np

from loomfact.llm import tool_calls


def one(conv, turn, own, needs):
    return (conv, turn, "assistant", json.dumps({"tool_calls": [{"id": own, "name": "f", "arguments": {"x": [f"${n}" for n in needs]}}]}))


def test_levels_of_long_chains_and_circles(spark):
    rng = np.random.default_rng(1)
    rows, want = [], {}
    for i in range(1500):  # a hot conversation: a chain
        rows.append(one(1, i, f"c{i}", [f"c{i - 1}"] if i else []))
        want[1, f"c{i}"] = i + 1
    for conv in range(2, 10):
        for i in range(30):
            needs = sorted({int(x) for x in rng.integers(0, i, min(i, rng.integers(0, 4)))}) if i else []
            rows.append(one(conv, i, f"d{i}", [f"d{n}" for n in needs]))
            want[conv, f"d{i}"] = 1 + max((want[conv, f"d{n}"] for n in needs), default=0)
        rows += [one(conv, 40 + k, f"o{k}", [f"o{(k + 1) % 3}", "d1"]) for k in range(3)] + [one(conv, 50, "p", ["o1", "d2"])]
        want |= {(conv, x): None for x in ("o0", "o1", "o2", "p")}
    rows.append((1, 2000, "user", "hi"))
    rows.append((1, 2001, "tool", json.dumps({"tool_call_id": "c1499", "content": "r"})))
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4)
    out = tool_calls.linked(df, {"f": {"type": "object", "required": ["x"]}})
    got = [r for r in out.collect() if r.kind == "call"]
    assert {(r.conv_id, r.call_id): r.level for r in got} == want
    assert all((r.error == "circular") == (r.level is None) for r in got)
    assert [r.conv_id for r in got if r.linked] == [1]


def test_bodies_are_not_hinted_for_broadcast(spark):
    df = spark.createDataFrame([one(1, 0, "a", [])], "conv_id long, turn long, role string, text string")
    plan = tool_calls.linked(df)._jdf.queryExecution().logical().toString()
    assert "broadcast" not in plan
