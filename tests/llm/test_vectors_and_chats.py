"""Embedding links against brute force, components, and tool calls."""

import json

import numpy as np

from loomfact.llm import embedding_dedup
from loomfact.llm.components import connected_components
from loomfact.llm.embedding_dedup import linked
from loomfact.llm.tool_calls import linked as linked_calls
from loomfact.llm.tool_calls import violation


def brute(rows):
    groups, links, up = {}, {}, {}
    for i, v, label in rows:
        up[i], links[i] = i, 0
        if label is not None and v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v):
            x = np.array(v, float)
            groups.setdefault((label, len(v)), []).append((i, x / np.abs(x).max() / np.linalg.norm(x / np.abs(x).max())))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for g in groups.values():
        x = np.stack([v for _, v in g])
        hit = x @ x.T >= 0.93
        for a in range(len(g)):
            for b in range(a):
                if hit[a, b]:
                    links[g[a][0]] += 1
                    links[g[b][0]] += 1
                    p, q = find(g[a][0]), find(g[b][0])
                    up[max(p, q)] = min(p, q)
    return {(i, links[i], find(i), i == find(i)) for i in up}


def rows_of_vectors():
    rng = np.random.default_rng(2)
    centre = rng.normal(size=(20, 8))
    rows = [(k, (centre[k % 20] + rng.normal(size=8) * rng.choice([0, 0.1, 0.3])).tolist(), k % 3) for k in range(500)]
    odd = [(1000, None, 1), (1001, [0.0] * 8, 1), (1002, [float("nan")] * 8, 1), (1003, [1.0] * 8, None), (1004, [None, *[1.0] * 7], 1)]
    return rows + odd + [(1005, [], 1), (1006, [float("inf"), *[1.0] * 7], 1), (1007, [1e300] * 8, 2), (1008, [1e-300] * 8, 2), (1009, [1.0] * 4, 2), (1010, [2.0] * 4, 2)]


def test_vector_links(spark):
    rows = rows_of_vectors()
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, label int, kept string").repartition(4)
    want = brute(rows)
    for block in (4096, 40):
        assert {(r.vec_id, r.n_links, r.component_id, r.kept) for r in linked(df, block_rows=block).collect()} == want
    assert linked(df.limit(0)).count() == 0


def test_large_labels_without_pivots_are_cut_by_hash(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "SAMPLE_ROWS", 0)
    rows = rows_of_vectors()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    assert {(r.vec_id, r.n_links, r.component_id, r.kept) for r in linked(df, block_rows=30).collect()} == brute(rows)


def test_blocks_share_small_cells_and_cut_large_ones():
    got = embedding_dedup.Layout(np.array([3, 4, 25, 0, 9, 2]), np.zeros(6), 10)
    assert got.first.tolist() == [0, 0, 1, 4, 4, 5] and got.cuts.tolist() == [1, 1, 3, 1, 1, 1]
    assert got.holds.sum(axis=1).tolist() == [1, 1, 3, 1, 1, 1] and got.holds[2].tolist() == [0, 1, 1, 1, 0, 0]


def test_repeated_and_missing_ids(spark):
    rows = [(1, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (None, [0.0, 1.0], 1), (4, [0.0, 1.0], 1)]
    got = sorted((str(r.vec_id), r.n_links, r.component_id, r.kept) for r in linked(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect())
    assert got == [("1", 1, 1, True), ("1", 1, 1, True), ("4", 1, 4, True), ("None", 1, 4, False)]


def test_components_of_paths_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(100, 140)] + [(7, i) for i in range(200, 260)] + [(50, 50), (61, 60), (62, 61)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 100 for i in range(100, 141)) and all(got[i] == 7 for i in range(200, 260))
    assert got[50] == 50 and got[62] == got[60] == 60


def test_tool_calls(spark):
    def call(*c):
        return json.dumps({"content": "x", "tool_calls": [dict(zip(("id", "name", "arguments"), x, strict=True)) for x in c]})

    def result(i, c):
        return json.dumps({"tool_call_id": i, "content": c})

    rows = [
        (1, 0, "user", "hi"),
        (1, 1, "assistant", call(("a", "f", {"x": 1}), ("b", "f", {"x": "$a"}))),
        (1, 2, "tool", result("a", 5)),
        (1, 3, "tool", result("a", 6)),
        (1, 4, "assistant", call(("c", "g", {"y": "$b", "z": ["$a"]}), ("a", "f", {"x": 2}))),
        (2, 0, "assistant", call(("p", "f", {"x": "$q"}), ("q", "f", {"x": "$p"}), ("r", "f", {"x": "bad"}), ("t", "h", {}))),
        (3, None, "user", None),
        (4, 0, "tool", result("w", 1)),
        (4, 1, "assistant", call(("w", "f", {"x": 3}))),
    ]
    schemas = {"f": {"type": "object", "properties": {"x": {"type": "integer"}}, "required": ["x"], "additionalProperties": False}, "g": {"type": "object"}}
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, level string")
    got = linked_calls(df, schemas).collect()
    calls = {(r.conv_id, r.turn, r.call_id): r for r in got if r.kind == "call"}
    assert calls[1, 1, "a"].level == 1 and calls[1, 1, "a"].linked
    assert calls[1, 1, "a"].json == '{"call":{"arguments":{"x":1},"id":"a","name":"f"},"result":{"content":5,"role":"tool","tool_call_id":"a"}}'
    assert calls[1, 1, "b"].level == 2 and calls[1, 4, "c"].level == 3 and not calls[1, 4, "c"].linked
    assert calls[1, 4, "a"].error == "id repeats"
    assert calls[2, 0, "p"].error == calls[2, 0, "q"].error == "circular"
    assert calls[2, 0, "r"].error == "arguments.x: not integer" and calls[2, 0, "t"].error == "unknown tool"
    assert not calls[4, 1, "w"].linked
    assert [r.json for r in got if r.conv_id == 3] == ['{"content":null,"role":"user"}']
    assert linked_calls(df.limit(0)).count() == 0


def test_schema_violations():
    schema = {"type": "object", "properties": {"a": {"type": "array", "items": {"type": "number"}}, "b": {"enum": ["x", "y"]}}, "required": ["a"]}
    assert violation({"a": [1, 2.5]}, schema) is None
    assert violation({}, schema) == "arguments.a: missing"
    assert violation({"a": [1, True]}, schema) == "arguments.a[1]: not number"
    assert violation({"a": [], "b": "z"}, schema) == "arguments.b: not allowed"
