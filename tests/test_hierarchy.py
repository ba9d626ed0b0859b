"""Trees, arborescences, aliases and snapshots: golden cases and brute force."""

from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from loomfact.operators import aliases, graph, hierarchy, store, tree


def test_arborescence_is_the_best_of_all():
    rng = np.random.default_rng(4)
    for _ in range(60):
        n = int(rng.integers(3, 6))
        names = [f"n{i}" for i in range(n)]
        edges = [(c, p, float(rng.integers(1, 20))) for c in names[1:] for p in names if c != p and rng.random() < 0.8]
        weight = {(c, p): w for c, p, w in edges}
        low = min((w for *_, w in edges), default=0.0) - 1e6 * (1 + len({x for e in edges for x in e[:2]}))
        nodes = sorted({x for e in edges for x in e[:2]} - {"n0"})
        total = lambda m: sum(max(weight.get((c, p), -1e18), low if p == "n0" else -1e18) for c, p in m.items())  # noqa: B023, E731

        def tree_ok(m):
            for c in m:
                seen = set()
                while c in m and c not in seen:
                    seen.add(c)
                    c = m[c]
                if c != "n0":
                    return False
            return True

        best = max((total(dict(zip(nodes, ps, strict=True))) for ps in product([*nodes, "n0"], repeat=len(nodes)) if tree_ok(dict(zip(nodes, ps, strict=True)))), default=0)
        got = hierarchy.arborescence(edges, "n0")
        assert tree_ok(got) and set(got) == set(nodes) and abs(total(got) - best) < 1e-6


def test_cycles_lose_their_weakest_edge(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("d", "a"), ("e", "r"), ("x", "y"), ("y", "x")], "child string, parent string")
    weights = spark.createDataFrame([("a", "b", 3), ("b", "c", 1), ("c", "a", 2), ("x", "y", 5), ("y", "x", 4)], "child string, parent string, weight int")
    assert {r.child for r in tree.on_cycles(edges).collect()} == {"a", "b", "c", "x", "y"}
    got = {(r.child, r.parent) for r in tree.broken_cycles(edges, weights).collect()}
    assert got == {("a", "b"), ("c", "a"), ("d", "a"), ("e", "r"), ("x", "y")}
    assert {r.node for r in tree.lifted(edges).where("root is null").collect()} == {"a", "b", "c", "d", "x", "y"}


def test_phantom_parents_keep_their_three_strongest(spark):
    edges = spark.createDataFrame([(f"k{i}", "ghost") for i in range(7)] + [("ghost", "top")], "child string, parent string")
    freq = spark.createDataFrame([("ghost", 1), *((f"k{i}", f) for i, f in enumerate([0, 1, 2, 2, 1, 0, 2]))], "node string, freq int")
    got = {r.child: r.parent for r in tree.lifted_phantoms(edges, freq).collect()}
    assert {c for c, p in got.items() if p == "ghost"} == {"k2", "k3", "k6"}


def test_depth_and_order(spark):
    edges = spark.createDataFrame([("b", "a"), ("c", "b"), ("d", "a")], "child string, parent string")
    assert {(r.node, r.root, r.depth) for r in tree.lifted(edges).collect()} == {("a", "a", 0), ("b", "a", 1), ("c", "a", 2), ("d", "a", 1)}
    assert [r.node for r in tree.depth_first(edges).orderBy("path").collect()] == ["a", "b", "c", "d"]


def test_components_and_paths(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(9)] + [(20, 21), (0, 5)], "a long, b long")
    assert {(r.node, r.component) for r in graph.components(edges).collect()} == {(i, 0) for i in range(10)} | {(20, 20), (21, 20)}
    assert {(r.node, r.steps) for r in graph.shortest_paths(edges, 0).collect()} == {(0, 0), (1, 1), (2, 2), (3, 3), (4, 2), (5, 1), (6, 2), (7, 3), (8, 4), (9, 5)}


def test_canonical_names():
    assert aliases.canonical(["abc", "ab"], {"abc": 182, "ab": 1700}, set()) == "abc"
    assert aliases.canonical(["abc", "ab"], {"abc": 87, "ab": 1325}, set()) == "ab"
    assert aliases.canonical(["x", "yy"], {"yy": 9}, {"x"}) == "x"
    assert aliases.canonical(["甲乙", "丙丁"], {}, set()) == "甲乙"


def test_two_primary_names_never_join():
    got = aliases.merged([("aa", "bb", 1), ("bb", "cc", 1), ("cc", "dd", 1)], {"aa": 5, "dd": 4}, {"aa", "dd"})
    assert got == {"bb": "aa", "cc": "aa"}


def test_overrides_in_order():
    base = {"b": "a", "c": "a", "y": "x"}
    assert aliases.overridden(base, [("merge", "x", "a")]) == {"b": "a", "c": "a", "y": "a", "x": "a"}
    assert aliases.overridden(base, [("split", "b", "")]) == {"c": "a", "y": "x"}
    assert aliases.overridden(base, [("rename", "a", "b")]) == {"c": "b", "a": "b", "y": "x"}


def test_alias_maps_by_novel(spark):
    pairs = spark.createDataFrame([(1, "孙悟空", "行者", 1, 5), (1, "行者", "大圣", 2, 4), (1, "孙悟空", "众人", 3, 9), (2, "a1", "b1", 1, 1)], "novel int, name string, alias string, first int, chapters int")
    freq = spark.createDataFrame([(1, "孙悟空", 100), (1, "行者", 300)], "novel int, name string, freq int")
    primary = spark.createDataFrame([(1, "孙悟空")], "novel int, name string")
    got = {(r.novel, r.alias, r.canonical) for r in aliases.alias_maps(pairs, freq, primary).collect()}
    assert got == {(1, "行者", "孙悟空"), (1, "大圣", "孙悟空"), (2, "b1", "a1")}


def test_balance_moves_leaves_to_higher_tiers():
    edges = pd.DataFrame({"child": [f"l{i:02}" for i in range(40)] + ["big"] + ["s1"], "parent": ["root"] * 41 + ["big"]})
    got = hierarchy.balanced(edges, {"big": 1} | {f"l{i:02}": 5 for i in range(40)})
    assert (got["parent"] == "root").sum() == 30 and len(got) == 42


def test_overlay_deletes_and_adds(spark):
    base = spark.createDataFrame([("a", "x"), ("b", "y")], "name string, parent string")
    change = spark.createDataFrame([("a", None), ("b", "z"), ("c", "w")], "name string, parent string")
    assert {(r.name, r.parent) for r in store.overlay(base, change, ["name"], "parent").collect()} == {("b", "z"), ("c", "w")}


def test_neighbours_inherit_votes(spark):
    votes = spark.createDataFrame([(1, "a", "p", 2.0)], "novel int, child string, parent string, weight double")
    near = spark.createDataFrame([(1, "a", "b"), (1, "b", "c")], "novel int, a string, b string")
    got = {(r.child, r.parent) for r in hierarchy.neighbour_votes(votes, near).collect()}
    assert got == {("a", "p"), ("b", "p"), ("c", "p")}


def test_latest_and_rollback(spark):
    v = spark.createDataFrame([("n", 1, "a"), ("n", 2, "b")], "novel string, version int, tree string")
    assert store.latest(v, ["novel"], "version").collect()[0].tree == "b"
    assert {(r.version, r.tree) for r in store.rollback(v, "novel", F.lit(1)).collect()} == {(1, "a"), (2, "b"), (3, "a")}


def test_chains_of_any_depth_and_around_cycles(spark):
    deep = [(f"n{i:03}", f"n{i - 1:03}") for i in range(1, 51)]
    edges = spark.createDataFrame([*deep, ("a", "b"), ("b", "c"), ("c", "b"), ("s", "s")], "child string, parent string")
    got = {r.node: (r.chain, r.length) for r in tree.chains(edges).collect()}
    assert got["n050"] == (" > ".join(f"n{i:03}" for i in range(49, -1, -1)), 50) and got["n001"] == ("n000", 1)
    assert got["a"] == ("b > c", 2) and got["b"] == ("c", 1) and got["c"] == ("b", 1)
    assert len(got) == 53


def test_waiting_pairs_join_on_evidence():
    big = [("aa", f"x{i}", 1) for i in range(6)]
    assert "x5" not in aliases.merged(big, {}, {"aa"})  # five names are there already
    assert aliases.merged([*big[:5], ("aa", "x5", 3)], {}, {"aa"})["x5"] == "aa"
    assert aliases.merged([("aa", "bb", 4)], {"aa": 9}, {"aa", "bb"}) == {"bb": "aa"}


def test_many_nested_cycles_need_no_recursion():
    n = 400
    edges = [(f"v{i}", f"v{i - 1}", 10.0 + i) for i in range(1, n)] + [(f"v{i}", f"v{i + 1}", 9.0 + i) for i in range(n - 1)]
    got = hierarchy.arborescence(edges, "r")
    assert len(got) == n and list(got.values()).count("r") == 1
