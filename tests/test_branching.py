"""Arborescences by rounds against the fold over one novel, on random votes of several novels."""

import random

import pytest

from loomfact.operators import branching, hierarchy

VOTES = "novel string, child string, parent string, weight double"


def value(parents, weights):
    """Edges that no vote states, and the sum of the others' votes."""
    return sum((c, p) not in weights for c, p in parents.items()), -sum(weights.get(e, 0) for e in parents.items())


@pytest.mark.parametrize("seed", [1, 2])
def test_as_good_as_the_fold(spark, seed):
    rng, rows = random.Random(seed), []
    for n in range(6):
        size = rng.randrange(3, 14)
        rows += [(f"b{n}", f"n{rng.randrange(size)}", f"n{rng.randrange(size)}", float(rng.randrange(1, 50))) for _ in range(rng.randrange(5, 40))]
    roots = spark.createDataFrame([(f"b{n}", "n0") for n in range(6)], "novel string, root string")
    got = {}
    for r in branching.arborescences(spark.createDataFrame(rows, VOTES).repartition(3), roots).collect():
        assert r.child not in got.setdefault(r.novel, {})
        got[r.novel][r.child] = r.parent
    for n in range(6):
        own = sorted({(c, p): w for b, c, p, w in sorted(rows, key=lambda r: r[3]) if b == f"b{n}" and c != p and c != "n0"}.items())
        weights = dict(own)
        want = hierarchy.arborescence([(c, p, w) for (c, p), w in own], "n0")
        mine = got.get(f"b{n}", {})
        assert set(mine) == set(want)
        assert value(mine, weights) == value(want, weights)
        for c in mine:  # all lead to the root
            seen = set()
            while c in mine:
                assert c not in seen
                seen.add(c)
                c = mine[c]
            assert c == "n0"


def test_nested_cycles_and_places_without_a_way(spark):
    rows = [("b", "a", "b", 9.0), ("b", "b", "a", 9.0), ("b", "c", "a", 5.0), ("b", "a", "c", 8.0), ("b", "c", "r", 1.0), ("b", "x", "y", 1.0), ("b", "y", "x", 2.0), ("b", "r", "a", 99.0)]
    roots = spark.createDataFrame([("b", "r")], "novel string, root string")
    got = {r.child: r.parent for r in branching.arborescences(spark.createDataFrame(rows, VOTES), roots).collect()}
    assert got == {"c": "r", "a": "c", "b": "a", "x": "r", "y": "x"}
    assert branching.arborescences(spark.createDataFrame([], VOTES), roots).count() == 0


def test_query_has_the_fold_s_value(spark):
    from loomfact.plans import hierarchies
    from loomfact.registry import QUERIES, Tables

    folder = "/root/testdata/sf0.001"
    weights = {(r.novel, r.child, r.parent): r.weight for r in hierarchies.votes(Tables(spark, folder)).collect()}
    sums = []
    for name in ("arborescences", "arborescences_by_rounds"):
        own = {}
        for r in QUERIES[name](spark, folder).collect():
            miss, w = own.get(r.novel, (0, 0.0))
            got = weights.get((r.novel, r.child, r.parent))
            own[r.novel] = (miss + (got is None), w + (got or 0.0))
        sums.append({n: (m, round(w, 6)) for n, (m, w) in own.items()})
    assert sums[0] == sums[1] and sums[0]
