"""Communities against planted partitions and a single-machine run."""

import random

from loomfact.operators import communities as cm

EDGES = "a string, b string, weight double"


def planted(rng, groups, size, inner, outer):
    names = [(g, f"g{g}n{i}") for g in range(groups) for i in range(size)]
    rows = []
    for i, (g, a) in enumerate(names):
        for h, b in names[i + 1 :]:
            if rng.random() < (inner if g == h else outer):
                rows.append((a, b, float(rng.randrange(1, 4))))
    return rows


def plain_modularity(rows, of):
    k, m = {}, sum(w for _, _, w in rows)
    for a, b, w in rows:
        k[a], k[b] = k.get(a, 0) + w, k.get(b, 0) + w
    inner = sum(w for a, b, w in rows if of[a] == of[b])
    total = {}
    for n, x in k.items():
        total[of[n]] = total.get(of[n], 0) + x
    return inner / m - sum(x * x for x in total.values()) / (2 * m) ** 2


def greedy(rows):
    """One node after the other to the best community until nothing moves, then pairs of communities merged while that gains."""
    of = {n: n for r in rows for n in r[:2]}
    changed = True
    while changed:
        changed = False
        for n in sorted(of):
            best = max(sorted({of[b] for a, b, _ in rows if a == n} | {of[a] for a, b, _ in rows if b == n} | {of[n]}), key=lambda c: plain_modularity(rows, of | {n: c}))
            if plain_modularity(rows, of | {n: best}) > plain_modularity(rows, of) + 1e-9:
                of[n], changed = best, True
    while True:
        names = sorted(set(of.values()))
        merged = [{n: (x if c == y else c) for n, c in of.items()} for i, x in enumerate(names) for y in names[i + 1 :]]
        best = max(merged, key=lambda o: plain_modularity(rows, o), default=of)
        if plain_modularity(rows, best) <= plain_modularity(rows, of) + 1e-9:
            return of
        of = best


def test_planted_partition_is_found(spark):
    rows = planted(random.Random(1), 4, 12, 0.8, 0.02)
    edges = spark.createDataFrame(rows, EDGES).repartition(3)
    got = {r.node: r.community for r in cm.communities(edges).collect()}
    assert len(got) == 48 and len(set(got.values())) == 4
    assert all((got[a] == got[b]) == (a[:2] == b[:2]) for a in got for b in got)
    assert all(c == min(n for n in got if got[n] == c) for c in got.values())
    assert abs(cm.modularity(edges, spark.createDataFrame(list(got.items()), "node string, community string")) - plain_modularity(rows, got)) < 1e-9


def test_as_good_as_a_single_machine(spark):
    rows = planted(random.Random(3), 3, 8, 0.5, 0.12)
    edges = spark.createDataFrame(rows, EDGES)
    got = {r.node: r.community for r in cm.communities(edges).collect()}
    assert plain_modularity(rows, got) >= plain_modularity(rows, greedy(rows)) - 0.03


def test_tree_of_levels_and_empty(spark):
    rows = planted(random.Random(2), 2, 6, 1.0, 0.0) + [("g0n0", "g1n0", 0.5)]
    edges = spark.createDataFrame(rows, EDGES)
    levels = cm.at_resolutions(edges, (0.01, 1.0))
    coarse = {r.community for r in levels.where("level = 0").collect()}
    assert len(coarse) == 1 and len({r.community for r in levels.where("level = 1").collect()}) == 2
    up = {r.child: r.parent for r in cm.community_tree(levels, edges).collect()}
    assert len(up) == 11 and len(set(up.values())) == 2
    none = spark.createDataFrame([], EDGES)
    assert cm.communities(none).count() == 0
