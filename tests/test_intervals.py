"""Ancestors without limits of depth: long paths, random trees, cycles, moves in order."""

import random

import pytest
from pyspark.sql import functions as F

from loomfact.operators import graph, intervals, resolve, tree

EDGES = "child long, parent long"


def random_tree(rng, n, roots=2):
    return [(i, rng.randrange(max(0, i - 5) if rng.random() < 0.5 else 0, i)) for i in range(roots, n)]


def line(spark, n):
    return spark.range(1, n).select(F.col("id").alias("child"), (F.col("id") - 1).alias("parent"))


def path(up, x):
    out = [x]
    while x in up:
        x = up[x]
        out.append(x)
    return out


def test_path_of_ten_thousand(spark):
    edges = line(spark, 10_000)
    tour = intervals.numbered(edges).where("node in (0, 5000, 9999)")
    assert {(r.node, r.depth, r.enter, r.leave) for r in tour.collect()} == {(0, 0, 0, 19999), (5000, 5000, 5000, 14999), (9999, 9999, 9999, 10000)}
    marked = spark.createDataFrame([(3,)], "node long")
    assert intervals.nearest_marked(edges, marked).where("node = 9999").first() == (9999, 3, 9996)
    ranks = spark.range(10_000).select(F.col("id").alias("node"), (F.col("id") * 0).alias("rank"))
    assert resolve.tiers(edges, ranks.withColumn("rank", F.lit(3))).where("node = 9999").first().tier == 10_002


def test_random_forests(spark):
    rng = random.Random(2)
    rows = random_tree(rng, 300)
    up, edges = dict(rows), spark.createDataFrame(rows, EDGES).repartition(3)
    tour = graph.cut(intervals.numbered(edges))
    places = [x for r in tour.collect() for x in ((r.root, r.enter), (r.root, r.leave))]
    assert len(places) == len(set(places)) == 600
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(500)] + [(5, 5), (0, 1), (0, 999)]
    asked = spark.createDataFrame(pairs, "a long, b long")
    assert all(r.above == (r.a in path(up, r.b) and r.b < 300) for r in intervals.above_or_same(asked, tour).collect())
    got = {(r.a, r.b): (r.ancestor, r.depth) for r in intervals.common_ancestors(asked, tour).collect()}
    for a, b in pairs:
        both = [x for x in path(up, a) if x in path(up, b)]
        assert got.get((a, b)) == ((both[0], len(path(up, both[0])) - 1) if both else None)
    marks = {x for x in range(300) if rng.random() < 0.1}
    near = {r.node: (r.ancestor, r.steps) for r in intervals.nearest_marked(edges, spark.createDataFrame([(m,) for m in marks], "node long")).collect()}
    for x in range(300):
        above = [(a, k) for k, a in enumerate(path(up, x)) if k and a in marks]
        assert near.get(x) == (above[0] if above else None)
    ranks = {x: rng.randrange(7) for x in range(300)}
    tiers = {r.node: r.tier for r in resolve.tiers(edges, spark.createDataFrame(list(ranks.items()), "node long, rank long")).collect()}
    want = dict(ranks)
    for x, p in sorted(rows):
        want[x] = max(ranks[x], want[p] + 1)
    assert tiers == {x: want[x] for x in up}


def test_cycles_and_empty(spark):
    rows = [(1, 2), (2, 3), (3, 1), (4, 3), (5, 4), (7, 6), (9, 9)]
    edges = spark.createDataFrame(rows, EDGES)
    assert {r.node for r in intervals.numbered(edges).collect()} == {6, 7}
    assert {r.child for r in tree.on_cycles(edges).collect()} == {1, 2, 3, 9}
    marked = spark.createDataFrame([(3,), (6,)], "node long")
    assert {tuple(r) for r in intervals.nearest_marked(edges, marked).collect()} >= {(2, 3, 1), (1, 3, 2), (4, 3, 1), (5, 3, 2), (7, 6, 1)}
    none = edges.limit(0)
    assert intervals.numbered(none).count() == 0 and intervals.nearest_marked(none, marked).count() == 0
    assert intervals.common_ancestors(spark.createDataFrame([(1, 2)], "a long, b long"), intervals.numbered(none)).count() == 0


def in_order(rows, moves):
    up, done = dict(rows), {}
    for seq, child, parent in sorted(moves):
        ok = child not in path(up, parent)
        if ok:
            up[child] = parent
        done[seq] = ok
    return up, done


def test_two_moves_that_only_together_make_a_cycle(spark):
    rows = [(1, 0), (2, 0), (3, 1), (4, 2)]
    moves = [(1, 1, 4), (2, 2, 3), (3, 2, 2), (4, 5, 3), (5, 3, 5)]
    done, after = intervals.settled(spark.createDataFrame(rows, EDGES), spark.createDataFrame(moves, "seq long, child long, parent long"))
    assert {r.seq: r.done for r in done.collect()} == {1: True, 2: False, 3: False, 4: True, 5: False} == in_order(rows, moves)[1]
    assert {(r.child, r.parent) for r in after.collect()} == {(1, 4), (2, 0), (3, 1), (4, 2), (5, 3)}


@pytest.mark.parametrize("seed", [1, 2])
def test_moves_in_order(spark, seed):
    rng = random.Random(seed)
    rows = random_tree(rng, 60)
    moves = [(i, rng.randrange(60), rng.randrange(64)) for i in range(14)]
    done, after = intervals.settled(spark.createDataFrame(rows, EDGES), spark.createDataFrame(moves, "seq long, child long, parent long"))
    up, want = in_order(rows, moves)
    assert {r.seq: r.done for r in done.collect()} == want
    assert {r.child: r.parent for r in after.collect()} == up


def test_shortest_paths_of_any_length(spark):
    got = graph.shortest_paths(line(spark, 40).select(F.col("child").alias("a"), F.col("parent").alias("b")), 0)
    assert got.agg(F.max("steps")).first()[0] == 39
