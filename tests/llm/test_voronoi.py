"""Exact top-k search against brute force."""

from collections import Counter

import numpy as np
import pytest

from loomfact.llm import voronoi


def brute(rows, k=20, every=20):
    own = [(i, v, np.floor(np.array(x, float) * 64)) for i, (v, x) in enumerate(rows) if x is not None and all(y is not None and np.isfinite(y) for y in x)]
    out = []
    for i, q, x in own:
        if q is None or q % every:
            continue
        found = []
        for j, v, y in own:
            if i != j:
                n = min(len(x), len(y))
                found.append((-int(x[:n] @ y[:n]), v is None, v, j))
        found.sort(key=lambda f: (f[0], f[1], f[2] or 0))
        out += [(q, r + 1, f[2], -f[0]) for r, f in enumerate(found[:k])]
    return Counter(out)


def answers(spark, rows, **options):
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<float>, cell int, v string").repartition(3)
    return Counter(map(tuple, voronoi.top_k(df, **options).collect()))


@pytest.fixture
def small(monkeypatch):
    for name, n in (("PIVOTS", 7), ("SAMPLE_ROWS", 60), ("BLOCK_QUERIES", 6), ("CHUNK_ROWS", 90), ("ROWS", 32)):
        monkeypatch.setattr(voronoi, name, n)


def test_clusters_ties_and_repeats(spark, small):
    rng = np.random.default_rng(3)
    centres = rng.normal(0, 3, (6, 8))
    rows = [(i, (centres[i % 6] + rng.normal(0, 0.05, 8)).astype(np.float32).tolist()) for i in range(400)]
    rows += [(400 + i, rows[0][1]) for i in range(200)] + [rows[20], rows[20], (None, rows[3][1]), (None, rows[3][1])]
    assert answers(spark, rows, k=5) == brute(rows, 5)
    assert answers(spark, rows) == brute(rows)


def test_clusters_are_pruned(spark, small):
    rng = np.random.default_rng(4)
    centres = np.eye(6) * 20
    x = np.floor((centres[np.arange(600) % 6] + rng.normal(0, 0.01, (600, 6))) * 64)
    pivots = np.unique(np.round(centres * 64), axis=0)
    df = spark.createDataFrame([(i, i, list(map(int, v))) for i, v in enumerate(x)], "rid long, vec_id long, v array<long>")
    cells = voronoi.placed(df, pivots, 20)
    from pyspark.sql import functions as F

    got = cells.groupBy("cell").agg(F.count("*").alias("rows"), F.max("far").alias("far"), F.count_if("asks").alias("asking"), F.max(F.when(F.col("asks"), F.col("far"))).alias("asking_far")).collect()
    plan = voronoi.Plan(got, pivots, 20)
    sent = voronoi.dealt(cells, plan).where("not asks").count()
    assert sent < 600 * plan.blocks / 2


def test_odd_vectors(spark, small):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (20, [0.5]), (40, []), (60, None), (80, [nan, 1.0]), (100, [None, 1.0]), (120, [inf]), (1, [-0.3, 0.01, 5.0]), (2, [0.0, 0.0]), (None, [1.0]), (-20, [0.1, 0.1])]
    assert answers(spark, rows) == brute(rows)
    assert answers(spark, rows, k=2) == brute(rows, 2)
    assert not answers(spark, rows[3:7]) and not answers(spark, [(1, [1.0])]) and not answers(spark, [(0, [1.0])])
    assert not answers(spark, [])


def test_large_components_stay_exact():
    got = voronoi.best_of(np.array([[2**40, 3]]), np.array([[2**20, 1], [2**20, 2], [5, 5]]), np.array([-1]), 2)
    assert list(zip(*map(list, got), strict=True)) == [(0, 1, 2**60 + 6), (0, 0, 2**60 + 3)]
