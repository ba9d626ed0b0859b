"""Resampling within strata against the binomial law and a plain bootstrap."""

import random

import numpy as np

from loomfact.operators import evaluate


def table(spark, sizes):
    return spark.createDataFrame([(s, int(i < e)) for s, (n, e) in sizes.items() for i in range(n)] + [("a", None)], "novel string, flag int")


def test_interval_equals_a_plain_bootstrap(spark):
    sizes = {"a": (300, 30), "b": (50, 25), "c": (10, 0), "d": (1, 1)}
    got = evaluate.bootstrap(table(spark, sizes), "novel", "flag", 8000).first()
    total = sum(n for n, _ in sizes.values())
    assert got.nodes == total and abs(got.point - (1 - 56 / total)) < 1e-12
    rng = random.Random(1)
    flags = {s: [1] * e + [0] * (n - e) for s, (n, e) in sizes.items()}
    plain = sorted(1 - sum(sum(rng.choices(f, k=len(f))) for f in flags.values()) / total for _ in range(4000))
    assert abs(got.low - plain[100]) < 0.006 and abs(got.high - plain[3900]) < 0.006
    var = sum(n * (e / n) * (1 - e / n) for n, e in sizes.values()) / total**2
    assert abs(got.std / var**0.5 - 1) < 0.04 and abs(got.mean - got.point) < 0.002


def test_sizes_are_kept_and_draws_repeat(spark):
    df = table(spark, {"a": (40, 7), "b": (9, 9)})
    one = sorted(map(tuple, evaluate.resampled(df, "novel", "flag", 700).collect()))
    two = sorted(map(tuple, evaluate.resampled(df.repartition(7), "novel", "flag", 700).collect()))
    assert one == two and [r[0] for r in one] == list(range(700)) and {r[2] for r in one} == {49}
    assert all(9 <= r[1] <= 49 for r in one) and len({r[1] for r in one}) > 8
    assert sorted(map(tuple, evaluate.resampled(df, "novel", "flag", 700, 7).collect())) != one


def test_more_values_than_two(spark):
    df = spark.createDataFrame([("a", v) for v in (0, 1, 1, 2, 5)] * 20, "novel string, flag int")
    totals = [r.total for r in evaluate.resampled(df, "novel", "flag", 2000).collect()]
    assert abs(np.mean(totals) - 180) < 3 and abs(np.var(totals) / (100 * np.var([0, 1, 1, 2, 5])) - 1) < 0.15


def test_strata(spark):
    got = evaluate.strata(table(spark, {"a": (40, 7), "b": (9, 9)}), "novel", "flag").collect()
    assert sorted(map(tuple, got)) == [("a", 40, 7, 8250), ("b", 9, 9, 0)]
