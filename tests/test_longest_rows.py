"""Longest names are found within a row: one row a text is shuffled, none for its places; keys may repeat."""

import random

import pytest

from loomfact.operators import search
from tests.test_search import leftmost_longest


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("shard", [8 << 20, 300])
def test_counts_of_keys_that_repeat(spark, monkeypatch, shard):
    monkeypatch.setattr(search, "SHARD_BYTES", shard)
    rng = random.Random(4)
    names = sorted({"".join(rng.choices("ab 甲😀", k=rng.randrange(1, 5))) for _ in range(40)})
    texts = [(i % 30 or None, "".join(rng.choices("ab 甲😀c", k=rng.randrange(0, 60)))) for i in range(50)] + [(7, None), (8, "")]
    known = spark.createDataFrame([(n,) for n in names], "name string")
    docs = spark.createDataFrame(texts, "k long, text string").repartition(3)
    want = {}
    for k, n, _ in (x for t in texts for x in leftmost_longest([t], names)):
        want[k, n] = want.get((k, n), 0) + 1
    rows = search.longest(known, docs, "k", "text")
    got = {}
    for r in rows.collect():
        got[r.k, r.name] = got.get((r.k, r.name), 0) + 1
    assert got == want and "hashpartitioning(k" not in _plan(rows)
    counts = search.longest_counts(known, docs, "k", "text")
    assert _plan(counts).count("hashpartitioning") == 1
    assert {(r.k, r.name): r.n for r in counts.collect()} == want


def test_a_names_place_is_no_row_of_the_shuffle(spark):
    names = spark.createDataFrame([("ab",), ("abc",)], "name string")
    out = search.longest_counts(names, spark.createDataFrame([(1, "abcd " * 50_000)], "id long, text string"), "id", "text")
    assert [tuple(r) for r in out.collect()] == [(1, "abc", 50_000)]
