"""Chapters with and without equal names go through the chain alike, without compared lambdas."""

from pyspark.sql import functions as F

from loomfact.operators import rewrite


def test_sorting_takes_no_lambda(spark):
    import __spark_entry__ as entry

    plan = entry.queries()["validated_chapters"](spark, entry.SMOKE_DIR)._jdf.queryExecution().optimizedPlan().toString()
    assert "sort_array(" in plan and "array_sort(" not in plan


def test_equal_names_are_united_and_others_kept(spark):
    kind = rewrite.CHARACTER
    rows = [
        (1, [("a", ["x", "x", "a"], "", ["p", "p"]), ("b", [], "tall", [])]),
        (2, [("a", ["x"], "", ["p"]), ("b", ["y"], "tall", []), ("a", ["z", "x"], "old", ["q"])]),
        (3, []),
    ]
    df = spark.createDataFrame(rows, f"k int, c array<{kind}>")
    more = lambda aliases, gone: F.array_distinct(F.concat(aliases, gone))
    got = {r.k: (r.u, r.v) for r in df.select("k", rewrite._merged("c", lambda c: c["name"]).alias("u"), rewrite._merged("c", lambda c: c["name"], more).alias("v")).collect()}
    plain = lambda x: [(c.name, c.aliases, c.appearance, c.places) for c in x]
    assert plain(got[1][0]) == [("a", ["x", "a"], "", ["p"]), ("b", [], "tall", [])]
    assert plain(got[1][1]) == [("a", ["x"], "", ["p"]), ("b", [], "tall", [])]
    assert plain(got[2][0]) == [("a", ["x", "z"], "old", ["p", "q"]), ("b", ["y"], "tall", [])]
    assert got[3] == ([], [])
