"""What keeps work in proportion to the input: joins of loops, folded trees, early ends."""

from __future__ import annotations

import random

from loomfact.operators import graph, intervals, tree


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_copies_are_not_broadcast(spark):
    small = graph.cut(spark.range(10).withColumnRenamed("id", "a"))
    j = small.select("a").join(small.selectExpr("a + 1 AS a", "a AS b"), "a")
    assert "BroadcastHashJoin" not in _plan(j) and j.count() == 9


def test_settled_moves_of_few_places_in_a_deep_tree(spark, monkeypatch):
    """Rounds number only what moves name, and agree with moves made one by one, below cycles too."""
    rng = random.Random(3)
    edges = [(k, rng.randrange(max(0, k - 4), k)) for k in range(1, 60)] + [(100, 101), (101, 102), (102, 100), (103, 102), (104, 103), (105, 104)]
    moves = [(k, rng.choice([5, 9, 17, 30, 31, 44, 200]), rng.choice([2, 9, 12, 31, 44, 58, 59, 201])) for k in range(25)] + [(90, 105, 3), (91, 7, 105)]
    parent, done = dict(edges), {}
    for k, c, p in moves:
        up, seen = p, set()
        while up is not None and up != c and up not in seen:
            seen.add(up)
            up = parent.get(up)
        done[k] = up != c
        if done[k]:
            parent[c] = p
    sizes, numbered = [], intervals.numbered
    monkeypatch.setattr(intervals, "numbered", lambda e: sizes.append(e.count()) or numbered(e))
    log, after = intervals.settled(spark.createDataFrame(edges, "child long, parent long"), spark.createDataFrame(moves, "seq long, child long, parent long"))
    assert {r.seq: r.done for r in log.collect()} == done
    assert {(r.child, r.parent) for r in after.collect()} == set(parent.items())
    assert max(sizes) < 25 < len(edges)


def test_cycles_end_early_and_right_with_several_parents(spark, monkeypatch):
    rings = [(10 * r + k, 10 * r + (k + 1) % 10) for r in range(1, 20) for k in range(10)]
    odd = [(500, 10), (501, 500), (10, 900), (11, 901), (600, 601)]
    rounds, cut = [], tree.cut
    monkeypatch.setattr(tree, "cut", lambda df: rounds.append(1) or cut(df))
    got = {r.child for r in tree.on_cycles(spark.createDataFrame(rings + odd, "child long, parent long")).collect()}
    assert got == {c for c, _ in rings}
    assert len(rounds) <= 8


def test_definition_by_place_through_all_chapters(spark):
    from loomfact.operators import facts

    rows = spark.createDataFrame([("k", 1, 1, 20, "late"), ("k", 1, 2, 10, "early")], "kind string, name long, chapter long, pos long, definition string")
    assert facts.encyclopedia(rows, ("pos", "chapter")).first() == ("k", 1, 1, 2, "early")
    assert facts.encyclopedia(rows).first().definition == "late"


def test_mentions_read_the_facts_once(spark):
    from loomfact.sources import facts

    docs = [(1, 1, '{"characters":[{"name":"a"},{"name":""},7],"item_events":[{"item_name":"i"},{"item_name":"j"}]}'), (1, 2, '{"locations":[{"name":"p"}]}'), (1, 3, "{}"), (1, 4, None)]
    got = facts.mentions(spark.createDataFrame(docs, "novel int, chapter int, fact string"), "fact")
    assert {tuple(r) for r in got.collect()} == {(1, 1, 0, "person", "a"), (1, 1, 0, "item", "i"), (1, 1, 1, "item", "j"), (1, 2, 0, "place", "p")}
    assert _plan(got).count("Generate ") <= 2 and "Union" not in _plan(got)


def test_places_of_chapters_are_made_once(spark):
    """No test of the array's size is pushed through the passes, and only plain columns are shuffled."""
    import __spark_entry__ as entry

    out = entry.queries()["validated_places"](spark, entry.SMOKE_DIR)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.splitlines() if "Filter" in line and "size(" in line]


def test_pairs_of_large_tables_are_dealt_into_more_parts(spark, monkeypatch):
    from loomfact.operators import profile

    rows = spark.range(60).selectExpr("id div 3 AS c", "id % 7 AS p")
    want = {tuple(r) for r in graph.pair_edges(rows, "c", "p").collect()}
    items = {tuple(r) for r in profile.co_items(rows, "p", "c").collect()}
    monkeypatch.setattr(graph, "PART_ROWS", 5)
    out = graph.pair_edges(rows, "c", "p")
    assert "REPARTITION_BY_NUM" in _plan(out) and {tuple(r) for r in out.collect()} == want
    assert {tuple(r) for r in profile.co_items(rows, "p", "c").collect()} == items


def test_longest_names_of_a_long_text(spark):
    """Places are read in order, not gathered in an array of the whole text."""
    from loomfact.operators import search

    names = spark.createDataFrame([("ab",), ("abc",), ("cd",)], "name string")
    docs = spark.createDataFrame([(1, "abcd " * 20_000), (2, "abab"), (3, None)], "id long, text string")
    out = search.longest(names, docs, "id", "text")
    assert "collect_list" not in _plan(out)
    assert {tuple(r) for r in out.groupBy("id", "name").count().collect()} == {(1, "abc", 20_000), (2, "ab", 2)}
