"""Ancestors in trees of any depth: paths folded by pointer doubling, Euler tours, common ancestors, moves in order.

Nothing here knows a number of levels. A path to the root is folded in as many joins as
its length has binary digits. A tour around each tree gives every node an interval that
holds those of all below it, so that an ancestor test is a comparison after two joins, and
the common ancestor of two nodes the highest point of the tour between them, looked up in
a table of the highest points of all stretches of 1, 2, 4, ... steps.

Rows that are done leave the joins, and children of one place are chained in buckets, so
neither roots nor places with very many children make a hot key. Nodes on cycles and below
them have no root; they are left out.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .graph import cut
from .tree import lifted, roots

#: Buckets of the children of one place.
BUCKETS = 256


def folded(edges: DataFrame, values: DataFrame, how: Callable[[Column, Column], Column]) -> DataFrame:
    """node, value: ``how`` (F.least, F.greatest) over the values of the node and all its ancestors; a missing value is passed over.

    ``values`` has node and value. A node on or below a cycle has no row.
    """
    nodes = edges.select(F.col("child").alias("node"), F.col("parent").alias("up")).unionByName(
        edges.select(F.col("parent").alias("node")).distinct().join(edges.select(F.col("child").alias("node")), "node", "left_anti").withColumn("up", F.lit(None).cast(edges.schema["parent"].dataType))
    )
    state = cut(nodes.join(values.select("node", "value"), "node", "left"))
    size, steps = state.count(), 1
    while steps <= size and state.where("up is not null").limit(1).count():
        above = state.select(F.col("node").alias("__n"), F.col("up").alias("__u"), F.col("value").alias("__v"))
        moved = state.where("up is not null").join(above, F.col("up") == F.col("__n")).select("node", F.col("__u").alias("up"), how("value", "__v").alias("value"))
        state, steps = cut(state.where("up is null").unionByName(moved)), steps * 2
    return state.where("up is null").select("node", "value")


def nearest_marked(edges: DataFrame, marked: DataFrame, own: bool = False) -> DataFrame:
    """(node, ancestor, steps): the closest marked ancestor of each child, at any height; with ``own`` a marked node is its own."""
    goal = marked.select(F.col("node").alias("__m")).distinct()
    start = edges.select(F.col("child").alias("node"), F.col("parent").alias("up"), F.lit(1).cast("long").alias("steps"))
    if own:
        itself = goal.select(F.col("__m").alias("node"), F.col("__m").alias("up"), F.lit(0).cast("long").alias("steps"))
        start = start.join(goal, F.col("node") == F.col("__m"), "left_anti").unionByName(itself)
    state = cut(start.join(goal, F.col("up") == F.col("__m"), "left").withColumn("found", F.col("__m").isNotNull()).drop("__m"))
    size, reach = state.count(), 1
    while reach <= size and state.where("not found").limit(1).count():
        above = state.select(F.col("node").alias("__n"), F.col("up").alias("__u"), F.col("steps").alias("__s"), F.col("found").alias("__f"))
        moved = state.where("not found").join(above, F.col("up") == F.col("__n")).select("node", F.col("__u").alias("up"), (F.col("steps") + F.col("__s")).alias("steps"), F.col("__f").alias("found"))
        state, reach = cut(state.where("found").unionByName(moved)), reach * 2
    return state.where("found").select("node", F.col("up").alias("ancestor"), "steps")


def numbered(edges: DataFrame) -> DataFrame:
    """node, up (its parent), root, depth, enter and leave: the node's first and last place on the tour around its tree."""
    known = cut(lifted(edges).where("root is not null"))
    own = edges.join(known.select(F.col("node").alias("child")), "child", "left_semi").select("child", "parent", F.pmod(F.xxhash64("child"), F.lit(BUCKETS)).alias("b"))
    following = F.lead("child").over(W.partitionBy("parent", "b").orderBy("child"))
    heads = own.groupBy("parent", "b").agg(F.min("child").alias("head"))
    heads = heads.withColumn("next_head", F.lead("head").over(W.partitionBy("parent").orderBy("b")))
    first = heads.groupBy("parent").agg(F.min_by("head", "b").alias("first"))
    chained = own.withColumn("following", following).join(heads, ["parent", "b"]).select(F.col("child").alias("node"), F.col("parent").alias("up"), F.coalesce("following", "next_head").alias("beside"))
    nodes = cut(known.join(chained, "node", "left").join(first.withColumnRenamed("parent", "node"), "node", "left"))
    down = nodes.select("node", F.lit(False).alias("out"), F.coalesce("first", "node").alias("next"), F.col("first").isNull().alias("next_out"))
    back = nodes.select("node", F.lit(True).alias("out"), F.coalesce("beside", "up").alias("next"), F.col("beside").isNull().alias("next_out"))
    #  Steps to the end of the tour: each round doubles how far a row looks.
    state = cut(down.unionByName(back).withColumn("steps", F.when(F.col("next").isNotNull(), 1).otherwise(0).cast("long")))
    while state.where("next is not null").limit(1).count():
        to = state.select(F.col("node").alias("__n"), F.col("out").alias("__o"), F.col("next").alias("__x"), F.col("next_out").alias("__xo"), F.col("steps").alias("__s"))
        moved = state.where("next is not null").join(to, (F.col("next") == F.col("__n")) & (F.col("next_out") == F.col("__o")))
        moved = moved.select("node", "out", F.col("__x").alias("next"), F.col("__xo").alias("next_out"), (F.col("steps") + F.col("__s")).alias("steps"))
        state = cut(state.where("next is null").unionByName(moved))
    left = state.groupBy("node").agg(F.max(F.when(~F.col("out"), F.col("steps"))).alias("e"), F.max(F.when(F.col("out"), F.col("steps"))).alias("l"))
    all_ = nodes.select("node", "up", "root", "depth").join(left, "node")
    total = all_.where("depth = 0").select(F.col("node").alias("root"), F.col("e").alias("total"))
    return cut(all_.join(total, "root").select("node", "up", "root", "depth", (F.col("total") - F.col("e")).alias("enter"), (F.col("total") - F.col("l")).alias("leave")))


def _ends(pairs: DataFrame, tour: DataFrame) -> DataFrame:
    side = lambda s: tour.select(F.col("node").alias(s), F.col("root").alias(f"{s}_root"), F.col("enter").alias(f"{s}_enter"), F.col("leave").alias(f"{s}_leave"))
    return pairs.join(side("a"), "a", "left").join(side("b"), "b", "left")


def above_or_same(pairs: DataFrame, tour: DataFrame) -> DataFrame:
    """``pairs`` with ``above``: whether a is b or an ancestor of b, by :func:`numbered` intervals; false for nodes without one."""
    both = _ends(pairs, tour)
    holds = (F.col("a_root") == F.col("b_root")) & (F.col("a_enter") <= F.col("b_enter")) & (F.col("b_leave") <= F.col("a_leave"))
    return both.select(*pairs.columns, F.coalesce(holds, F.lit(False)).alias("above"))


def common_ancestors(pairs: DataFrame, tour: DataFrame) -> DataFrame:
    """a, b, ancestor (the lowest that both have, one of them included) and its depth; pairs of different trees have no row."""
    asked = _ends(pairs.select("a", "b").distinct(), tour).where(F.col("a_root") == F.col("b_root"))
    asked = asked.select("a", "b", F.col("a_root").alias("root"), F.least("a_enter", "b_enter").alias("from"), F.greatest("a_enter", "b_enter").alias("to"))
    #  The largest stretch of 2^level places that fits between both, once from either end.
    asked = cut(asked.withColumn("level", F.floor(F.log2(F.col("to") - F.col("from") + 1)).cast("int")))
    entered = tour.select("root", F.col("enter").alias("at"), F.struct("depth", "node").alias("top"))
    left = tour.select("root", F.col("leave").alias("at"), F.struct(F.greatest(F.col("depth") - 1, F.lit(0)).alias("depth"), F.coalesce("up", "node").alias("node")).alias("top"))
    table, level, found = cut(entered.unionByName(left)), 0, None
    highest = asked.agg(F.max("level")).first()[0]
    while highest is not None and level <= highest:
        #  Both ends of a stretch are looked up in one join.
        ends = F.explode(F.array(F.col("from"), F.col("to") - (1 << level) + 1)).alias("at")
        here = asked.where(F.col("level") == level).select("a", "b", "root", ends)
        hit = cut(here.join(table, ["root", "at"]).groupBy("a", "b").agg(F.min("top").alias("top")))
        found = hit if found is None else found.unionByName(hit)
        if level == highest:
            break
        further = table.select("root", (F.col("at") - (1 << level)).alias("at"), F.col("top").alias("__t"))
        table, level = cut(table.join(further, ["root", "at"]).select("root", "at", F.least("top", "__t").alias("top"))), level + 1
    if found is None:
        return asked.select("a", "b", F.col("a").alias("ancestor"), F.lit(0).cast("long").alias("depth")).limit(0)
    return found.select("a", "b", F.col("top.node").alias("ancestor"), F.col("top.depth").alias("depth"))


def _between(edges: DataFrame, named: DataFrame) -> DataFrame:
    """The tree of the ``named`` nodes alone: each below its nearest ancestor that is named or a root.

    Who is above whom stays, also after moves among them, as the nodes left out never move.
    A node below a cycle without named nodes is below itself, so it has no root here either.
    """
    near = nearest_marked(edges, named.unionByName(roots(edges))).select(F.col("node").alias("child"), F.col("ancestor").alias("parent"))
    own = edges.select("child").join(named, F.col("child") == F.col("node"), "left_semi")
    return cut(own.join(near, "child", "left").select("child", F.coalesce("parent", "child").alias("parent")))


def settled(edges: DataFrame, moves: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The moves (seq, child, parent) with ``done``, and the tree after them, each move made in order unless it closes a cycle.

    A round decides the moves before the first one that depends on another: one whose new
    parent has an ancestor (or is a node) that an earlier move of the round takes elsewhere.
    Those before it see the tree as the round found it, so one tour decides them all.
    There are as many rounds as such dependencies follow upon each other. They work on the
    places that moves name alone, see :func:`_between`.
    """
    left, out = cut(moves.select("seq", "child", "parent")), None
    tree = _between(edges, left.select(F.col("child").alias("node")).union(left.select("parent")).distinct())
    while left.limit(1).count():
        first_move = left.groupBy(F.col("child").alias("node")).agg(F.min("seq").alias("value"))
        touched = folded(tree, first_move, F.least)
        #  Nodes that the tree does not have yet are touched by their own first move alone.
        own = first_move.select(F.col("node").alias("parent"), F.col("value").alias("own"))
        asked = left.join(touched.select(F.col("node").alias("parent"), F.col("value").alias("path")), "parent", "left").join(own, "parent", "left")
        waits = asked.where((F.coalesce(F.least("path", "own"), F.col("seq")) < F.col("seq")) & (F.col("child") != F.col("parent")))
        until = waits.agg(F.min("seq")).first()[0]
        now = left if until is None else left.where(F.col("seq") < until)
        tested = above_or_same(now.select("seq", F.col("child").alias("a"), F.col("parent").alias("b")), numbered(tree))
        tested = cut(tested.select("seq", F.col("a").alias("child"), F.col("b").alias("parent"), (~F.col("above") & (F.col("a") != F.col("b"))).alias("done")))
        out = tested if out is None else out.unionByName(tested)
        last = tested.where("done").groupBy("child").agg(F.max_by("parent", "seq").alias("__new"))
        both = tree.join(last, "child", "full_outer")
        tree = cut(both.select("child", F.coalesce("__new", "parent").alias("parent")))
        left = cut(left.limit(0) if until is None else left.where(F.col("seq") >= until))
    if out is None:
        return moves.select("seq", "child", "parent", F.lit(True).alias("done")), edges.select("child", "parent")
    last = out.where("done").groupBy("child").agg(F.max_by("parent", "seq").alias("__new"))
    return out, edges.join(last, "child", "full_outer").select("child", F.coalesce("__new", "parent").alias("parent"))
