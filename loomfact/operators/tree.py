"""Trees of places as (child, parent) rows: depth, chains, order, cycles, health and repairs.

Ancestors come from pointer doubling: after k rounds each node knows its ancestor 2**k
steps up, so a tree of depth d takes log2(d) joins, and cycles show as nodes that never
reach a root.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .graph import cut


def roots(edges: DataFrame) -> DataFrame:
    """Parents that are no child."""
    return edges.select(F.col("parent").alias("node")).distinct().join(edges.select(F.col("child").alias("node")), "node", "left_anti")


def lifted(edges: DataFrame) -> DataFrame:
    """node, root (null on or below a cycle) and depth (a root's is 0)."""
    one = edges.select(F.col("child").alias("node"), F.col("parent").alias("up"), F.lit(1).cast("long").alias("depth"))
    top = roots(edges).select("node", F.lit(None).cast(edges.schema["parent"].dataType).alias("up"), F.lit(0).cast("long").alias("depth"))
    state, before = cut(one.union(top).withColumn("root", F.when(F.col("up").isNull(), F.col("node")))), -1
    while True:
        above = state.select(F.col("node").alias("a"), F.col("up").alias("a_up"), F.col("depth").alias("a_depth"), F.col("root").alias("a_root"))
        j = state.where("root is null").join(above, F.col("up") == F.col("a"))  # rows that are done leave the join
        moved = j.select("node", F.when(F.col("a_root").isNull(), F.col("a_up")).alias("up"), (F.col("depth") + F.col("a_depth")).alias("depth"), F.col("a_root").alias("root"))
        state = cut(state.where("root is not null").unionByName(moved.select(state.columns)))
        left = state.where("root is null").count()
        if left in (0, before):  # a round that reaches no further node leaves only those on and below cycles
            break
        before = left
    return state.select("node", "root", F.when(F.col("root").isNotNull(), F.col("depth")).alias("depth"))


def chains(edges: DataFrame) -> DataFrame:
    """node and its chain of ancestors, nearest first, joined by ' > '; stops before a repeat.

    Below a root the chains double each round: a chain is the one so far and that of its
    last node. On and below cycles they grow by one node a round, up to the first repeat.
    """
    own = edges.select(F.col("child").alias("node"), F.col("parent").alias("up"))
    stuck = cut(lifted(edges).where("root is null").select("node"))
    state = cut(own.join(stuck, "node", "left_anti").select("node", "up", F.array("up").alias("path")))
    while state.where("up is not null").limit(1).count():
        above = state.select(F.col("node").alias("a"), F.col("up").alias("a_up"), F.col("path").alias("a_path"))
        j = state.join(above, F.col("up") == F.col("a"), "left")
        state = cut(j.select("node", F.col("a_up").alias("up"), F.when(F.col("a").isNull(), F.col("path")).otherwise(F.concat("path", "a_path")).alias("path")))
    done = state.select("node", "path")
    state = own.join(stuck, "node", "left_semi").select("node", "up", F.array("node", "up").alias("path"))
    state = cut(state.where("node <> up"))
    above = own.select(F.col("node").alias("a"), F.col("up").alias("a_up"))
    while state.limit(1).count():
        j = cut(state.join(above, F.col("up") == F.col("a"), "left").withColumn("more", ~F.array_contains("path", F.col("a_up"))))
        done = done.union(j.where(~F.col("more")).select("node", F.slice("path", F.lit(2), F.size("path"))))
        state = j.where("more").select("node", F.col("a_up").alias("up"), F.concat("path", F.array("a_up")).alias("path"))
    return done.select("node", F.array_join("path", " > ").alias("chain"), F.size("path").cast("long").alias("length"))


def depth_first(edges: DataFrame) -> DataFrame:
    """node, depth and its path from the root, by which rows sort in pre-order (children by name)."""
    up = chains(edges)
    path = F.reverse(F.split(F.concat_ws(" > ", F.col("node").cast("string"), "chain"), " > "))
    tops = roots(edges).select(F.col("node"), F.col("node").cast("string").alias("path"), F.lit(0).cast("long").alias("depth"))
    return up.select("node", F.array_join(path, " > ").alias("path"), F.col("length").alias("depth")).unionByName(tops.select("node", "path", "depth"))


def uber_root(edges: DataFrame) -> DataFrame:
    """The root with most children, the smallest on a tie."""
    n = edges.groupBy("parent").agg(F.count("*").alias("n")).join(roots(edges).withColumnRenamed("node", "parent"), "parent", "left_semi")
    return n.orderBy(F.desc("n"), "parent").limit(1)


def on_cycles(edges: DataFrame) -> DataFrame:
    """Edges of the nodes on cycles: what all rows without a root reach by any number of steps.

    What is reached by more steps is part of what is reached by fewer, so as soon as twice
    the steps reach as many nodes, these are all on cycles.
    """
    stuck = lifted(edges).where("root is null").select("node")
    own = cut(edges.join(stuck, F.col("child") == F.col("node"), "left_semi").select("child", "parent"))
    inner = cut(own.join(own.select(F.col("child").alias("__c")).distinct(), F.col("parent") == F.col("__c"), "left_semi"))
    ends = inner.agg(F.count_distinct("child"), F.count_distinct("parent")).first()
    state, before, now = inner, ends[0], ends[1]
    while now < before:
        above = state.select(F.col("child").alias("__c"), F.col("parent").alias("__p"))
        state = cut(state.join(above, F.col("parent") == F.col("__c")).select("child", F.col("__p").alias("parent")).distinct())
        before, now = now, state.agg(F.count_distinct("parent")).first()[0]
    return own.join(state.select(F.col("parent").alias("child")).distinct(), "child", "left_semi").select("child", "parent")


def broken_cycles(edges: DataFrame, weights: DataFrame, loop: DataFrame | None = None) -> DataFrame:
    """``edges`` without the weakest edge (by weight, then child) of each cycle; ``loop`` are those of :func:`on_cycles`, if known."""
    from .graph import components

    loop = on_cycles(edges) if loop is None else loop
    if not loop.limit(1).count():
        return edges
    label = components(loop.select(F.col("child").alias("a"), F.col("parent").alias("b")))
    w = loop.join(weights.select("child", "parent", "weight"), ["child", "parent"], "left").join(label, F.col("child") == F.col("node"))
    weakest = w.groupBy("component").agg(F.min_by(F.struct("child", "parent"), F.struct(F.coalesce("weight", F.lit(0)), F.col("child"))).alias("e"))
    return edges.join(weakest.select("e.child", "e.parent"), ["child", "parent"], "left_anti")


def common_parents(votes: DataFrame, pairs: DataFrame) -> DataFrame:
    """For pairs (a, b): the parent with the highest sum of votes of both, neither of them, the smallest on a tie."""
    v1, v2 = votes.select(F.col("child").alias("a"), "parent", F.col("weight").alias("w1")), votes.select(F.col("child").alias("b"), "parent", F.col("weight").alias("w2"))
    j = pairs.join(v1, "a").join(v2, ["b", "parent"]).where((F.col("parent") != F.col("a")) & (F.col("parent") != F.col("b")))
    s = j.withColumn("w", F.col("w1") + F.col("w2"))
    w = W.partitionBy("a", "b").orderBy(F.desc("w"), "parent")
    return s.withColumn("k", F.row_number().over(w)).where("k = 1").select("a", "b", "parent", "w")


def health(edges: DataFrame, rank: DataFrame) -> DataFrame:
    """One row: depths, most children and who has them, inversions (parent of a finer tier), roots and nodes."""
    depth = lifted(edges)
    d = depth.agg(F.max("depth").alias("max_depth"), F.sum("depth").alias("sum_depth"), F.count("*").alias("nodes"), F.count_if(F.col("depth") == 0).alias("roots"), F.count_if(F.col("root").isNull()).alias("looped"))
    kids = edges.groupBy("parent").agg(F.count("*").alias("n"))
    top = kids.orderBy(F.desc("n"), "parent").limit(1).select(F.col("n").alias("max_children"), F.col("parent").alias("busiest"))
    r1, r2 = rank.select(F.col("node").alias("child"), F.col("rank").alias("rc")), rank.select(F.col("node").alias("parent"), F.col("rank").alias("rp"))
    bad = edges.join(r1, "child").join(r2, "parent").agg(F.count_if(F.col("rp") > F.col("rc")).alias("inversions"))
    return d.join(F.broadcast(top)).join(F.broadcast(bad))  # three single rows


def lifted_phantoms(edges: DataFrame, freq: DataFrame, rare: int = 3, kids: int = 5, ratio: int = 3, stay: int = 3, weak: int = 1) -> DataFrame:
    """Move weak children of rarely named parents with many children to the grandparent until ``stay`` remain."""
    n = edges.groupBy("parent").agg(F.count("*").alias("n"))
    f = freq.select(F.col("node"), F.col("freq"))
    phantom = n.join(f.select(F.col("node").alias("parent"), F.col("freq").alias("pf")), "parent", "left").withColumn("pf", F.coalesce("pf", F.lit(0)))
    phantom = phantom.where((F.col("pf") <= rare) & (F.col("n") >= kids) & (F.col("n") >= ratio * F.greatest(F.col("pf"), F.lit(1))))
    up = edges.select(F.col("child").alias("parent"), F.col("parent").alias("grand"))
    phantom = phantom.join(up, "parent")
    own = edges.join(f.withColumnRenamed("node", "child"), "child", "left").withColumn("freq", F.coalesce("freq", F.lit(0))).join(phantom, "parent")
    k = F.row_number().over(W.partitionBy("parent").orderBy("freq", "child"))
    moved = own.withColumn("k", k).where((F.col("k") <= F.col("n") - stay) & (F.col("freq") <= weak)).select("child", F.col("grand").alias("new"))
    return edges.join(moved, "child", "left").select("child", F.coalesce("new", "parent").alias("parent"))


def propagated(edges: DataFrame, layers: DataFrame, rounds: int = 5) -> DataFrame:
    """Children take their parent's layer where it has one, ``rounds`` times."""
    state = layers.select("node", "layer")
    for _ in range(rounds):
        own = edges.join(state.select(F.col("node").alias("parent"), F.col("layer").alias("above")), "parent").where(F.col("above").isNotNull()).select(F.col("child").alias("node"), "above")
        state = cut(state.join(own, "node", "full_outer").select("node", F.coalesce("above", "layer").alias("layer")))
    return state
