"""Connected components of an edge table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .common import dropped, written

MAX_ROUNDS = 60


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, component (its smallest node) for every node of an edge.

    Both stars shrink the trees towards the smallest node; every round is a minimum
    for each node (combined before the shuffle) joined back to the edges. Rounds grow
    with the logarithm of the longest path. An edge of a node with itself keeps it.
    """
    own = edges.select(F.col(a).alias("u"), F.col(b).alias("v"))
    state = written(own.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    if not state.where("u <> v").limit(1).count():
        return state.select(F.col("u").alias("node"), F.col("u").alias("component")).distinct()
    nodes = state.where("u = v").select("u").distinct()
    state, mark = state.where("u > v"), None
    for _ in range(MAX_ROUNDS):
        both = state.select("u", "v").union(state.select(F.col("v"), F.col("u")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
        #  Large star: larger neighbours move to the smallest neighbour.
        large = both.where("v > u").join(least, F.col("u") == F.col("w")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        #  Small star: smaller neighbours move to the smallest of them.
        low = large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), "m")
        moved = large.join(low, F.col("u") == F.col("w"))
        small = moved.select("v", "m").where("v <> m").union(moved.select(F.col("u"), "m"))
        #  Whether a round changed anything is seen while its edges are written, without a job of its own.
        seen = Observation()
        nxt = small.toDF("u", "v").where("u > v").distinct()
        nxt = written(nxt.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("sum")), "edges")
        now = seen.get
        dropped(state)
        state = nxt
        if mark == now:
            break
        mark = now
    else:
        raise RuntimeError("the components did not settle")
    found = state.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = state.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("component"))
    found = found.union(roots)
    return found.union(nodes.join(found, nodes.u == found.node, "left_anti").select("u", "u").toDF("node", "component"))
