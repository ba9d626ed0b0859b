"""Communities of a weighted graph at several resolutions, by local moving and contraction.

In a round every node looks at the communities of its neighbours, one aggregation over the
edges, and moves where modularity gains most; a hash of the node and the round lets about
half of the nodes move at a time, so that neighbours do not swap places for ever. When a
level gains no more, its communities become the nodes of a smaller graph, until nothing
merges. Ties go to the smaller community, so results depend on the graph alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .graph import cut

#: Gain of modularity below which a round does not count, and such rounds in a row that end a level.
LEAST_GAIN, IDLE_ROUNDS = 1e-4, 2
MAX_ROUNDS, MAX_LEVELS = 16, 20


def _degrees(edges: DataFrame) -> DataFrame:
    """node and k, its weights; a loop counts twice."""
    ends = edges.select(F.col("a").alias("node"), "weight").union(edges.select("b", "weight"))
    return ends.groupBy("node").agg(F.sum("weight").alias("k"))


def modularity(edges: DataFrame, members: DataFrame, resolution: float = 1.0) -> float:
    """Modularity of communities (node, community) over edges (a, b, weight), each pair once."""
    side = lambda s: members.select(F.col("node").alias(s), F.col("community").alias(f"{s}_c"))
    inside = edges.join(side("a"), "a").join(side("b"), "b").agg(F.sum("weight").alias("all"), F.sum(F.when(F.col("a_c") == F.col("b_c"), F.col("weight")).otherwise(0.0)).alias("inner")).first()
    if not inside[0]:
        return 0.0
    squares = _degrees(edges).join(members, "node").groupBy("community").agg(F.sum("k").alias("t")).agg(F.sum(F.col("t") * F.col("t"))).first()[0]
    return inside[1] / inside[0] - resolution * squares / (2 * inside[0]) ** 2


def _level(edges: DataFrame, resolution: float) -> DataFrame:
    """node and community after local moving over one graph."""
    degree = cut(_degrees(edges))
    m2 = degree.agg(F.sum("k")).first()[0]
    state = cut(degree.select("node", F.col("node").alias("community")))
    both = cut(edges.where("a <> b").select("a", "b", "weight").union(edges.where("a <> b").select("b", "a", "weight")))
    best, top, idle = state, modularity(edges, state, resolution), 0
    for turn in range(MAX_ROUNDS):
        near = both.join(state.select(F.col("node").alias("b"), "community"), "b").groupBy(F.col("a").alias("node"), "community").agg(F.sum("weight").alias("w"))
        own = state.select("node", F.col("community").alias("own")).join(degree, "node").hint("merge")
        total = own.groupBy(F.col("own").alias("community")).agg(F.sum("k").alias("t")).hint("merge")
        stay = state.select("node", "community").withColumn("w", F.lit(0.0))
        options = near.unionByName(stay).groupBy("node", "community").agg(F.sum("w").alias("w")).join(own, "node").join(total, "community")
        here = F.col("community") == F.col("own")
        gain = F.col("w") - resolution * F.col("k") * (F.col("t") - F.when(here, F.col("k")).otherwise(0.0)) / m2
        scored = options.select("node", "community", "own", F.round(gain, 9).alias("gain"), here.alias("here"))
        moves = scored.groupBy("node", "own").agg(F.min_by("community", F.struct(-F.col("gain"), (~F.col("here")).cast("int"), "community")).alias("to"))
        may = F.pmod(F.xxhash64("node", F.lit(turn)), F.lit(2)) == 0
        state = cut(moves.select("node", F.when(may, F.col("to")).otherwise(F.col("own")).alias("community")))
        now = modularity(edges, state, resolution)
        if now > top + LEAST_GAIN:
            best, top, idle = state, now, 0
        else:
            idle += 1
            if idle == IDLE_ROUNDS:
                break
    return best


def communities(edges: DataFrame, resolution: float = 1.0) -> DataFrame:
    """node and community (its smallest node) of an undirected graph (a, b, weight); a pair's rows add up."""
    graph = cut(edges.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.sum("weight").cast("double").alias("weight")))
    members = None
    for _ in range(MAX_LEVELS):
        if not graph.limit(1).count():
            break
        step = _level(graph, resolution)
        #  A community is named after its smallest node, at every level.
        step = cut(step.withColumn("community", F.min("node").over(W.partitionBy("community"))))
        members = step if members is None else cut(members.join(step.withColumnRenamed("node", "c").withColumnRenamed("community", "up"), F.col("community") == F.col("c")).select("node", F.col("up").alias("community")))
        if not step.where("node <> community").limit(1).count():
            break
        side = lambda s: step.select(F.col("node").alias(s), F.col("community").alias(f"{s}_c"))  # noqa: B023, E731
        merged = graph.join(side("a"), "a").join(side("b"), "b")
        graph = cut(merged.groupBy(F.least("a_c", "b_c").alias("a"), F.greatest("a_c", "b_c").alias("b")).agg(F.sum("weight").alias("weight")))
    if members is None:
        return edges.select(F.col("a").alias("node"), F.col("a").alias("community")).limit(0)
    return members


def at_resolutions(edges: DataFrame, resolutions: tuple[float, ...] = (0.5, 1.0, 2.0, 4.0)) -> DataFrame:
    """level (0 the coarsest), node and community at each resolution."""
    out = None
    for level, r in enumerate(resolutions):
        one = communities(edges, r).select(F.lit(level).alias("level"), "node", "community")
        out = one if out is None else out.unionByName(one)
    return out


def community_tree(levels: DataFrame, edges: DataFrame) -> DataFrame:
    """(child, parent): each node below the most central node of its community, from the finest level on.

    Central is who has most weight on its edges, the smaller name on a tie. A node that is
    the centre itself goes below the centre of the next coarser level; centres of the
    coarsest level are roots.
    """
    known = levels.join(_degrees(edges), "node")
    centre = known.groupBy("level", "community").agg(F.min_by("node", F.struct(-F.col("k"), F.col("node"))).alias("centre"))
    own = levels.join(centre, ["level", "community"]).where("node <> centre")
    return own.groupBy("node").agg(F.max_by("centre", "level").alias("parent")).select(F.col("node").alias("child"), "parent")
