"""Passes over a tree of places and its votes, and their evaluation against gold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import intervals
from .graph import cut
from .tree import broken_cycles, lifted, on_cycles, roots


def contained_flipped(edges: DataFrame) -> DataFrame:
    """Edges the other way round where the parent's name starts with the child's."""
    swap = F.startswith(F.col("parent"), F.col("child")) & (F.col("parent") != F.col("child"))
    return edges.select(F.when(swap, F.col("parent")).otherwise(F.col("child")).alias("child"), F.when(swap, F.col("child")).otherwise(F.col("parent")).alias("parent"))


def ranked_edges(edges: DataFrame, rank: DataFrame) -> DataFrame:
    """Edges with the ranks of both ends (child_rank, parent_rank), null for unknown ones."""
    r = lambda side: rank.select(F.col("node").alias(side), F.col("rank").alias(f"{side}_rank"))
    return edges.join(r("child"), "child", "left").join(r("parent"), "parent", "left").select("child", "parent", "child_rank", "parent_rank")


def without_inversions(edges: DataFrame, rank: DataFrame) -> DataFrame:
    """Edges without those of parents that are finer than a child of theirs: such a parent leaves its own place."""
    bad = ranked_edges(edges, rank).where(F.col("parent_rank") > F.col("child_rank")).select(F.col("parent").alias("child")).distinct()
    return edges.join(bad, "child", "left_anti").select("child", "parent")


def tiers(edges: DataFrame, rank: DataFrame) -> DataFrame:
    """node and tier of children: the own rank, but one below the parent's tier at least.

    A tier is the most that any place on the way up asks for: its rank and the steps down
    from it. So it is one fold over the paths of rank minus depth.
    """
    depth = lifted(edges).where("root is not null").select("node", "depth")
    asks = depth.join(rank.select("node", "rank"), "node", "left").select("node", (F.col("rank") - F.col("depth")).alias("value"))
    top = intervals.folded(edges, asks, F.greatest).join(depth.where("depth > 0"), "node")
    return top.select("node", (F.col("value") + F.col("depth")).alias("tier"))


def acyclic(edges: DataFrame, weights: DataFrame, uber_root: str | None = None) -> DataFrame:
    """Edges with the weakest of each cycle cut, again and again until none is left; what is cut hangs below ``uber_root``."""
    out = cut(edges.select("child", "parent"))
    while (loop := cut(on_cycles(out))).limit(1).count():
        out = cut(broken_cycles(out, weights, loop).select("child", "parent"))
    if uber_root is None:
        return out
    lost = edges.select("child").distinct().join(out.select("child"), "child", "left_anti").where(F.col("child") != uber_root)
    return out.union(lost.select("child", F.lit(uber_root)))


def first_era(names: DataFrame, eras: tuple[tuple[str, tuple[str, ...]], ...], default: str, least: int = 2) -> DataFrame:
    """(novel, era): the first era of the table of which ``least`` keywords occur in any of the novel's names, else ``default``."""
    hits = [sum((F.max(F.contains(F.col("name"), F.lit(w)).cast("int")) for w in words), F.lit(0)).alias(era) for era, words in eras]
    g = names.groupBy("novel").agg(*hits)
    return g.select("novel", F.coalesce(*(F.when(F.col(era) >= least, F.lit(era)) for era, _ in eras), F.lit(default)).alias("era"))


def with_priors(votes: DataFrame, novels: DataFrame, priors: DataFrame) -> DataFrame:
    """Votes with those that a table (title, child, parent, weight) has for the novel's title."""
    own = novels.join(priors, "title").select("novel", "child", "parent", "weight")
    return votes.select("novel", "child", "parent", "weight").unionByName(own).groupBy("novel", "child", "parent").agg(F.sum("weight").alias("weight"))


def caught(orphans: DataFrame, placed: DataFrame, uber_root: str) -> DataFrame:
    """(child, parent) for names without a place: below the longest placed name that each begins with, else below the root.

    A name's own beginnings are joined, so nothing is compared with all placed names.
    """
    size = F.char_length("child")
    starts = orphans.select(F.col("name").alias("child")).where(size > 1).select("child", F.explode(F.transform(F.sequence(F.lit(1), size - 1), lambda k: F.substring(F.col("child"), F.lit(1), k))).alias("parent"))
    found = starts.join(placed.select(F.col("name").alias("parent")).distinct(), "parent", "left_semi")
    best = found.groupBy("child").agg(F.max_by("parent", F.char_length("parent")).alias("parent"))
    return orphans.select(F.col("name").alias("child")).distinct().join(best, "child", "left").select("child", F.coalesce("parent", F.lit(uber_root)).alias("parent"))


def safe_moves(edges: DataFrame, moves: DataFrame) -> DataFrame:
    """The moves (child, parent) that make no cycle in the tree as it is, each taken for itself."""
    asked = moves.where(F.col("child") != F.col("parent")).select(F.col("child").alias("a"), F.col("parent").alias("b"))
    kept = intervals.above_or_same(asked, intervals.numbered(edges)).where("not above")
    return kept.select(F.col("a").alias("child"), F.col("b").alias("parent"))


def applied(edges: DataFrame, changes: DataFrame) -> DataFrame:
    """Edges after the selected changes (child, parent, selected); a null parent takes the place away."""
    c = changes.where("selected").select("child", F.col("parent").alias("__new"), F.lit(True).alias("__set"))
    both = edges.join(c, "child", "full_outer")
    return both.select("child", F.when(F.col("__set"), F.col("__new")).otherwise(F.col("parent")).alias("parent")).where(F.col("parent").isNotNull())


def subtrees(edges: DataFrame) -> DataFrame:
    """node and the child of a root whose subtree it is in; roots are left out."""
    tops = roots(edges)
    first = edges.join(tops, F.col("parent") == F.col("node"), "left_semi").select("child").distinct()
    below = edges.join(first, "child", "left_anti")
    if not below.limit(1).count():
        return first.select(F.col("child").alias("node"), F.col("child").alias("subtree"))
    return lifted(below).where("root is not null").select("node", F.col("root").alias("subtree")).union(first.join(below.select(F.col("parent").alias("child")).distinct(), "child", "left_anti").select("child", "child"))


def depth_histogram(edges: DataFrame) -> DataFrame:
    return lifted(edges).groupBy("depth").agg(F.count("*").alias("nodes"))


def chain_accuracy(predicted: DataFrame, gold: DataFrame) -> DataFrame:
    """node, length of its gold chain and how far the predicted chain agrees from the node on, for the leaves of the gold tree.

    The chains part at the nearest node, the leaf included, that has another parent in
    either; a root has none.
    """
    leaf = gold.select(F.col("child").alias("node")).join(gold.select(F.col("parent").alias("node")).distinct(), "node", "left_anti")
    said = predicted.select("child", F.col("parent").alias("said"))
    parted = gold.join(said, "child", "left").where(~F.col("parent").eqNullSafe(F.col("said"))).select(F.col("child").alias("node"))
    near = intervals.nearest_marked(gold, parted, own=True).select("node", F.col("steps").alias("__s"))
    length = lifted(gold).where("root is not null").select("node", F.col("depth").alias("length"))
    return leaf.join(length, "node").join(near, "node", "left").select("node", "length", F.coalesce("__s", "length").alias("agree"))


def node_errors(nodes: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """node and the names of the rules that it breaks, in the order of ``rules``, joined by commas; whole nodes are left out."""
    found = F.filter(F.array(*(F.when(hit, F.lit(name)) for name, hit in rules.items())), lambda x: x.isNotNull())
    return nodes.select("node", F.array_join(found, ",").alias("errors")).where("errors <> ''")


def gold_counts(predicted: DataFrame, gold: DataFrame) -> DataFrame:
    """How many gold places are missing, under the right or a wrong parent, and how many predicted ones are no gold places."""
    g = gold.select("child", F.col("parent").alias("want"))
    both = predicted.select("child", "parent").join(g, "child", "full_outer")
    kind = F.when(F.col("parent").isNull(), "missing").when(F.col("want").isNull(), "extra").when(F.col("parent") == F.col("want"), "right").otherwise("wrong_parent")
    return both.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


def fix_plan(nodes: DataFrame, gold: DataFrame) -> DataFrame:
    """What makes (node, parent, tier) gold: delete, add, retier, reparent, each with its new value."""
    g = gold.select("node", F.col("parent").alias("gp"), F.col("tier").alias("gt"))
    both = nodes.select("node", "parent", "tier", F.lit(True).alias("__own")).join(g.withColumn("__gold", F.lit(True)), "node", "full_outer")
    steps = F.filter(
        F.array(
            F.when(F.col("__gold").isNull(), F.struct(F.lit("delete").alias("step"), F.lit("").alias("value"))),
            F.when(F.col("__own").isNull(), F.struct(F.lit("add").alias("step"), F.col("gp").alias("value"))),
            F.when(F.col("tier") != F.col("gt"), F.struct(F.lit("retier").alias("step"), F.col("gt").cast("string").alias("value"))),
            F.when(F.col("parent") != F.col("gp"), F.struct(F.lit("reparent").alias("step"), F.col("gp").alias("value"))),
        ),
        lambda x: x.isNotNull(),
    )
    return both.select("node", F.explode(steps).alias("s")).select("node", "s.step", "s.value")


def state_from_log(log: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """The value that the last operation of each (place, kind) sets."""
    return log.groupBy(*keys).agg(F.max_by("value", seq).alias("value"))


def axis(moves: DataFrame) -> DataFrame:
    """The dominant direction of travel: sums of the steps east and north, and the larger one's name."""
    s = moves.agg(F.sum("dx").alias("dx"), F.sum("dy").alias("dy"))
    name = F.when(F.abs("dx") >= F.abs("dy"), F.when(F.col("dx") >= 0, "east").otherwise("west")).otherwise(F.when(F.col("dy") >= 0, "north").otherwise("south"))
    return s.select("dx", "dy", name.alias("axis"))


def continents(edges: DataFrame, ranks: DataFrame) -> DataFrame:
    """(node, continent): the nearest ancestor of rank 0, at any height."""
    return intervals.nearest_marked(edges, ranks.where("rank = 0").select("node")).select("node", F.col("ancestor").alias("continent"))


def first_n(df: DataFrame, keys: list[str], n: int, *order: Column | str) -> DataFrame:
    """The first ``n`` rows of each key."""
    k = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__k", k).where(F.col("__k") <= n).drop("__k")
