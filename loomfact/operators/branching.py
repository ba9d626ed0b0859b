"""Maximum arborescences of all novels at once, by rounds over tables of edges.

In a round every place takes its best parent in one aggregation; all cycles that this makes
are found by pointer doubling and contracted together, the edges into a cycle priced by
what they put out. When no cycle is left the rounds are unfolded backwards: of a cycle all
edges stay but the one into the place that is entered from outside. A novel is no group of
its own, so a long one is spread over tasks like any other; there are as many rounds as
cycles lie within each other.

A place takes its novel's root only where nothing else leads to it: such edges count as
missing, and fewer missing ones come before any weight. Ties go to the smaller parent.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import components, cut
from .tree import on_cycles

_SEP, _CYCLE = "\x01", "\x02"
_BEST = ("miss", "weight", "parent", "pc", "pp")


def _order() -> Column:
    return F.struct("miss", (-F.col("weight")).alias("w"), "parent", "pc", "pp")


def _start(votes: DataFrame, roots: DataFrame) -> DataFrame:
    """Edges (child, parent, miss, weight) of all novels; names carry their novel, and every place has an edge to its root."""
    name = lambda c: F.concat(F.col("novel").cast("string"), F.lit(_SEP), F.col(c).cast("string"))
    own = votes.join(roots.select("novel", "root"), "novel").where("child <> parent and child <> root")
    own = own.select(name("child").alias("child"), name("parent").alias("parent"), name("root").alias("root"), F.col("weight").cast("double").alias("weight"))
    ends = own.select(F.col("child").alias("node"), "root").union(own.select("parent", "root")).where("node <> root").distinct()
    spare = ends.select(F.col("node").alias("child"), F.col("root").alias("parent"), F.lit(1).cast("long").alias("miss"), F.lit(0.0).alias("weight"))
    stated = own.groupBy("child", "parent").agg(F.lit(0).cast("long").alias("miss"), F.max("weight").alias("weight"))
    both = spare.unionByName(stated).groupBy("child", "parent").agg(F.min_by(F.struct("miss", "weight"), "miss").alias("e"))
    return both.select("child", "parent", "e.miss", "e.weight", F.col("child").alias("pc"), F.col("parent").alias("pp"))


def arborescences(votes: DataFrame, roots: DataFrame) -> DataFrame:
    """(novel, child, parent): the maximum arborescence of each novel's votes (novel, child, parent, weight) below its root (novel, root)."""
    edges, levels = cut(_start(votes, roots)), []
    while True:
        best = cut(edges.groupBy("child").agg(F.min_by(F.struct(*_BEST), _order()).alias("b")).select("child", "b.*"))
        loop = cut(on_cycles(best.select("child", "parent")))
        if not loop.limit(1).count():
            break
        found = components(loop.select(F.col("child").alias("a"), F.col("parent").alias("b")))
        label = cut(found.select("node", F.concat("component", F.lit(_CYCLE + str(len(levels)))).alias("cycle")))
        side = lambda s: label.select(F.col("node").alias(s), F.col("cycle").alias(f"{s}_cycle"))  # noqa: B023, E731
        out = best.select("child", F.col("miss").alias("bm"), F.col("weight").alias("bw"))
        j = edges.join(side("child"), "child", "left").join(side("parent"), "parent", "left").join(out, "child")
        inside = F.col("child_cycle").isNotNull()
        new = j.select(
            F.coalesce("child_cycle", "child").alias("child"),
            F.coalesce("parent_cycle", "parent").alias("parent"),
            (F.col("miss") - F.when(inside, F.col("bm")).otherwise(0)).alias("miss"),
            (F.col("weight") - F.when(inside, F.col("bw")).otherwise(0.0)).alias("weight"),
            F.col("child").alias("pc"),
            F.col("parent").alias("pp"),
        ).where("child <> parent")
        levels.append((edges, best, label))
        one = F.min_by(F.struct("miss", "weight", "pc", "pp"), _order())
        edges = cut(new.groupBy("child", "parent").agg(one.alias("e")).select("child", "parent", "e.*"))
    chosen = best.select("child", "parent", "pc", "pp")
    for before, best, label in reversed(levels):
        outer = chosen.select(F.col("pc").alias("child"), F.col("pp").alias("parent"))
        inner = best.join(label.select(F.col("node").alias("child")), "child", "left_semi").join(outer.select("child"), "child", "left_anti")
        kept = before.select("child", "parent", "pc", "pp").join(outer, ["child", "parent"], "left_semi")
        chosen = cut(kept.unionByName(inner.select("child", "parent", "pc", "pp")))
    part = lambda c, k: F.element_at(F.split(c, _SEP, 2), k)
    kind = votes.schema["novel"].dataType
    return chosen.select(part("child", 1).cast(kind).alias("novel"), part("child", 2).alias("child"), part("parent", 2).alias("parent"))
