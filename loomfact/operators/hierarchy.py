"""Building a place hierarchy: parent votes, their resolution and a maximum arborescence.

Votes and the majority are DataFrame operators. What depends on the order of repairs, the
arborescence of a novel, runs in a grouped map with one novel's places (bounded by its
text) in a task.
"""

from __future__ import annotations

from collections import defaultdict

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

CONFIDENCE = {"high": 3.0, "medium": 2.0, "low": 1.0}


def parent_votes(facts: DataFrame, contains: DataFrame, settings: DataFrame, baseline: DataFrame) -> DataFrame:
    """(novel, child, parent, weight): votes of four kinds added up.

    ``facts`` (novel, chapter, child, parent, peer) votes 1 to 1.5, growing over the novel's
    chapters, a third of it where only peers say so; ``contains`` (novel, parent, child,
    confidence) votes by confidence; ``settings`` (novel, child, parent) votes 2;
    ``baseline`` (novel, child, parent) votes 1 where another vote for the pair exists.
    """
    keys = ["novel", "child", "parent"]
    chapters = facts.select("novel", "chapter").distinct()
    w = W.partitionBy("novel")
    place = chapters.withColumn("i", F.row_number().over(w.orderBy("chapter")) - 1).withColumn("n", F.count("*").over(w))
    stated = facts.join(place, ["novel", "chapter"]).withColumn("weight", (1 + 0.5 * F.col("i") / F.col("n")) * F.when(F.col("peer"), F.lit(1 / 3)).otherwise(1.0))
    rank = F.coalesce(*(F.when(F.col("confidence") == k, F.lit(v)) for k, v in CONFIDENCE.items()), F.lit(1.0))
    votes = stated.select(*keys, "weight").unionByName(contains.select(*keys, rank.alias("weight"))).unionByName(settings.select(*keys, F.lit(2.0).alias("weight")))
    votes = votes.where("child <> parent").groupBy(*keys).agg(F.sum("weight").alias("weight"))
    base = baseline.select(*keys).distinct().withColumn("__base", F.lit(1.0))
    return votes.join(base, keys, "left").select(*keys, (F.col("weight") + F.coalesce("__base", F.lit(0.0))).alias("weight"))


def capped_root_votes(votes: DataFrame, root: DataFrame, most: float = 2.0) -> DataFrame:
    """Votes for a novel's root (novel, root) count ``most`` at most where a child has other votes too."""
    n = votes.groupBy("novel", "child").agg(F.count("*").alias("__n"))
    j = votes.join(n, ["novel", "child"]).join(root.select("novel", F.col("root").alias("parent"), F.lit(True).alias("__root")), ["novel", "parent"], "left")
    cap = F.when(F.col("__root") & (F.col("__n") > 1), F.least("weight", F.lit(most))).otherwise(F.col("weight"))
    return j.select("novel", "child", "parent", cap.alias("weight"))


def neighbour_votes(votes: DataFrame, neighbours: DataFrame, rounds: int = 2, weight: float = 1.0) -> DataFrame:
    """Places without a vote take their neighbours' strongest parent, round by round.

    A round reads the votes of the round before as a whole, so its result does not depend
    on an order of rows.
    """
    both = neighbours.select("novel", "a", "b").union(neighbours.select("novel", "b", "a")).distinct()
    for _ in range(rounds):
        top = votes.groupBy("novel", "child").agg(F.max_by("parent", F.struct(F.col("weight"), F.col("parent"))).alias("parent"))
        new = both.join(top.select("novel", F.col("child").alias("b"), "parent"), ["novel", "b"]).where("a <> parent").groupBy("novel", F.col("a").alias("child"), "parent").agg((F.count("*") * weight).alias("weight"))
        new = new.join(votes.select("novel", "child").distinct(), ["novel", "child"], "left_anti")
        votes = votes.unionByName(new)
    return votes


def majority_parents(votes: DataFrame, least: float = 0.0) -> DataFrame:
    """The parent with most votes of each child, the smallest name on a tie."""
    w = W.partitionBy("novel", "child").orderBy(F.desc("weight"), "parent")
    return votes.where(F.col("weight") > least).withColumn("k", F.row_number().over(w)).where("k = 1").select("novel", "child", "parent", "weight")


def synonyms_merged(votes: DataFrame, synonyms: DataFrame) -> DataFrame:
    """Votes with variants (novel, variant, base) replaced at both ends and added up."""
    s = synonyms.select("novel", "variant", "base")
    j = votes.join(s.withColumnsRenamed({"variant": "child", "base": "c"}), ["novel", "child"], "left").join(s.withColumnsRenamed({"variant": "parent", "base": "p"}), ["novel", "parent"], "left")
    j = j.select("novel", F.coalesce("c", "child").alias("child"), F.coalesce("p", "parent").alias("parent"), "weight")
    return j.where("child <> parent").groupBy("novel", "child", "parent").agg(F.sum("weight").alias("weight"))


def name_containment(names: DataFrame, least: int = 1) -> DataFrame:
    """(novel, child, parent): the longest other name that each name begins with.

    Every name gives its own beginnings (as many as it has letters), which meet the names in
    an equi-join; no pair of names is compared.
    """
    n = names.select("novel", "name").distinct()
    starts = F.transform(F.sequence(F.lit(least), F.char_length("name") - 1), lambda i: F.substring(F.col("name"), F.lit(1), i))
    own = n.where(F.char_length("name") > least).select("novel", F.col("name").alias("child"), F.explode(starts).alias("parent"))
    hit = own.join(n.withColumnRenamed("name", "parent"), ["novel", "parent"])
    return hit.groupBy("novel", "child").agg(F.max_by("parent", F.char_length("parent")).alias("parent"))


def arborescence(edges: list[tuple[str, str, float]], root: str) -> dict[str, str]:
    """Maximum branching below ``root`` of edges (child, parent, weight): every node takes its best parent, cycles contract.

    Every node gets an edge to the root of lowest weight, so one always exists. Ties go to
    the smaller parent.
    """
    nodes = {c for c, _, _ in edges} | {p for _, p, _ in edges}
    low = min((w for _, _, w in edges), default=0.0) - 1e6 * (1 + len(nodes))
    incoming: dict[object, dict[object, tuple[float, tuple[str, str]]]] = defaultdict(dict)
    for c, p, w in [*((n, root, low) for n in sorted(nodes) if n != root), *edges]:
        if c != root and c != p and (p not in incoming[c] or incoming[c][p][0] < w):
            incoming[c][p] = (w, (c, p))
    return dict(_branching(dict(incoming)))


def _branching(incoming: dict) -> set[tuple[str, str]]:
    """Edges of the best branching of ``incoming`` (node -> parent -> weight and edge).

    Cycles are contracted one after the other; then they are opened again, the last first:
    all edges inside stay but the one into the node that is entered from outside.
    """
    contracted = []
    while True:
        best = {c: max(sorted(ps, key=str), key=lambda p: ps[p][0]) for c, ps in incoming.items()}  # noqa: B023
        cycle = _cycle(best)
        if not cycle:
            break
        name = ("cycle", len(contracted))
        outer: dict[object, dict] = defaultdict(dict)
        into: dict[tuple[str, str], object] = {}  # the cycle's node that an edge from outside enters
        for c, ps in incoming.items():
            for p, (w, e) in ps.items():
                a, b = (name if c in cycle else c), (name if p in cycle else p)
                if a == b:
                    continue
                if c in cycle:
                    w -= incoming[c][best[c]][0]
                if b not in outer[a] or outer[a][b][0] < w:
                    outer[a][b] = (w, e)
                if a == name:
                    into[e] = c
        contracted.append((name, outer, into, {c: incoming[c][best[c]][1] for c in cycle}))
        incoming = dict(outer)
    found = {incoming[c][p][1] for c, p in best.items()}
    for name, outer, into, inside in reversed(contracted):
        entered = {into[e] for _, e in outer[name].values() if e in found}
        found |= {e for c, e in inside.items() if c not in entered}
    return found


def _cycle(best: dict) -> set:
    done: set = set()
    for start in best:
        path, seen, x = [], set(), start
        while x in best and x not in seen and x not in done:
            seen.add(x)
            path.append(x)
            x = best[x]
        if x in seen:
            return set(path[path.index(x) :])
        done |= seen
    return set()


def arborescences(votes: DataFrame, roots: DataFrame) -> DataFrame:
    """(novel, child, parent): the maximum arborescence of each novel's votes below its root (novel, root)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        root = pdf["root"].iloc[0]
        edges = sorted(zip(pdf["child"], pdf["parent"], pdf["weight"], strict=True))
        got = sorted(arborescence(edges, root).items())
        return pd.DataFrame({"novel": [pdf["novel"].iloc[0]] * len(got), "child": [c for c, _ in got], "parent": [p for _, p in got]})

    kind = dict(votes.dtypes)
    both = votes.join(roots.select("novel", "root"), "novel").select("novel", "child", "parent", F.col("weight").cast("double").alias("weight"), "root")
    return both.groupBy("novel").applyInPandas(run, f"novel {kind['novel']}, child string, parent string")


def balanced(edges: pd.DataFrame, rank: dict[str, int], most: int = 30, rounds: int = 10) -> pd.DataFrame:
    """Leaves of nodes with over ``most`` children go under siblings of a higher tier, round robin by name."""
    parent = dict(zip(edges["child"], edges["parent"], strict=True))
    for _ in range(rounds):
        kids: dict[str, list[str]] = defaultdict(list)
        for c, p in sorted(parent.items()):
            kids[p].append(c)
        over = [p for p, cs in sorted(kids.items()) if len(cs) > most]
        moved = False
        for p in over:
            leaves = [c for c in kids[p] if c not in kids]
            takers = [c for c in kids[p] if c in kids and len(kids[c]) < most]
            for i, leaf in enumerate(leaves[: len(kids[p]) - most]):
                fit = [x for x in takers if rank.get(x, 99) < rank.get(leaf, 99)]
                if fit:
                    parent[leaf] = fit[i % len(fit)]
                    moved = True
        if not moved:
            break
    return pd.DataFrame({"child": list(parent), "parent": list(parent.values())})
