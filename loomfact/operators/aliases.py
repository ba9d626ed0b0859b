"""Alias groups: guarded unions in order, canonical names and user overrides, one novel a task.

Whether two names may join depends on the groups made before, so the fold over a
novel's alias pairs (bounded by its text) is a grouped map; pairs that no order would
admit are filtered before it as column expressions.
"""

from __future__ import annotations

from collections import defaultdict

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.names import HONORIFICS, alias_safety

# ---- fixed values: limits of the grouping
#: Names that a group holds at most; from WARY_SIZE names on, pairs wait for evidence.
MOST_NAMES, WARY_SIZE = 20, 5
#: Chapters that must state a pair that waited, and the names that its group may then hold.
EVIDENT_CHAPTERS, MOST_EVIDENT = 3, 50
# ----


def canonical(members: list[str], freq: dict[str, int], primary: set[str]) -> str:
    """A single primary name; else without nicknames a three-letter name of frequency 50 or more, unless a two-letter one has ten times that; else the most frequent, first given on a tie."""
    own = [m for m in members if m in primary]
    if len(own) == 1:
        return own[0]
    pool = own or members
    plain = [m for m in pool if not m.endswith(HONORIFICS)] or pool
    most = lambda ms: max(ms, key=lambda m: freq.get(m, 0)) if ms else None
    three, two = most([m for m in plain if len(m) == 3]), most([m for m in plain if len(m) == 2])
    if three and freq.get(three, 0) >= 50 and not (two and freq.get(two, 0) >= 10 * freq[three]):
        return three
    return most(plain)


def merged(pairs: list[tuple[str, str, int]], freq: dict[str, int], primary: set[str]) -> dict[str, str]:
    """name -> canonical of pairs (name, alias, chapters) in order.

    Pairs of two primary names, and pairs with a group that is large already, wait until
    all others are done; those that enough chapters state then join, the best stated first.
    Other pairs never join groups of different owners.
    """
    seen = list(dict.fromkeys(x for a, b, _ in pairs for x in (a, b)))
    group = {x: i for i, x in enumerate(seen)}
    names = {i: [x] for i, x in enumerate(seen)}
    owner = {i: x for i, x in enumerate(seen) if x in primary}
    waiting: dict[tuple[str, str], int] = defaultdict(int)

    def pour(a: str, b: str) -> None:
        into, out = group[a], group[b]
        for x in names[out]:
            group[x] = into
        names[into] += names.pop(out)
        if into not in owner and out in owner:
            owner[into] = owner[out]

    for a, b, chapters in pairs:
        i, j = group[a], group[b]
        if a in primary and b in primary:
            waiting[min(a, b), max(a, b)] += chapters
        elif i != j and (i not in owner or j not in owner or owner[i] == owner[j]):
            if max(len(names[i]), len(names[j])) >= WARY_SIZE:
                waiting[min(a, b), max(a, b)] += chapters
            elif len(names[i]) + len(names[j]) <= MOST_NAMES:
                pour(a, b)
    for (a, b), chapters in sorted(waiting.items(), key=lambda x: -x[1]):
        fits = len(names[group[a]]) + len(names[group[b]]) <= MOST_EVIDENT
        if chapters >= EVIDENT_CHAPTERS and group[a] != group[b] and fits:
            pour(a, b)
    place, out = {x: i for i, x in enumerate(seen)}, {}
    for ms in names.values():
        name = canonical(sorted(ms, key=place.__getitem__), freq, primary)
        out |= {m: name for m in ms if m != name}
    return out


def overridden(alias_map: dict[str, str], overrides: list[tuple[str, str, str]]) -> dict[str, str]:
    """``alias_map`` after overrides (kind, name, other) in order: merge into other, split off, rename to other."""
    out = dict(alias_map)
    for kind, name, other in overrides:
        if kind == "merge":
            target = out.get(other, other)
            for k, v in list(out.items()):
                if v == name:
                    out[k] = target
            if name != target:
                out[name] = target
        elif kind == "split":
            out.pop(name, None)
        elif kind == "rename":
            old = out.get(name, name)
            out.pop(other, None)
            for k, v in list(out.items()):
                if v == old and k != other:
                    out[k] = other
            out[old] = other
    return {k: v for k, v in out.items() if k != v}


def alias_maps(pairs: DataFrame, frequency: DataFrame, primary: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """(novel, alias, canonical) of pairs (novel, name, alias, first, chapters).

    ``frequency`` has (novel, name, freq), ``primary`` (novel, name), ``overrides``
    (novel, seq, kind, name, other). Pairs with an alias that is never safe are left out first.
    """
    safe = pairs.where((alias_safety(F.col("alias")) > 0) & (F.col("name") != F.col("alias")))
    rows = safe.select("novel", F.lit("pair").alias("what"), F.col("first").cast("long").alias("seq"), F.col("name").alias("a"), F.col("alias").alias("b"), F.col("chapters").cast("long").alias("n"), F.lit("").alias("kind"))
    none = F.lit("")
    rows = rows.unionByName(frequency.select("novel", F.lit("freq").alias("what"), F.lit(0).cast("long").alias("seq"), F.col("name").alias("a"), none.alias("b"), F.col("freq").cast("long").alias("n"), none.alias("kind")))
    rows = rows.unionByName(primary.select("novel", F.lit("primary").alias("what"), F.lit(0).cast("long").alias("seq"), F.col("name").alias("a"), none.alias("b"), F.lit(0).cast("long").alias("n"), none.alias("kind")))
    if overrides is not None:
        rows = rows.unionByName(overrides.select("novel", F.lit("override").alias("what"), F.col("seq").cast("long").alias("seq"), F.col("name").alias("a"), F.col("other").alias("b"), F.lit(0).cast("long").alias("n"), "kind"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pick = lambda w: pdf[pdf["what"] == w].sort_values(["seq", "a", "b"])
        p, f, o = pick("pair"), pick("freq"), pick("override")
        got = merged(list(zip(p["a"], p["b"], p["n"], strict=True)), dict(zip(f["a"], f["n"], strict=True)), set(pick("primary")["a"]))
        got = sorted(overridden(got, list(zip(o["kind"], o["a"], o["b"], strict=True))).items())
        return pd.DataFrame({"novel": [pdf["novel"].iloc[0]] * len(got), "alias": [k for k, _ in got], "canonical": [v for _, v in got]})

    kind = dict(pairs.dtypes)["novel"]
    return rows.groupBy("novel").applyInPandas(run, f"novel {kind}, alias string, canonical string")
