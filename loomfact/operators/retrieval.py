"""Retrieval for question answering: search, grounding, vectors and contexts within a budget."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import snippet


def search(docs: DataFrame, key: str, text: str, needle: str, limit: int) -> DataFrame:
    """The first ``limit`` rows by key that hold ``needle`` regardless of case, with the text around it."""
    hit = docs.where(F.contains(F.lower(text), F.lit(needle.lower()))).orderBy(key).limit(limit)
    return hit.select(key, snippet(F.col(text), F.lit(needle)).alias("snippet"))


def nearest(vectors: DataFrame, key: str, vector: str, query: list[float], k: int) -> DataFrame:
    """The ``k`` rows of greatest cosine with ``query``: exact, a top-k without a full sort."""
    q = F.array(*(F.lit(float(x)) for x in query))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    v = F.col(vector)
    scored = vectors.select(key, (dot(v, q) / F.sqrt(dot(v, v) * dot(q, q))).alias("cosine"))
    return scored.orderBy(F.desc("cosine"), key).limit(k)


def within_budget(blocks: DataFrame, keys: list[str], order: str, text: str, budget: int) -> DataFrame:
    """Blocks of each key in order, up to the first that would exceed the budget of characters."""
    w = W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    return blocks.withColumn("used", F.sum(F.char_length(text)).over(w)).where(F.col("used") <= budget)


def best_overlap(events: DataFrame, scenes: DataFrame, key: str, event: str, scene: str, value: str) -> DataFrame:
    """For each event the scene of its chapter that shares most members (the first on a tie), if any is shared.

    Both tables have one row per member, so the overlap is an equi-join and a count.
    """
    n = events.join(scenes, [key, "member"]).groupBy(key, event, scene, value).agg(F.countDistinct("member").alias("shared"))
    return n.groupBy(key, event).agg(F.max_by(value, F.struct("shared", -F.col(scene))).alias(value), F.max("shared").alias("shared"))
