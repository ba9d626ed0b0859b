"""Validation passes over exploded facts: what is unknown goes, what is missing is added, what repeats is merged.

Every pass is a semi, anti or equi-join on (novel, chapter, name), or an aggregation on it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEY = ["novel", "chapter"]


def known_relations(relations: DataFrame, people: DataFrame) -> DataFrame:
    """Relations whose both persons are names of the chapter's people (novel, chapter, name), not of one with itself."""
    a, b = people.select(*KEY, F.col("name").alias("person_a")).distinct(), people.select(*KEY, F.col("name").alias("person_b")).distinct()
    return relations.where("person_a <> person_b").join(a, [*KEY, "person_a"], "left_semi").join(b, [*KEY, "person_b"], "left_semi")


def people_without_places(people: DataFrame, places: DataFrame) -> DataFrame:
    """People whose name is no place of the same chapter."""
    return people.join(places.select(*KEY, "name").distinct(), [*KEY, "name"], "left_anti")


def with_missing_people(people: DataFrame, names: DataFrame) -> DataFrame:
    """``people`` and a row for each name of the chapter (novel, chapter, name) that is not among them."""
    new = names.select(*KEY, "name").where("name <> ''").distinct().join(people.select(*KEY, "name"), [*KEY, "name"], "left_anti")
    return people.unionByName(new, allowMissingColumns=True)


def referenced_places(places: DataFrame, kind: Column) -> DataFrame:
    """Places and the parents that are named but have no row of their own; ``kind`` of the column name is their type."""
    new = places.where("parent is not null and parent <> ''").select(*KEY, F.col("parent").alias("name")).distinct().join(places.select(*KEY, "name"), [*KEY, "name"], "left_anti")
    return places.unionByName(new.withColumn("type", kind), allowMissingColumns=True)


def distinct_events(events: DataFrame, summary: str, pos: str, kinds: dict[str, tuple[tuple[str, ...], str]]) -> DataFrame:
    """One event per chapter and stripped summary, the first; columns of ``kinds`` take a default outside their values."""
    rows = events.withColumn(summary, F.trim(summary)).where(F.col(summary) != "")
    rest = [c for c in rows.columns if c not in (*KEY, summary)]
    first = rows.groupBy(*KEY, summary).agg(F.min_by(F.struct(*rest), pos).alias("e")).select(*KEY, summary, "e.*")
    return reduce(lambda d, kv: d.withColumn(kv[0], F.when(F.col(kv[0]).isin(*kv[1][0]), F.col(kv[0])).otherwise(kv[1][1])), kinds.items(), first)


def merged_people(people: DataFrame, pos: str) -> DataFrame:
    """Segments' people as one row a chapter and name: first appearance text, aliases in order of first mention."""
    order = F.array_sort(F.collect_list(F.struct(pos, "aliases", "appearance")))
    g = people.groupBy(*KEY, "name").agg(order.alias("r"))
    aliases = F.array_distinct(F.flatten(F.transform("r", lambda x: F.coalesce(x["aliases"], F.array().cast("array<string>")))))
    text = F.get(F.filter(F.transform("r", lambda x: x["appearance"]), lambda x: x.isNotNull() & (x != "")), F.lit(0))
    return g.select(*KEY, "name", aliases.alias("aliases"), F.coalesce(text, F.lit("")).alias("appearance"))


def clean_spatial(relations: DataFrame, places: DataFrame, kinds: tuple[str, ...], pos: str) -> DataFrame:
    """Spatial relations of known kinds between known places, contains turned round where the ranks say so, one per key.

    ``places`` has (name, rank), a smaller rank is a larger place; ``score`` is held within 0 and 1.
    """
    a, b = places.select(F.col("name").alias("source"), F.col("rank").alias("__rs")), places.select(F.col("name").alias("target"), F.col("rank").alias("__rt"))
    j = relations.where(F.col("relation_type").isin(*kinds)).where("source <> target").join(a, "source").join(b, "target")
    turn = (F.col("relation_type") == "contains") & (F.col("__rs") > F.col("__rt"))
    rows = j.select(
        F.when(turn, F.col("target")).otherwise(F.col("source")).alias("source"),
        F.when(turn, F.col("source")).otherwise(F.col("target")).alias("target"),
        "relation_type",
        "value",
        F.least(F.lit(1.0), F.greatest(F.lit(0.0), "score")).alias("score"),
        pos,
    )
    keys = ["source", "target", "relation_type"]
    return rows.groupBy(*keys).agg(F.min_by(F.struct("value", "score"), pos).alias("r")).select(*keys, "r.*")


def scene_scores(paragraphs: DataFrame, key: str, order: str, text: str) -> DataFrame:
    """Score of a scene's start at each paragraph: marks of time and place, change of dialogue, a short line before."""
    from pyspark.sql import Window as W

    from ..functions.text import is_dialogue

    w = W.partitionBy(key).orderBy(order)
    rows = paragraphs.select(key, order, F.col(text).alias("t")).withColumn("d", is_dialogue(F.col("t")).cast("int"))
    before = F.sum("d").over(w.rowsBetween(-3, -1))
    after = F.sum("d").over(w.rowsBetween(0, 2))
    low = F.lower("t")
    score = (
        F.when(low.rlike(r"^(the next|later|that (night|evening|morning)|meanwhile|once)"), 4).otherwise(0)
        + F.when(low.rlike(r"^(in|at) the "), 2).otherwise(0)
        + F.when((before >= 2) & (after == 0), 3).otherwise(0)
        + F.when((F.coalesce(before, F.lit(0)) == 0) & (after >= 2), 2).otherwise(0)
        + F.when(F.char_length(F.lag("t").over(w)) < 15, 2).otherwise(0)
    )
    return rows.select(key, order, F.when(F.row_number().over(w) == 1, 0).otherwise(score).cast("long").alias("score"))


def scenes(breaks: DataFrame, paragraphs: DataFrame, key: str, order: str, text: str) -> DataFrame:
    """Scenes between break points: number, first and last paragraph, their count and letters."""
    from pyspark.sql import Window as W

    marked = paragraphs.join(breaks.select(key, order).withColumn("b", F.lit(1)), [key, order], "left")
    n = F.sum(F.coalesce("b", F.lit(0))).over(W.partitionBy(key).orderBy(order))
    return marked.withColumn("scene", n).groupBy(key, "scene").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("paragraphs"), F.sum(F.char_length(text)).alias("letters"))
