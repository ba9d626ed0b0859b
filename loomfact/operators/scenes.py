"""Rules over a scene's paragraphs: its tone, its key dialogue and the roles of its persons.

Patterns, marks and thresholds are arguments; the defaults are those of Chinese novels.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Marks that begin a paragraph of dialogue.
DIALOGUE_STARTS = ("“", "「", '"', "‘", "『")
#: The fewest matches of a tone.
TONE_MATCHES = 3
#: The least length of a line of key dialogue, how many are kept, and the most characters shown.
DIALOGUE_LENGTH, DIALOGUE_LINES, DIALOGUE_SHOWN = 8, 2, 60
#: The fewest paragraphs of a lead and of a supporting person.
LEAD_PARAGRAPHS, SUPPORTING_PARAGRAPHS = 3, 2
CALM = "平静"
ROLES = ("主", "配", "提及")


def starts_dialogue(paragraph: Column, starts: tuple[str, ...] = DIALOGUE_STARTS) -> Column:
    return F.coalesce(F.substring(paragraph, 1, 1).isin(*starts), F.lit(False))


def tone(text: Column, patterns: tuple[tuple[str, str], ...], least: int = TONE_MATCHES, none: str = CALM) -> Column:
    """The tone whose pattern matches most often, the first on a tie; ``none`` below ``least`` matches."""
    counts = F.array(*(F.struct(F.size(F.regexp_extract_all(text, F.lit(f"({p})"), F.lit(1))).alias("n"), F.lit(-k).alias("k"), F.lit(name).alias("name")) for k, (name, p) in enumerate(patterns)))
    best = F.array_max(counts)
    return F.when(best["n"] >= least, best["name"]).otherwise(none)


def key_dialogue(paragraphs: DataFrame, scene: str, order: str, text: str, starts: tuple[str, ...] = DIALOGUE_STARTS, least: int = DIALOGUE_LENGTH, most: int = DIALOGUE_LINES, shown: int = DIALOGUE_SHOWN) -> DataFrame:
    """scene, rank and line: the longest paragraphs of dialogue, the first on a tie; longer ones end in dots."""
    said = paragraphs.where(starts_dialogue(F.col(text), starts) & (F.char_length(text) >= least))
    rank = F.row_number().over(W.partitionBy(scene).orderBy(F.desc(F.char_length(text)), order))
    line = F.when(F.char_length(text) > shown, F.concat(F.substring(text, 1, shown - 3), F.lit("..."))).otherwise(F.col(text))
    return said.withColumn("rank", rank).where(F.col("rank") <= most).select(scene, F.col("rank").cast("long").alias("rank"), line.alias("line"))


def character_roles(paragraphs: DataFrame, present: DataFrame, starts: tuple[str, ...] = DIALOGUE_STARTS, roles: tuple[str, str, str] = ROLES) -> DataFrame:
    """scene, name, mentions, role and place of the persons ``present`` (scene, name) by the paragraphs (scene, order, text).

    A lead is named in three paragraphs or in dialogue, who supports in two. Leads come
    first, and within a role who is named more often. Only names of a scene meet its
    paragraphs, and counts are combined before their shuffle.
    """
    met = paragraphs.select("scene", "text").join(present.select("scene", "name").distinct(), "scene")
    times = F.when(F.col("name") != "", F.size(F.split("text", F.concat(F.lit(r"\Q"), F.col("name"), F.lit(r"\E")), -1)) - 1).otherwise(0)
    named = met.withColumn("n", times).groupBy("scene", "name").agg(F.sum("n").alias("mentions"), F.count_if(F.col("n") > 0).alias("p"), F.count_if((F.col("n") > 0) & starts_dialogue(F.col("text"), starts)).alias("d"))
    #  Persons of scenes without paragraphs are mentioned at most.
    rows = present.select("scene", "name").distinct().join(named, ["scene", "name"], "left").fillna(0, ["mentions", "p", "d"])
    which = F.when((F.col("p") >= LEAD_PARAGRAPHS) | (F.col("d") > 0), 0).when(F.col("p") >= SUPPORTING_PARAGRAPHS, 1).otherwise(2)
    place = F.row_number().over(W.partitionBy("scene").orderBy(which, F.desc("mentions"), "name"))
    return rows.select("scene", "name", F.col("mentions").cast("long").alias("mentions"), F.get(F.array(*map(F.lit, roles)), which).alias("role"), place.cast("long").alias("place"))
