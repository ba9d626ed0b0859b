"""Logs and imports of keyed tables: live rows, task states, versions, conflicts, index documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .profile import resolved
from .store import latest

#: Characters of a chapter's summary and of its text that are embedded.
SUMMARY_CHARS, TEXT_CHARS = 500, 1500


def live(log: DataFrame, keys: list[str], seq: str, deleted: str) -> DataFrame:
    """The last row of each key, without those whose last row deletes."""
    return latest(log, keys, seq).where(~F.col(deleted))


def task_states(log: DataFrame) -> DataFrame:
    """One row per task of a log (task, seq, status, progress): last status, first write, furthest progress and writes."""
    return log.groupBy("task").agg(F.max_by("status", "seq").alias("status"), F.min("seq").alias("created"), F.max("progress").alias("current"), F.count("*").alias("writes"))


def since_cleared(log: DataFrame, time: str, clears: Column) -> DataFrame:
    """Rows from the last one on that clears the log; all rows if none does."""
    last = log.where(clears).agg(F.max(time).alias("__last"))
    return log.join(F.broadcast(last), F.col("__last").isNull() | (F.col(time) >= F.col("__last"))).drop("__last")  # one row


def first_snapshot(mentions: DataFrame, keys: list[str], roles: tuple[str, ...]) -> DataFrame:
    """freq, chapters, first chapter and setting (the first role by rank, then place) of each key."""
    rank = F.array_position(F.array(*(F.lit(r) for r in roles)), F.col("role"))
    order = F.struct(F.when(rank > 0, rank).otherwise(F.lit(len(roles) + 1)), F.col("pos"))
    return mentions.groupBy(*keys).agg(F.count("*").alias("freq"), F.countDistinct("chapter").alias("chapters"), F.min("chapter").alias("first"), F.min_by("role", order).alias("setting"))


def versioned(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Rows with their version (from 1) within ``key``."""
    return rows.withColumn("version", F.row_number().over(W.partitionBy(key).orderBy(order)).cast("long"))


def imported(old: DataFrame, new: DataFrame, keys: list[str], mode: str) -> DataFrame:
    """``old`` and ``new``; where both have a key, ``skip`` keeps the old row and ``overwrite`` the new one."""
    if mode not in ("skip", "overwrite"):
        raise ValueError(f"unknown mode: {mode}")
    if mode == "skip":
        return old.unionByName(new.join(old.select(*keys).distinct(), keys, "left_anti"))
    return new.unionByName(old.join(new.select(*keys).distinct(), keys, "left_anti"))


def import_preview(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """How many keys an import holds and how many of them are there already."""
    there = old.select(*keys).distinct().withColumn("__there", F.lit(True))
    return new.select(*keys).distinct().join(there, keys, "left").agg(F.count("*").alias("novels"), F.count("__there").alias("conflicts"))


def index_text(summary: Column, text: Column) -> Column:
    return F.concat_ws("\n", F.substring(summary, 1, SUMMARY_CHARS), F.substring(text, 1, TEXT_CHARS))


def entity_documents(mentions: DataFrame, first_wins: tuple[str, ...]) -> DataFrame:
    """kind, name and the chapter that describes it: the last, for kinds of ``first_wins`` the first."""
    order = F.when(F.col("kind").isin(*first_wins), -F.col("chapter")).otherwise(F.col("chapter"))
    return mentions.groupBy("kind", "name").agg(F.max_by("chapter", order).alias("chapter"))


def alternate_names(names: DataFrame, cities: DataFrame) -> DataFrame:
    """(name, id, preferred) once for each name and city, with the city's columns."""
    return names.groupBy("name", "id").agg(F.max("preferred").alias("preferred")).join(cities, "id")


def with_variants(names: DataFrame, characters: str, others: str) -> DataFrame:
    """Names and those that writing ``others`` for ``characters`` adds to them."""
    own = names.select("name").distinct()
    more = own.select(F.translate("name", characters, others).alias("name")).distinct().join(own, "name", "left_anti")
    return own.withColumn("added", F.lit(False)).union(more.withColumn("added", F.lit(True)))


def offsets(books: DataFrame, key: str, chapters: Column, gap: int) -> DataFrame:
    """key, chapter (from 1) and the place where it starts; ``gap`` characters stand between two chapters."""
    rows = books.select(key, F.posexplode(chapters).alias("i", "content")).select(key, (F.col("i") + 1).cast("long").alias("chapter"), F.char_length("content").alias("n"))
    before = W.partitionBy(key).orderBy("chapter").rowsBetween(W.unboundedPreceding, -1)
    return rows.select(key, "chapter", F.coalesce(F.sum(F.col("n") + gap).over(before), F.lit(0)).cast("long").alias("start"))


def facts_markdown(facts: DataFrame, aliases: DataFrame) -> DataFrame:
    """chapter and its facts (pos, person, action) as a list, in order, persons by their canonical names."""
    rows = resolved(facts, "person", aliases)
    line = F.concat(F.lit("- **"), F.col("person"), F.lit("**: "), F.col("action"))
    g = rows.groupBy("chapter").agg(F.array_sort(F.collect_list(F.struct("pos", line.alias("line")))).alias("ls"))
    body = F.array_join(F.transform("ls", lambda x: x["line"]), "\n")
    return g.select("chapter", F.concat(F.lit("## "), F.col("chapter").cast("string"), F.lit("\n"), body).alias("markdown"))
