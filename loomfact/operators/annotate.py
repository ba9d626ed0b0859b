"""Annotations of chapters and places: scenes' events, digests, centroids, renames, hints and roles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def filled_forward(rows: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """``value`` of the last row that has one, for rows without."""
    w = W.partitionBy(key).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    return rows.withColumn(value, F.last(value, ignorenulls=True).over(w))


def top_by_chapters(mentions: DataFrame, most: dict[str, int]) -> DataFrame:
    """Of each kind the names of most chapters, as many as ``most`` says."""
    n = mentions.groupBy("kind", "name").agg(F.countDistinct("chapter").alias("chapters"))
    k = F.row_number().over(W.partitionBy("kind").orderBy(F.desc("chapters"), "name"))
    limit = F.coalesce(*(F.when(F.col("kind") == kind, F.lit(m)) for kind, m in most.items()), F.lit(0))
    return n.withColumn("__k", k).where(F.col("__k") <= limit).drop("__k")


def centroids(visits: DataFrame, chapters: DataFrame, widest: int = 5) -> DataFrame:
    """chapter, width and mean point of the visits within the smallest width (0 to ``widest`` chapters) that has any.

    A visit is near to 2 * ``widest`` + 1 chapters at most, so it is copied that often and met by an equi-join.
    """
    near = visits.select("x", "y", "chapter", F.explode(F.sequence(F.lit(-widest), F.lit(widest))).alias("d"))
    near = near.select((F.col("chapter") + F.col("d")).alias("chapter"), F.abs("d").alias("width"), "x", "y")
    own = near.join(chapters.select("chapter").distinct(), "chapter", "left_semi").groupBy("chapter", "width").agg(F.sum("x").alias("sx"), F.sum("y").alias("sy"), F.count("*").alias("n"))
    #  Narrower widths are part of wider ones, and only the narrowest with a hit is asked for.
    return own.groupBy("chapter").agg(F.min_by(F.struct("width", "sx", "sy", "n"), "width").alias("b")).select("chapter", F.col("b.width").cast("long").alias("width"), "b.sx", "b.sy", "b.n")


def disambiguated(places: DataFrame, prone: Column, parents: DataFrame) -> DataFrame:
    """place (chapter, name) with the parent in front where the name is one that many buildings have."""
    both = places.join(parents.select("chapter", "name", "parent"), ["chapter", "name"], "left")
    return both.select("chapter", "name", F.when(prone & F.col("parent").isNotNull(), F.concat_ws("·", "parent", "name")).otherwise(F.col("name")).alias("new"))


def direction_hint(name: Column, table: tuple[tuple[str, str], ...], unless: str) -> Column:
    """The direction of the first character of the table whose first place in the name has none of ``unless`` behind it."""
    hits = [F.when(name.rlike(f"^[^{c}]*{c}(?![{unless}])"), F.lit(d)) for c, d in table]
    return F.coalesce(*hits)


def first_field(json: Column, *names: str) -> Column:
    """The value of the first of several names of a field that an object has."""
    return F.coalesce(*(F.get_json_object(json, f"$.{n}") for n in names))


def first_keyword(text: Column, table: tuple[tuple[str, str], ...], default: str) -> Column:
    """The value of the first keyword of the table that a text holds."""
    return F.coalesce(*(F.when(F.contains(text, F.lit(k)), F.lit(v)) for k, v in table), F.lit(default))
