"""Entity profiles and narrative views over exploded facts.

Facts are long tables: one row per mention with (chapter, pos) for its place. First-seen
ties are decided by that place everywhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .graph import pair_edges


def resolved(df: DataFrame, column: str, aliases: DataFrame) -> DataFrame:
    """``column`` with aliases (alias, canonical) replaced by their canonical names."""
    a = aliases.select(F.col("alias").alias("__alias"), F.col("canonical").alias("__name"))
    return df.join(a, F.col(column) == F.col("__alias"), "left").withColumn(column, F.coalesce("__name", column)).drop("__alias", "__name")


def entity_list(mentions: DataFrame, priority: list[str]) -> DataFrame:
    """One row per name: the kind with most chapters (by ``priority`` on a tie), chapters and first chapter.

    ``mentions`` has name, kind, chapter.
    """
    n = mentions.groupBy("name", "kind").agg(F.countDistinct("chapter").alias("n"), F.min("chapter").alias("first"))
    rank = F.array_position(F.array(*(F.lit(p) for p in priority)), F.col("kind"))
    total = n.groupBy("name").agg(F.max_by(F.struct("kind", "n", "first"), F.struct("n", -rank)).alias("e"), F.count("*").alias("kinds"))
    return total.select("name", "e.kind", F.col("e.n").alias("chapters"), F.col("e.first").alias("first"), "kinds")


def merged_descriptions(df: DataFrame, name: str, description: str, chapter: str) -> DataFrame:
    """Equal descriptions of a name with the sorted list of their chapters, repeats kept."""
    g = df.groupBy(name, description).agg(F.array_sort(F.collect_list(chapter)).alias("c"))
    return g.select(name, description, F.element_at("c", 1).alias("first"), F.array_join(F.transform("c", lambda x: x.cast("string")), ",").alias("chapters"))


def place_info(df: DataFrame, name: str, kind: str, parent: str, role: str, roles: list[str], chapter: str, pos: str) -> DataFrame:
    """First kind, first parent that is not null, strongest role and number of chapters of a place."""
    place = F.struct(chapter, pos)
    rank = F.array_position(F.array(*(F.lit(r) for r in roles)), F.col(role))
    return df.groupBy(name).agg(
        F.min_by(kind, place).alias("kind"),
        F.min_by(F.when(F.col(parent).isNotNull(), F.col(parent)), F.when(F.col(parent).isNotNull(), place)).alias("parent"),
        F.min_by(role, F.when(rank > 0, rank)).alias("role"),
        F.countDistinct(chapter).alias("mentions"),
    )


def visitors(df: DataFrame, place: str, person: str, chapter: str, resident: int = 3) -> DataFrame:
    """Visitors of places: chapters, first chapter, and whether so many make a resident."""
    n = df.groupBy(place, person).agg(F.countDistinct(chapter).alias("chapters"), F.min(chapter).alias("first"))
    return n.withColumn("resident", F.col("chapters") >= resident)


def co_items(df: DataFrame, item: str, chapter: str) -> DataFrame:
    """For each item the number of different items of its chapters, without itself.

    A chapter's items are bounded by its text; each pair is made and told apart once, and
    counts for both.
    """
    pairs = pair_edges(df, chapter, item)
    ends = pairs.select(F.explode(F.array("a", "b")).alias(item))
    return ends.groupBy(item).agg(F.count("*").alias("co_items"))


def best_of(df: DataFrame, keys: list[str], confidence: Column, chapter: str, pos: str) -> DataFrame:
    """Per key the row of highest confidence, the first on a tie."""
    rest = [c for c in df.columns if c not in keys]
    rank = F.struct(-confidence, F.col(chapter), F.col(pos))
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), rank).alias("__r")).select(*keys, "__r.*")


def trajectories(df: DataFrame, person: str, place: str, chapter: str, pos: str, least: int = 2) -> DataFrame:
    """Places of each person in order, once a chapter, for persons with ``least`` different places."""
    once = df.groupBy(person, place, chapter).agg(F.min(pos).alias("pos"))
    many = once.groupBy(person).agg(F.countDistinct(place).alias("n")).where(F.col("n") >= least)
    w = W.partitionBy(person).orderBy(chapter, "pos", place)
    return once.join(many.select(person), person, "left_semi").withColumn("step", F.row_number().over(w).cast("long")).select(person, "step", place, chapter)


def timeline(sources: list[DataFrame], least_cast: int = 5) -> DataFrame:
    """Events of several sources in one order with importance; each has chapter, pos, kind, text, importance, cast.

    Sources come in the order of the list within a chapter; many participants make an event important.
    """
    out = None
    for k, s in enumerate(sources):
        one = s.select("chapter", F.lit(k).alias("source"), "pos", "kind", "text", "importance", "cast")
        out = one if out is None else out.unionByName(one)
    high = F.when(F.col("cast") >= least_cast, "high").otherwise(F.col("importance"))
    place = F.row_number().over(W.partitionBy("chapter").orderBy("source", "pos", "text"))
    return out.withColumn("importance", high).withColumn("place", place.cast("long")).select("chapter", "place", "kind", "text", "importance")


def memberships(df: DataFrame, org: str, member: str, role: str, action: str, chapter: str, pos: str) -> DataFrame:
    """Members of organisations: their latest action and the latest role that is not null."""
    place = F.struct(chapter, pos)
    return df.groupBy(org, member).agg(
        F.max_by(action, place).alias("action"),
        F.max_by(F.when(F.col(role).isNotNull(), F.col(role)), F.when(F.col(role).isNotNull(), place)).alias("role"),
        F.min(chapter).alias("since"),
    )


def last_holders(df: DataFrame, item: str, actor: str, recipient: str, action: str, chapter: str, pos: str, gives: tuple[str, ...], ends: tuple[str, ...]) -> DataFrame:
    """Who holds an item last: the recipient of a gift, nobody after an end, else the actor."""
    holder = F.when(F.col(action).isin(*ends), "").when(F.col(action).isin(*gives), F.coalesce(recipient, actor)).otherwise(F.col(actor))
    return df.groupBy(item).agg(F.max_by(holder, F.struct(chapter, pos)).alias("holder"), F.count("*").alias("events"))


def gaps(pairs: DataFrame, known: DataFrame, mentions: DataFrame, limit: int) -> DataFrame:
    """Pairs that share chapters but have no relation: the ``limit`` with the highest weight times mentions."""
    m = mentions.select(F.col("name").alias("a"), F.col("n").alias("na"))
    k = mentions.select(F.col("name").alias("b"), F.col("n").alias("nb"))
    open_ = pairs.join(known.select("a", "b").distinct(), ["a", "b"], "left_anti").join(m, "a").join(k, "b")
    return open_.select("a", "b", (F.col("weight") * (F.col("na") + F.col("nb"))).alias("priority")).orderBy(F.desc("priority"), "a", "b").limit(limit)


def transitive(df: DataFrame, a: str, b: str, value: str, confidence: str) -> DataFrame:
    """One-hop directions: a to b and b to c of equal direction give a to c with less confidence (3 high, 1 low).

    Both high give medium, one medium gives low, less gives nothing; stated pairs are left out.
    """
    rows = df.groupBy(F.col(a).alias("a"), F.col(b).alias("b"), F.col(value).alias("v")).agg(F.max(confidence).alias("c"))
    x, y = rows.alias("x"), rows.alias("y")
    on = (F.col("x.b") == F.col("y.a")) & (F.col("x.v") == F.col("y.v")) & (F.col("x.a") != F.col("y.b"))
    c = F.least("x.c", "y.c") - 1
    found = x.join(y, on).where(c >= 1).groupBy(F.col("x.a").alias("a"), F.col("y.b").alias("b"), F.col("x.v").alias("v")).agg(F.max(c).alias("c"))
    return found.join(rows.select("a", "b").distinct(), ["a", "b"], "left_anti").join(rows.select(F.col("b").alias("a"), F.col("a").alias("b")).distinct(), ["a", "b"], "left_anti")


def dominant_relations(df: DataFrame, keys: list[str], kind: str, order: str, blood: tuple[str, ...], lock: int = 3) -> DataFrame:
    """The relation of a pair: a blood tie stated ``lock`` times wins, else the most frequent, first seen on a tie."""
    n = df.groupBy(*keys, kind).agg(F.count("*").alias("n"), F.min(order).alias("seen"))
    locked = (F.col(kind).isin(*blood) & (F.col("n") >= lock)).cast("int")
    return n.groupBy(*keys).agg(F.max_by(F.struct(kind, "n"), F.struct(locked, F.col("n"), -F.col("seen"))).alias("r"), F.sum("n").alias("mentions")).select(*keys, f"r.{kind}", "r.n", "mentions")
