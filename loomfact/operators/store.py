"""Keyed tables on plain Parquet: latest rows, upserts, versions, overlays and diffs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def latest(df: DataFrame, keys: list[str], *order: str | Column) -> DataFrame:
    """The row of each key with the greatest ``order``; one aggregation, no sort."""
    rest = [c for c in df.columns if c not in keys]
    rank = F.struct(*(F.col(c) if isinstance(c, str) else c for c in order))
    top = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), rank).alias("__row"))
    return top.select(*keys, "__row.*").select(*df.columns)


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``old`` with the rows of ``new`` in place of those with equal keys (null keys match)."""
    same = [F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in keys]
    kept = old.alias("o").join(new.alias("n"), same, "left_anti")
    return kept.unionByName(new, allowMissingColumns=True)


def without(df: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    """``df`` without the keys of ``gone``; a cascade is this on each child table."""
    return df.join(gone.select(*keys).distinct(), keys, "left_anti")


def first_rows(df: DataFrame, keys: list[str], *order: str | Column) -> DataFrame:
    """The row of each key with the least ``order``, as insertion order decides ties."""
    rest = [c for c in df.columns if c not in keys]
    rank = F.struct(*(F.col(c) if isinstance(c, str) else c for c in order))
    top = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), rank).alias("__row"))
    return top.select(*keys, "__row.*").select(*df.columns)


def rollback(versions: DataFrame, key: str, to: Column) -> DataFrame:
    """Append a copy of each key's version ``to`` as its next version; later ones stay."""
    top = versions.groupBy(key).agg((F.max("version") + 1).alias("__next"))
    copy = versions.where(F.col("version") == to).join(top, key).withColumn("version", F.col("__next")).drop("__next")
    return versions.unionByName(copy)


def overlay(base: DataFrame, change: DataFrame, keys: list[str], value: str) -> DataFrame:
    """``base`` with the values of ``change``; a null value there deletes the key."""
    b = base.select(*keys, F.col(value).alias("__old"))
    c = change.select(*keys, F.col(value).alias("__new"), F.lit(True).alias("__set"))
    both = b.join(c, keys, "full_outer")
    return both.withColumn(value, F.when(F.col("__set"), F.col("__new")).otherwise(F.col("__old"))).where(F.col(value).isNotNull()).select(*keys, value)


def added_votes(base: DataFrame, delta: DataFrame, keys: list[str], weight: str = "weight") -> DataFrame:
    """Votes of both tables added up by key."""
    return base.select(*keys, weight).unionByName(delta.select(*keys, weight)).groupBy(*keys).agg(F.sum(weight).alias(weight))


def parent_changes(old: DataFrame, new: DataFrame, known: DataFrame) -> DataFrame:
    """Old against new parents: child, kind (added, changed, removed), both parents and auto_select.

    A removal, a name that contains its old parent and a new parent that is not known are not selected.
    """
    o = old.select("child", F.col("parent").alias("old_parent"))
    n = new.select("child", F.col("parent").alias("new_parent"))
    both = o.join(n, "child", "full_outer").where(~F.col("old_parent").eqNullSafe(F.col("new_parent")))
    kind = F.when(F.col("old_parent").isNull(), "added").when(F.col("new_parent").isNull(), "removed").otherwise("changed")
    both = both.join(known.select(F.col("name").alias("new_parent"), F.lit(True).alias("__known")).distinct(), "new_parent", "left")
    held = F.col("old_parent").isNotNull() & F.contains(F.col("child").cast("string"), F.col("old_parent").cast("string"))
    auto = F.col("new_parent").isNotNull() & F.col("__known").isNotNull() & ~held
    return both.select("child", kind.alias("kind"), "old_parent", "new_parent", auto.alias("auto_select"))
