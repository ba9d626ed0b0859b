"""Relation graphs: co-occurrence, primary types, filters, components and shortest paths."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a part of a large table.
PART_ROWS = 1_000_000


def pair_edges(df: DataFrame, chapter: str, person: str) -> DataFrame:
    """Unordered pairs of persons of a chapter with the number of chapters they share.

    The pairs of a chapter are bounded by its cast; one shuffle by the chapter serves both
    sides of the join. Large tables are dealt into so many parts that none outgrows a task.
    """
    base = df.select(F.col(chapter).alias("c"), F.col(person).alias("p"))
    parts = many_parts(base)
    rows = dealt(base, parts, "c").distinct()
    x, y = rows.alias("x"), rows.alias("y")
    on = (F.col("x.c") == F.col("y.c")) & (F.col("x.p") < F.col("y.p"))
    pairs = x.join(y, on).select(F.col("x.p").alias("a"), F.col("y.p").alias("b"))
    return dealt(pairs, parts, "a", "b").groupBy("a", "b").agg(F.count("*").alias("weight"))


def many_parts(df: DataFrame) -> int:
    """Parts for a table of more than PART_ROWS rows for each of the session's, else 0: the session's do."""
    parts = -(-df.count() // PART_ROWS)
    return parts if parts > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else 0


def dealt(df: DataFrame, parts: int, *keys: str) -> DataFrame:
    """``df`` dealt by its keys into so many parts; as it is for 0."""
    return df.repartition(parts, *keys) if parts else df


def typed_edges(df: DataFrame, a: str, b: str, kind: str, chapter: str, order: str) -> DataFrame:
    """Edges of stated relations: chapters, types and the primary type (most frequent, first seen on a tie)."""
    rows = df.where(F.col(a) != F.col(b)).select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"), F.col(kind).alias("kind"), F.col(chapter).alias("c"), F.col(order).alias("o"))
    by_kind = rows.groupBy("a", "b", "kind").agg(F.count("*").alias("n"), F.min("o").alias("seen"))
    primary = by_kind.groupBy("a", "b").agg(F.max_by("kind", F.struct("n", -F.col("seen"))).alias("primary"), F.count("*").alias("kinds"), F.sum("n").alias("mentions"))
    weight = rows.groupBy("a", "b").agg(F.countDistinct("c").alias("weight"))
    return primary.join(weight, ["a", "b"])


def nodes(edges: DataFrame) -> DataFrame:
    """Ends of edges with their degree and total weight."""
    ends = edges.select(F.col("a").alias("node"), "weight").union(edges.select(F.col("b"), "weight"))
    return ends.groupBy("node").agg(F.count("*").alias("degree"), F.sum("weight").alias("strength"))


def filtered(edges: DataFrame, shown: DataFrame, least: int) -> DataFrame:
    """Edges of at least ``least`` whose ends are both in ``shown`` (a column node)."""
    keep = edges.where(F.col("weight") >= least)
    return keep.join(shown.select(F.col("node").alias("a")), "a", "left_semi").join(shown.select(F.col("node").alias("b")), "b", "left_semi").select(edges.columns)


def components(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """node and the smallest node it is connected with, by smallest labels and pointer jumping.

    Every round is an aggregation over the edges and a join of the labels with themselves;
    the lineage is cut in the shared checkpoint folder.
    """
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b"), F.col("a"))).distinct()
    both = cut(both)
    label = cut(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("label")))
    for _ in range(rounds):
        near = both.join(label.select(F.col("u").alias("v"), F.col("label").alias("l")), "v").groupBy("u").agg(F.min("l").alias("l"))
        nxt = label.join(near, "u").select("u", F.least("label", "l").alias("label"))
        up = nxt.select(F.col("u").alias("r"), F.col("label").alias("top"))
        nxt = cut(nxt.join(up, F.col("label") == F.col("r"), "left").select("u", F.least("label", F.coalesce("top", "label")).alias("label")))
        moved = nxt.join(label.withColumnRenamed("label", "old"), "u").where("label <> old").limit(1).count()
        label = nxt
        if not moved:
            return label.select(F.col("u").alias("node"), F.col("label").alias("component"))
    raise RuntimeError("the components did not settle")


def shortest_paths(edges: DataFrame, start: object) -> DataFrame:
    """Steps from ``start`` to every node that it reaches, and the smallest predecessor of each: a round for each step."""
    both = cut(edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b"), F.col("a"))).distinct())
    kind = both.schema["u"].dataType
    seen = cut(both.sparkSession.range(1).select(F.lit(start).cast(kind).alias("node"), F.lit(0).cast("long").alias("steps"), F.lit(None).cast(kind).alias("via")))
    frontier, step = seen, 0
    while True:
        step += 1
        reach = frontier.join(both, F.col("node") == F.col("u")).groupBy("v").agg(F.min("u").alias("via"))
        new = reach.join(seen.select(F.col("node").alias("v")), "v", "left_anti")
        frontier = cut(new.select(F.col("v").alias("node"), F.lit(step).cast("long").alias("steps"), "via"))
        if not frontier.limit(1).count():
            break
        seen = cut(seen.union(frontier))
    return seen


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage: ``df`` written into the shared checkpoint folder of the session and read back.

    The copy is planned by its files' sizes. A checkpointed plan keeps the sizes estimated
    for it, which a loop of joins squares each round until planning takes longer than the work.
    Joins of the copy are merge joins: a loop's tables look small on disk, and each round
    would send them whole through the driver.
    """
    path = f"{scratch(df.sparkSession)}/loomfact/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path).hint("merge")


def scratch(spark: SparkSession) -> str:
    """The folder that driver and executors share; only in local mode, where none may be set, a temporary one."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.loomfact.scratch", None)
    if not where:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        where = tempfile.mkdtemp(prefix="spark-loomfact-", dir="/tmp")
        spark.conf.set("spark.loomfact.scratch", where)
    return where.rstrip("/")
