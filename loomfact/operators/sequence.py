"""Operators over ordered rows of a key: runs, regressions, changes, transitions, as-of values.

Each is a window over one key and its order columns, so a plan has one shuffle on the key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def stage_runs(df: DataFrame, keys: list[str], order: list[str], value: str, detail: str) -> DataFrame:
    """Runs of equal consecutive values: run number, value, first and last place, rows and the distinct details in order."""
    w = W.partitionBy(*keys).orderBy(*order)
    new = (~F.col(value).eqNullSafe(F.lag(value).over(w))) | (F.row_number().over(w) == 1)
    runs = df.withColumn("__new", new.cast("int")).withColumn("run", F.sum("__new").over(w).cast("long"))
    place = F.struct(*order)
    got = runs.groupBy(*keys, "run").agg(
        F.first(value).alias(value),
        F.min(place).alias("__first"),
        F.max(place).alias("__last"),
        F.count("*").alias("n"),
        F.array_sort(F.collect_list(F.struct(*order, detail))).alias("__rows"),
    )
    details = F.array_distinct(F.transform("__rows", lambda x: x[detail].cast("string")))
    return got.select(*keys, "run", value, F.col("__first")[order[0]].alias("first"), F.col("__last")[order[0]].alias("last"), "n", F.array_join(details, ",").alias("details"))


def regressions(df: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """Rows whose value an earlier row, but not the row before, had: the nearest such row is given.

    The nearest earlier equal value is the lag within (key, value); no pairs are made.
    """
    w = W.partitionBy(*keys).orderBy(*order)
    at = df.withColumn("__n", F.row_number().over(w)).withColumn("between", F.lag(value).over(w))
    again = W.partitionBy(*keys, value).orderBy("__n")
    at = at.withColumn("__seen", F.lag("__n").over(again)).withColumn("since", F.lag(order[0]).over(again))
    hit = at.where((F.col("__seen") <= F.col("__n") - 2) & ~F.col("between").eqNullSafe(F.col(value)))
    return hit.select(*keys, value, "between", "since", F.col(order[0]).alias("at"))


def flips(df: DataFrame, keys: list[str], order: list[str], value: str, a: Column, b: Column) -> DataFrame:
    """Adjacent rows of which one meets ``a`` and the other ``b`` (conditions on the value column)."""
    w = W.partitionBy(*keys).orderBy(*order)
    rows = df.withColumn("__a", a).withColumn("__b", b)
    rows = rows.withColumn("before", F.lag(value).over(w)).withColumn("__pa", F.lag("__a").over(w)).withColumn("__pb", F.lag("__b").over(w))
    hit = rows.where((F.col("__pa") & F.col("__b")) | (F.col("__pb") & F.col("__a")))
    return hit.select(*keys, F.col(order[0]).alias("at"), "before", value)


def changes(df: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """The first row of each key and every row whose value differs from the one before."""
    w = W.partitionBy(*keys).orderBy(*order)
    rows = df.withColumn("before", F.lag(value).over(w)).withColumn("__n", F.row_number().over(w))
    hit = rows.where((F.col("__n") == 1) | ~F.col("before").eqNullSafe(F.col(value)))
    return hit.select(*keys, F.col(order[0]).alias("at"), "before", value)


def first_appearances(df: DataFrame, key: list[str], chapter: str, least: int) -> DataFrame:
    """First chapter of keys that appear in at least ``least`` different chapters."""
    got = df.groupBy(*key).agg(F.min(chapter).alias("first"), F.countDistinct(chapter).alias("chapters"))
    return got.where(F.col("chapters") >= least)


def after_end(df: DataFrame, keys: list[str], chapter: str, ends: Column) -> DataFrame:
    """Keys that appear again after the first row that ends them: the end and the first later chapter."""
    end = df.where(ends).groupBy(*keys).agg(F.min(chapter).alias("ended"))
    later = df.join(end, keys).where(F.col(chapter) > F.col("ended"))
    return later.groupBy(*keys, "ended").agg(F.min(chapter).alias("again"))


def minorities(df: DataFrame, key: str, value: str, order: str, least: int = 2) -> DataFrame:
    """Values of a key that are not its most frequent one (first seen on a tie) but occur ``least`` times."""
    n = df.groupBy(key, value).agg(F.count("*").alias("n"), F.min(order).alias("seen"))
    rank = F.struct("n", -F.col("seen"))
    top = n.groupBy(key).agg(F.max_by(value, rank).alias("most"), F.count("*").alias("values"))
    return n.join(top, key).where((F.col("values") > 1) & (F.col(value) != F.col("most")) & (F.col("n") >= least)).select(key, value, "most", "n")


def opposites(df: DataFrame, a: str, b: str, value: str, chapter: str, opposite: dict[str, str]) -> DataFrame:
    """Unordered pairs with contradictory directions: both directions and their first chapters.

    The direction is turned round with the pair, so one aggregation brings the two together.
    """
    pairs = [F.lit(x) for kv in opposite.items() for x in kv]
    turned = F.coalesce(F.create_map(*pairs)[F.col(value)], F.col(value))
    rows = df.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"), F.when(F.col(a) > F.col(b), turned).otherwise(F.col(value)).alias("dir"), chapter)
    n = rows.groupBy("a", "b", "dir").agg(F.min(chapter).alias("first"), F.count("*").alias("n"))
    other = n.select("a", "b", F.create_map(*pairs)[F.col("dir")].alias("dir"), F.col("dir").alias("other"), F.col("first").alias("other_first"), F.col("n").alias("other_n"))
    return n.join(other, ["a", "b", "dir"]).where("dir < other")


def distance_gaps(df: DataFrame, a: str, b: str, rank: str, seen: str, least: int = 2) -> DataFrame:
    """Pairs whose ordinal distances differ by ``least`` or more; the distance seen first is ``one``."""
    n = df.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"), F.col(rank).alias("rank"), seen).groupBy("a", "b", "rank").agg(F.min(seen).alias("seen"))
    x, y = n.alias("x"), n.alias("y")
    on = (F.col("x.a") == F.col("y.a")) & (F.col("x.b") == F.col("y.b")) & (F.struct("x.seen", "x.rank") < F.struct("y.seen", "y.rank"))
    gap = F.abs(F.col("x.rank") - F.col("y.rank"))
    return x.join(y, on & (gap >= least)).select("x.a", "x.b", F.col("x.rank").alias("one"), F.col("y.rank").alias("two"), gap.alias("gap"))


def transitions(df: DataFrame, keys: list[str], order: list[str], place: str) -> DataFrame:
    """Directed edges between the places of consecutive rows, without rows that have none: count and keys."""
    w = W.partitionBy(*keys).orderBy(*order)
    rows = df.where(F.col(place).isNotNull()).withColumn("to", F.lead(place).over(w))
    edges = rows.where((F.col("to").isNotNull()) & (F.col("to") != F.col(place)))
    return edges.groupBy(F.col(place).alias("from"), "to").agg(F.count("*").alias("n"))


def siblings(edges: DataFrame, least: int = 3) -> DataFrame:
    """Pairs with edges both ways and ``least`` together."""
    both = edges.select(F.least("from", "to").alias("a"), F.greatest("from", "to").alias("b"), "n", (F.col("from") < F.col("to")).alias("__up"))
    got = both.groupBy("a", "b").agg(F.sum("n").alias("n"), F.countDistinct("__up").alias("__ways"))
    return got.where((F.col("__ways") == 2) & (F.col("n") >= least)).select("a", "b", "n")


def hubs(edges: DataFrame, least: int = 4) -> DataFrame:
    """Places with ``least`` or more neighbours that edges join both ways."""
    both = siblings(edges, 2)
    ends = both.select(F.col("a").alias("place")).union(both.select(F.col("b")))
    return ends.groupBy("place").agg(F.count("*").alias("neighbours")).where(F.col("neighbours") >= least)


def as_of(left: DataFrame, right: DataFrame, keys: list[str], at: str, value: str) -> DataFrame:
    """``left`` with the value of the last ``right`` row at or before it: a union and one window, no range join.

    On the same moment the right row comes first; of several right rows there the greatest value counts.
    """
    names = [c for c in left.columns if c not in keys and c != at]
    top = right.groupBy(*keys, at).agg(F.max(value).alias(value))
    l = left.select(*keys, at, F.struct(*names).alias("__row"), F.lit(None).cast(top.schema[value].dataType).alias(value), F.lit(1).alias("__side"))
    r = top.select(*keys, at, F.lit(None).cast(l.schema["__row"].dataType).alias("__row"), value, F.lit(0).alias("__side"))
    w = W.partitionBy(*keys).orderBy(at, "__side").rowsBetween(W.unboundedPreceding, 0)
    both = l.unionByName(r).withColumn("__value", F.last(value, ignorenulls=True).over(w))
    return both.where("__side = 1").select(*keys, at, "__row.*", F.col("__value").alias(value))


def increasing(df: DataFrame, keys: list[str], order: list[str], number: str) -> DataFrame:
    """The greedy strictly increasing subsequence: rows above the running maximum before them."""
    w = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    rows = df.withColumn("__top", F.max(number).over(w))
    return rows.where(F.col("__top").isNull() | (F.col(number) > F.col("__top"))).drop("__top")


def merged_adjacent(df: DataFrame, keys: list[str], order: str, label: Column, text: str) -> DataFrame:
    """Adjacent rows with equal labels as one: first place, label, rows and the texts joined by line feeds."""
    w = W.partitionBy(*keys).orderBy(order)
    rows = df.withColumn("__label", label)
    rows = rows.withColumn("__new", F.when(F.col("__label").eqNullSafe(F.lag("__label").over(w)) & (F.row_number().over(w) > 1), 0).otherwise(1))
    rows = rows.withColumn("run", F.sum("__new").over(w))
    got = rows.groupBy(*keys, "run").agg(F.min(order).alias("first"), F.first("__label").alias("label"), F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct(order, text))).alias("__rows"))
    return got.select(*keys, "first", "label", "n", F.array_join(F.transform("__rows", lambda x: x[text]), "\n").alias("text"))


def repeated_tails(lines: DataFrame, section: list[str], line_no: str, text: str, group: list[str], tail: int = 5, share: float = 0.5, least: int = 4) -> DataFrame:
    """Lines that stand among the last ``tail`` of at least ``share`` of a group's sections."""
    place = F.row_number().over(W.partitionBy(*group, *section).orderBy(F.desc(line_no)))
    last = lines.where(F.trim(text) != "").withColumn("__k", place).where(F.col("__k") <= tail)
    total = lines.groupBy(*group).agg(F.countDistinct(*section).alias("__sections")).where(F.col("__sections") >= least)
    n = last.select(*group, *section, text).distinct().groupBy(*group, text).agg(F.count("*").alias("n"))
    return n.join(total, group).where(F.col("n") >= share * F.col("__sections")).select(*group, text, "n")


def kept_by_spacing(df: DataFrame, keys: list[str], order: str, score: str, threshold: float, spacing: int, strong: float, strong_spacing: int) -> DataFrame:
    """Break points: a score of ``threshold`` far enough from the last break; strong ones may be nearer.

    The rule depends on the last kept break, so it is a fold over the ordered array of a key.
    """
    rows = df.where(F.col(score) >= threshold).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(order, score))).alias("__rows"))
    kind = df.schema[order].dataType.simpleString()
    start = F.expr(f"cast(array() as array<{kind}>)")

    def step(kept: Column, x: Column) -> Column:
        far = F.when(x[score] >= strong, F.lit(strong_spacing)).otherwise(F.lit(spacing))
        ok = (F.size(kept) == 0) | (x[order] - F.element_at(kept, -1) >= far)
        return F.when(ok, F.concat(kept, F.array(x[order]))).otherwise(kept)

    return rows.select(*keys, F.explode(F.aggregate("__rows", start, step)).alias(order))


def contiguous(ranges: DataFrame, key: str, order: str, start: str, last: str) -> DataFrame:
    """Ranges made contiguous: each begins where the greatest end before it stopped, the first at 0."""
    w = W.partitionBy(key).orderBy(order)
    before = w.rowsBetween(W.unboundedPreceding, -1)
    rows = ranges.withColumn("__to", F.max(last).over(before))
    begin = F.when(F.col("__to").isNull(), 0).otherwise(F.col("__to") + 1)
    rows = rows.withColumn("begin", begin).withColumn("end", F.greatest(F.col(last), F.col("begin")))
    return rows.select(key, order, "begin", "end")
