"""Quality measures: topology against a gold tree, agreement, bootstrap and label ratios."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _ratio(a: Column, b: Column) -> Column:
    """a / b in units of 1/10000, rounded down, 0 for an empty denominator: whole numbers compare exactly."""
    return F.when(b == 0, F.lit(0).cast("long")).otherwise(F.floor(a * 10000 / b).cast("long"))


def parent_scores(predicted: DataFrame, gold: DataFrame) -> DataFrame:
    """Precision, recall and orphans of predicted parents, as parts of 10000."""
    both = gold.select("child", F.col("parent").alias("want")).join(predicted.select("child", F.col("parent").alias("got")), "child", "left")
    n = both.agg(F.count("*").alias("gold"), F.count("got").alias("covered"), F.count_if(F.col("got") == F.col("want")).alias("right"))
    return n.select("gold", "covered", "right", _ratio(F.col("right"), F.col("covered")).alias("precision"), _ratio(F.col("right"), F.col("gold")).alias("recall"), _ratio(F.col("gold") - F.col("covered"), F.col("gold")).alias("orphans"))


def kappa(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Cohen's kappa of two raters, with its contingency in one aggregation."""
    cells = pairs.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("n"))
    rows, cols = cells.groupBy("a").agg(F.sum("n").alias("ra")), cells.groupBy("b").agg(F.sum("n").alias("cb"))
    chance = rows.join(cols, rows.a == cols.b).agg(F.sum(F.col("ra") * F.col("cb")).alias("chance"))
    seen = cells.agg(F.sum("n").alias("n"), F.sum(F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0)).alias("same"))
    po, pe = F.col("same") / F.col("n"), F.col("chance") / (F.col("n") * F.col("n"))
    k = F.when(pe == 1, F.lit(1.0)).otherwise((po - pe) / (1 - pe))
    return seen.join(F.broadcast(chance)).select("n", "same", "chance", F.floor(k * 10000).cast("long").alias("kappa"))


def strata(flags: DataFrame, stratum: str, flag: str) -> DataFrame:
    """Rows, flagged rows and the unflagged share (in parts of 10000) of each stratum; null flags do not count."""
    n = flags.where(F.col(flag).isNotNull()).groupBy(stratum).agg(F.count("*").alias("nodes"), F.count_if(F.col(flag).cast("int") != 0).alias("errors"))
    return n.select(stratum, "nodes", "errors", _ratio(F.col("nodes") - F.col("errors"), F.col("nodes")).alias("overall"))


def resampled(flags: DataFrame, stratum: str, flag: str, rounds: int = 10_000, seed: int = 42, block: int = 250) -> DataFrame:
    """round, total and nodes: the sum of a resample's flags, each stratum drawn with replacement to its own size.

    Rows of one stratum and flag are a cell with a count. How often each cell is drawn is
    multinomial, so a round draws one number for each cell (binomials chained) and not one
    for each row; draws depend on the seed, the stratum and the block of rounds alone, so
    any partitioning and any retry give the same.
    """
    cells = flags.where(F.col(flag).isNotNull()).groupBy(F.col(stratum).cast("string").alias("s"), F.col(flag).cast("long").alias("flag")).agg(F.count("*").alias("n"))
    whole = cells.groupBy("s").agg(F.array_sort(F.collect_list(F.struct("flag", "n"))).alias("c"))
    starts = F.sequence(F.lit(0), F.lit(rounds - 1), F.lit(block))
    rows = whole.select(F.xxhash64(F.coalesce("s", F.lit(""))).alias("key"), F.transform("c", lambda x: x["flag"]).alias("flags"), F.transform("c", lambda x: x["n"]).alias("counts"), F.explode(starts).alias("start"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for key, values, counts, start in zip(f["key"].tolist(), f["flags"], f["counts"], f["start"].tolist(), strict=True):
                rng, n = np.random.default_rng([seed, key & 0xFFFFFFFFFFFFFFFF, start]), int(np.sum(counts))
                drawn = rng.multinomial(n, np.asarray(counts, float) / n, min(block, rounds - start))
                yield pd.DataFrame({"round": np.arange(start, start + len(drawn)), "total": drawn @ np.asarray(values, np.int64), "nodes": n})

    return rows.mapInPandas(run, "round long, total long, nodes long").groupBy("round").agg(F.sum("total").alias("total"), F.sum("nodes").alias("nodes"))


def bootstrap(flags: DataFrame, stratum: str, flag: str, rounds: int = 10_000, seed: int = 42) -> DataFrame:
    """One row: nodes, the share without a flag (point), and mean, std, low and high (95 %) of that share over the resamples."""
    drawn = resampled(flags, stratum, flag, rounds, seed).select((1 - F.col("total") / F.col("nodes")).alias("m"))
    held = drawn.agg(F.sort_array(F.collect_list("m")).alias("ms"), F.avg("m").alias("mean"), F.stddev_pop("m").alias("std"))  # ``rounds`` numbers
    point = flags.where(F.col(flag).isNotNull()).agg(F.count("*").alias("nodes"), (1 - F.sum(F.col(flag).cast("long")) / F.count("*")).alias("point"))
    at = lambda q: F.get("ms", F.lit(int(q * rounds)))
    return point.join(F.broadcast(held)).select("nodes", "point", "mean", "std", at(0.025).alias("low"), at(0.975).alias("high"))  # two single rows


def label_ratio(labels: DataFrame, by: str, good: Column) -> DataFrame:
    """Rows and good ones of each group, the share in parts of 10000; unlabelled rows do not count."""
    n = labels.groupBy(by).agg(F.count(good).alias("n"), F.count_if(good).alias("good"))
    return n.select(by, "n", "good", _ratio(F.col("good"), F.col("n")).alias("share"))
