"""Sharding by extendible hashing, with DataFrame operations only.

Every row has a string of hash bits. The directory starts with one bucket; a bucket
over the byte limit is split on one more bit, others stay as they are, so shards have
prefixes of different lengths. Sums are made once for fine prefixes (combined before
the shuffle) and added up for all shorter ones; only prefixes that are still too large
at that depth go into another round with more bits. A row's bits come from its id and
its text, and, should whole rows repeat, from its place in the input after that.

Defined cases: null text has no bytes, a null id counts as an empty one; a row larger
than the limit gets a shard of its own (``oversize``); an empty table gives no shards.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import maybe_broadcast, shuffled, written

LIMIT_BYTES = 1 << 20
#: Bits of the hash of id and text, and of the place in the input.
KEY_BITS = 48
PLACE_BITS = 48
#: Bits by which a round looks beyond the depth that even shards would have.
LOOK_AHEAD = 6


def _bits(hex12: Column) -> Column:
    return F.lpad(F.bin(F.conv(hex12, 16, 10).cast("long")), KEY_BITS, "0")


def _hash_bits() -> Column:
    """Bits of id and text, then of the place in the input."""
    text = F.coalesce(F.col("text"), F.lit(""))
    key = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("\x01"), F.md5(text.cast("binary")))
    own = F.md5(F.monotonically_increasing_id().cast("string").cast("binary"))
    return F.concat(_bits(F.substring(F.md5(key.cast("binary")), 1, 12)), _bits(F.substring(own, 1, 12)))


def _n_bytes() -> Column:
    return F.octet_length(F.coalesce(F.col("text"), F.lit(""))).cast("long")


def hashed_rows(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and hash bits of each row."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), _n_bytes().alias("n_bytes"), _hash_bits().alias("bits"))


def directory(rows: DataFrame, limit: int = LIMIT_BYTES) -> DataFrame:
    """(base_depth, base, depth): each prefix of ``base_depth`` bits lies in the shard of its first ``depth`` bits."""
    total = rows.agg(F.sum("n_bytes")).first()[0] or 0
    deepest = KEY_BITS + PLACE_BITS
    base_depth = min(deepest, max(0, math.ceil(math.log2(max(1, total / limit)))) + LOOK_AHEAD)
    open_rows, made, above = rows, None, 0
    while True:
        base = open_rows.groupBy(F.substring("bits", 1, base_depth).alias("base")).agg(F.sum("n_bytes").alias("b"), F.count("*").alias("n"))
        base = written(base, "prefixes")
        depths = base.select("base", "b", "n", F.explode(F.sequence(F.lit(above), F.lit(base_depth))).alias("depth"))
        depths = depths.withColumn("prefix", F.expr("substring(base, 1, depth)"))
        sums = depths.groupBy("depth", "prefix").agg(F.sum("b").alias("b"), F.sum("n").alias("n"))
        fits = sums.where((F.col("b") <= limit) | (F.col("n") == 1)).select("depth", "prefix")
        found = depths.select("base", "depth", "prefix").join(shuffled(fits), ["depth", "prefix"])
        found = written(found.groupBy("base").agg(F.min("depth").alias("depth")), "directory")
        part = found.select(F.lit(base_depth).alias("base_depth"), "base", "depth")
        made = part if made is None else made.union(part)
        left = base.join(shuffled(found), "base", "left_anti").select("base")
        if base_depth == deepest:  # rows that no bit tells apart share a shard, over the limit
            return made.union(left.select(F.lit(deepest).alias("base_depth"), "base", F.lit(deepest).alias("depth")))
        if not left.limit(1).count():
            return made
        left = written(left, "oversize")
        open_rows = open_rows.join(maybe_broadcast(left), F.substring("bits", 1, base_depth) == F.col("base"), "left_semi")
        above, base_depth = base_depth, min(deepest, base_depth + 12)


def _placed(rows: DataFrame, made: DataFrame, bits: str) -> DataFrame:
    """``rows`` with __lf_depth and __lf_shard, the shard of their bits.

    The directory has 2 ** LOOK_AHEAD prefixes for each shard, so it is joined by a shuffle and never sent to the driver.
    """
    depths = [r[0] for r in made.select("base_depth").distinct().collect()]
    made = written(made, "placed")
    out = None
    for d in depths or [0]:  # one round of the directory each, nearly always one
        own = made.where(F.col("base_depth") == d).select(F.col("base").alias("__lf_base"), F.col("depth").alias("__lf_depth"))
        hit = rows.join(shuffled(own), F.substring(bits, 1, d) == F.col("__lf_base")).drop("__lf_base")
        out = hit if out is None else out.union(hit)
    return out.withColumn("__lf_shard", F.expr(f"substring({bits}, 1, __lf_depth)"))


def shards(docs: DataFrame, limit: int = LIMIT_BYTES) -> DataFrame:
    """doc_id, n_bytes, shard (its prefix of bits), depth and oversize of each row."""
    rows = written(hashed_rows(docs), "hashed")
    out = _placed(rows, directory(rows, limit), "bits")
    return out.select("doc_id", "n_bytes", F.col("__lf_shard").alias("shard"), F.col("__lf_depth").cast("long").alias("depth"), (F.col("n_bytes") > limit).alias("oversize"))


def write_sharded(docs: DataFrame, folder: str, limit: int = LIMIT_BYTES) -> None:
    """Write ``docs`` with all their columns, one folder for each shard: ``__lf_shard=b`` and its bits.

    (Bits alone would be read back as a number, and 0 and 00 as one shard.)
    Every row is written once with its bits, place included, before shards are made, so
    rows that repeat are told apart as the directory tells them apart.
    """
    rows = written(docs.withColumns({"__lf_bits": _hash_bits(), "__lf_bytes": _n_bytes()}), "hashed")
    made = directory(rows.select(F.col("__lf_bytes").alias("n_bytes"), F.col("__lf_bits").alias("bits")), limit)
    out = _placed(rows, made, "__lf_bits").select(*(F.col(f"`{c}`") for c in docs.columns), F.concat(F.lit("b"), F.col("__lf_shard")).alias("__lf_shard"))
    out.repartition("__lf_shard").write.partitionBy("__lf_shard").parquet(folder)
