"""Readers: raw books, gazetteers, JSON documents; all distributed, with explicit schemas."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# ---- fixed values: the columns of the GeoNames dump, in its order
GEONAMES = """geonameid long, name string, asciiname string, alternatenames string, lat double, lng double, feature_class string, feature_code string, country string,
cc2 string, admin1 string, admin2 string, admin3 string, admin4 string, population long, elevation int, dem int, timezone string, modified string"""
# ----


def decoded_text(raw: bytes | None) -> str:
    """Text of a file: by its mark, else as the first of UTF-8 and GB18030 that the whole file is, else UTF-8 with replacements."""
    if not raw:
        return ""
    for mark, kind in ((b"\xef\xbb\xbf", "utf-8"), (b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be")):
        if raw.startswith(mark):
            return raw[len(mark) :].decode(kind, "replace")
    for kind in ("utf-8", "gb18030"):
        try:
            return raw.decode(kind)
        except UnicodeDecodeError:
            continue
    return raw.decode("utf-8", "replace")


def decoded(raw: Column) -> Column:
    @F.pandas_udf(StringType())
    def decode(s: pd.Series) -> pd.Series:
        return s.map(lambda b: decoded_text(None if b is None else bytes(b)))

    return decode(raw)


def books(spark: SparkSession, path: str, pattern: str = "*.txt") -> DataFrame:
    """path, title (from the file's name), author (from the head of the text), file_hash and text of each file."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    rows = raw.select("path", F.sha2("content", 256).alias("file_hash"), decoded(F.col("content")).alias("text"))
    title = F.regexp_replace(F.url_decode(F.regexp_extract("path", r"([^/]+?)(\.[^./]*)?$", 1)), r"[《》]", "")
    author = F.regexp_extract(F.substring("text", 1, 500), r"(?iU)(?:作者|author|by)\s*[:：]?\s*([^\s,，]{1,20})", 1)
    return rows.select("path", title.alias("title"), author.alias("author"), "file_hash", "text")


def new_books(found: DataFrame, known: DataFrame) -> DataFrame:
    """Books whose hash is not in ``known`` yet, one for each hash."""
    fresh = found.join(known.select("file_hash").distinct(), "file_hash", "left_anti")
    return fresh.groupBy("file_hash").agg(F.min_by(F.struct("path", "title", "author", "text"), "path").alias("b")).select("file_hash", "b.*")


def gazetteer(spark: SparkSession, path: str) -> DataFrame:
    """The 19 columns of a GeoNames table."""
    return spark.read.option("sep", "\t").option("quote", "").schema(GEONAMES).csv(path)


def gazetteer_names(entries: DataFrame, only: str | None = None) -> DataFrame:
    """(lookup, geonameid, lat, lng, population, feature_code) for main and alternate names; ``only`` is a pattern of the latter."""
    alt = entries.select(F.explode(F.split(F.coalesce("alternatenames", F.lit("")), ",")).alias("lookup"), "geonameid", "lat", "lng", "population", "feature_code").where("lookup <> ''")
    alt = alt.where(F.col("lookup").rlike(only)) if only else alt
    main = entries.select(F.col("name").alias("lookup"), "geonameid", "lat", "lng", "population", "feature_code")
    return main.union(alt).distinct()


def resolved_names(names: DataFrame, lookup: DataFrame, ranks: dict[str, int]) -> DataFrame:
    """Each name's best entry: by the rank of its feature, then population, then id."""
    rank = F.coalesce(*(F.when(F.col("feature_code") == k, v) for k, v in ranks.items()), F.lit(99))
    j = names.select("name").distinct().join(lookup, F.col("name") == F.col("lookup"))
    best = j.groupBy("name").agg(F.min_by(F.struct("geonameid", "lat", "lng", "population"), F.struct(rank, -F.col("population"), F.col("geonameid"))).alias("e"))
    return best.select("name", "e.*")


def documents_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON documents, plain or compressed, one a file."""
    return spark.read.schema(schema).option("multiLine", True).json(path)
