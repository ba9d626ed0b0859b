"""Sinks: CSV, TSV, Markdown, JSON exports, partitioned tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_csv(df: DataFrame, path: str) -> None:
    df.write.option("header", True).mode("overwrite").csv(path)


def write_tsv(df: DataFrame, path: str, *order: str) -> None:
    """Tab separated, in order over the files."""
    df.orderBy(*order).write.option("sep", "\t").option("header", False).mode("overwrite").csv(path)


def append(df: DataFrame, path: str, *by: str) -> None:
    df.write.mode("append").partitionBy(*by).parquet(path)


def markdown(df: DataFrame, key: str, order: str, heading: str, body: str) -> DataFrame:
    """(key, markdown): sections of a key in order, each with a heading."""
    section = F.concat(F.lit("## "), F.col(heading), F.lit("\n\n"), F.regexp_replace(body, r"\|", "\\\\|"))
    rows = df.select(key, F.struct(order, section.alias("s")).alias("r"))
    return rows.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list("r")), lambda x: x["s"]), "\n\n").alias("markdown"))


def exported(novels: DataFrame, key: str, **tables: DataFrame) -> DataFrame:
    """(key, doc): one JSON document a novel with an array for each table, rows in the order of their columns."""
    out = novels.select(key, F.struct(*novels.columns).alias("__novel"))
    for name, t in tables.items():
        rows = t.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*(c for c in t.columns if c != key)))).alias(name))
        out = out.join(rows, key, "left")
    return out.select(key, F.to_json(F.struct(F.col("__novel").alias("novel"), *tables)).alias("doc"))


def imported(docs: DataFrame, doc: str, name: str, schema: str, key: str) -> DataFrame:
    """Rows of one table of exported documents."""
    rows = F.from_json(F.get_json_object(doc, f"$.{name}"), f"array<struct<{schema}>>")
    return docs.select(key, F.explode(rows).alias("r")).select(key, "r.*")


def import_counts(docs: DataFrame, doc: str, key: str, *names: str) -> DataFrame:
    """How many rows each section of a document has, without reading them in."""
    size = lambda n: F.coalesce(F.size(F.from_json(F.get_json_object(doc, f"$.{n}"), "array<string>")), F.lit(0)).alias(n)
    return docs.select(key, *(size(n) for n in names))
