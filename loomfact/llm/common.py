"""Shared helpers: scratch tables in the cluster's shared folder and input readers."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import reduce, wraps
from operator import add

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, MapType, StringType, StructField, StructType

ASCII_SPACE = r"[\x20\x09-\x0D]+"
#: Rows and bytes up to which a table is broadcast; beyond either the join shuffles.
BROADCAST_ROWS = 500_000
BROADCAST_BYTES = 64 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    Only in local mode, where the setting may be absent, a temporary folder is chosen
    and remembered in the session; on a cluster such a folder would not be shared.
    """
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.loomfact.scratch", None)
    if not where:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        where = tempfile.mkdtemp(prefix="spark-loomfact-", dir="/tmp")
        spark.conf.set("spark.loomfact.scratch", where)
    return where.rstrip("/")


def written(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet into the shared folder and read it back.

    The copy has no lineage to recompute, so a lost executor costs only its own tasks.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/loomfact/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._loomfact_path = path
    return out


def dropped(df: DataFrame) -> None:
    """Delete a table made by :func:`written` that nothing reads any more."""
    path = getattr(df, "_loomfact_path", None)
    if path:
        jvm = df.sparkSession._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(where, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents table, whose rows go to Python in small batches."""
    small_batches(spark)
    return table(spark, sf_dir, "documents")


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Hand ``rows`` rows at a time to Python: whole texts are long, and both sides hold a batch in memory."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def _width(field: StructField) -> Column:
    """Bytes of a column's value, roughly."""
    c = F.col(f"`{field.name}`")
    if isinstance(field.dataType, StringType | BinaryType):
        return F.coalesce(F.octet_length(c), F.lit(0)) + 16
    if isinstance(field.dataType, StructType | ArrayType | MapType):
        return F.coalesce(F.octet_length(F.to_json(F.struct(c))), F.lit(0)) + 16
    return F.lit(8)


def small_enough(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> bool:
    """True if ``df`` has at most ``rows`` rows and ``size`` bytes; reads no more rows than it must."""
    width = reduce(add, map(_width, df.schema.fields), F.lit(0))
    n, total = df.limit(rows + 1).agg(F.count(F.lit(1)), F.sum(width)).first()
    return n <= rows and (total or 0) <= size


def maybe_broadcast(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if its counted rows and bytes allow it, else with one for a shuffled join."""
    return F.broadcast(df) if small_enough(df, rows) else shuffled(df)


def shuffled(df: DataFrame) -> DataFrame:
    """``df`` with a hint for a shuffled join: a written table's files may be small enough for Spark to broadcast rows that are not."""
    return df.hint("merge")


def give_back() -> None:
    """Give memory that Python has freed back to the system, which it would else keep for later."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def trimmed(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for mapInArrow, after which the worker gives its memory back.

    Workers live on for other tasks; without this each keeps the most that any task needed.
    """

    @wraps(run)
    def trimming(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return trimming
