"""Token-id files: blocks coded by a shared static range asymmetric numeral system.

The format is a folder with two Parquet tables. ``table`` holds (symbol, freq),
``blocks`` one row a block: its place in the order (file_no, block_no), the fields
of :mod:`rans` and the documents it holds with their numbers of ids. Documents are in
ascending doc_id order over (file_no, block_no, position). Spark's own writer makes
the files, so a lost executor leaves no half of one behind.

Defined cases: a null or empty text is the end id alone; null doc_ids come first;
rows that repeat a doc_id stand next to each other; an empty table gives no blocks.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import maybe_broadcast, shared_dir, trimmed, written
from .packing import slices
from .rans import BITS, Coder, quantised
from .tokens import tokenizer, vocabulary

#: ids of a block and of a file; a block holds whole documents, so the last may carry it further.
BLOCK_IDS = 1 << 18
FILE_IDS = 16 << 20
#: Files whose starts one window works out.
RUN_FILES = 1024
_BLOCK_FIELDS = """file_no int, block_no int, file_offset long, n_ids long, lanes int, crc32 long, states binary, words binary,
    check_steps array<int>, check_words array<long>, check_states binary, doc_ids array<long>, doc_sizes array<long>"""


def tokenise(docs: DataFrame, path: str, end_id: int) -> DataFrame:
    """doc_id, n_tokens and ids (little-endian unsigned, 16 bits each if the vocabulary allows it)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lib = tokenizer(path)
        kind = np.dtype("<u2" if max(len(lib.is_end), end_id + 1) <= 1 << 16 else "<u4")
        for b in batches:
            for at, texts in slices(b.column("text")):
                flat, size = lib.encode(texts)
                flat, size = np.insert(flat, np.cumsum(size), end_id).astype(kind), size + 1
                cuts = np.concatenate([[0], np.cumsum(size) * kind.itemsize]).astype(np.int32)
                ids = pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(cuts), pa.py_buffer(flat)])
                cols = [b.column("doc_id").slice(at, len(size)), pa.array(size), pa.array(np.full(len(size), kind.itemsize, np.int32)), ids]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_tokens", "width", "ids"])

    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return base.mapInArrow(trimmed(run), "doc_id long, n_tokens long, width int, ids binary")


def _joined(b: pa.RecordBatch) -> np.ndarray:
    """The ids of all rows of a batch, one after the other."""
    ids = b.column("ids").to_pylist()
    kind = "<u2" if len(b) and b.column("width")[0].as_py() == 2 else "<u4"
    return np.frombuffer(b"".join(ids), kind)


def symbol_counts(tokens: DataFrame) -> np.ndarray:
    """How often each symbol occurs in all documents; as long as the vocabulary at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for b in batches:
            own = np.bincount(_joined(b))
            if len(own) > len(total):
                own, total = total, own
            total[: len(own)] += own
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], names=["symbol", "n"])

    rows = tokens.select("width", "ids").mapInArrow(trimmed(run), "symbol long, n long").groupBy("symbol").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(max((r.symbol for r in rows), default=-1) + 1, np.int64)
    for r in rows:
        out[r.symbol] = r.n
    return out


def write_token_files(docs: DataFrame, folder: str, path: str | None = None, end_id: int = 2) -> None:
    """Tokenise ``docs`` and write the format's two tables into ``folder``."""
    spark = docs.sparkSession
    tokens = written(tokenise(docs, path or vocabulary(), end_id), "tokens")
    freq = quantised(symbol_counts(tokens))
    total = tokens.agg(F.sum("n_tokens")).first()[0] or 0
    seen = [(int(s), int(freq[s])) for s in np.flatnonzero(freq)]
    spark.createDataFrame(seen, "symbol long, freq long").coalesce(1).write.parquet(f"{folder}/table")
    shared = spark.sparkContext.broadcast(freq)  # as long as the vocabulary at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, number, offset = Coder(shared.value, BITS), 0, 0
        held: list[np.ndarray] = []
        doc_ids: list = []
        sizes: list[int] = []

        def block(file_no: int) -> pa.RecordBatch:
            made = coder.encode(np.concatenate(held)) | {"file_no": file_no, "block_no": number, "file_offset": offset, "doc_ids": doc_ids, "doc_sizes": sizes}
            return pa.RecordBatch.from_pylist([made], schema=_schema())

        n, file_no = 0, 0
        for b in batches:
            if not len(b):
                continue
            file_no, ids = b.column("file_no")[0].as_py(), _joined(b)
            own_ids, own_sizes = b.column("doc_id").to_pylist(), b.column("n_tokens").to_pylist()
            at = 0
            for doc_id, size in zip(own_ids, own_sizes, strict=True):
                held.append(ids[at : at + size])
                doc_ids.append(doc_id)
                sizes.append(size)
                at, n = at + size, n + size
                if n >= BLOCK_IDS:
                    yield block(file_no)
                    number, offset, n, held, doc_ids, sizes = number + 1, offset + n, 0, [], [], []
        if n:
            yield block(file_no)

    files = max(1, -(-total // FILE_IDS))
    tie = F.xxhash64("ids")  # rows that repeat a doc_id spread over files as well
    ordered = tokens.withColumn("tie", tie).repartitionByRange(files, "doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    ordered = ordered.select("doc_id", "n_tokens", "width", "ids", F.spark_partition_id().alias("file_no"))
    ordered.mapInArrow(trimmed(run), _BLOCK_FIELDS).write.option("compression", "none").parquet(f"{folder}/blocks")


def _schema() -> pa.Schema:
    long, raw = pa.int64(), pa.binary()
    return pa.schema(
        [("file_no", pa.int32()), ("block_no", pa.int32()), ("file_offset", long), ("n_ids", long), ("lanes", pa.int32()), ("crc32", long), ("states", raw), ("words", raw)]
        + [("check_steps", pa.list_(pa.int32())), ("check_words", pa.list_(long)), ("check_states", raw), ("doc_ids", pa.list_(long)), ("doc_sizes", pa.list_(long))]
    )


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens and ids (little-endian unsigned 32-bit) of each document; blocks are decoded apart."""
    blocks = spark.read.schema(_BLOCK_FIELDS).parquet(f"{folder}/blocks")
    rows = spark.read.parquet(f"{folder}/table").collect()  # as long as the vocabulary at most
    freq = np.zeros(max((r.symbol for r in rows), default=-1) + 1, np.int64)
    for r in rows:
        freq[r.symbol] = r.freq
    shared = spark.sparkContext.broadcast(freq)
    #  ids before each file, in two steps: the driver sees a sum for every RUN_FILES files, windows do the rest.
    files = blocks.groupBy("file_no").agg(F.sum("n_ids").alias("n")).withColumn("run", F.floor(F.col("file_no") / RUN_FILES))
    sums = files.groupBy("run").agg(F.sum("n").alias("n")).orderBy("run").collect()
    starts = np.cumsum([0, *(r.n for r in sums)]).tolist()
    runs = spark.createDataFrame([(r.run, at) for r, at in zip(sums, starts, strict=False)], "run long, run_start long")
    earlier = F.sum("n").over(Window.partitionBy("run").orderBy("file_no").rowsBetween(Window.unboundedPreceding, -1))
    files = files.withColumn("earlier", F.coalesce(earlier, F.lit(0))).join(F.broadcast(runs), "run")  # a row for RUN_FILES files
    files = files.select("file_no", (F.col("earlier") + F.col("run_start")).alias("file_start"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(shared.value, BITS)
        for b in batches:
            for r in b.to_pylist():
                ids = coder.decode(r).astype("<u4")
                sizes = np.array(r["doc_sizes"], np.int64)
                ends = np.cumsum(sizes)
                raw = pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(np.concatenate([[0], ends * 4]).astype(np.int32)), pa.py_buffer(ids.tobytes())])
                cols = [pa.array(r["doc_ids"], pa.int64()), pa.array(r["file_start"] + r["file_offset"] + ends - sizes), pa.array(sizes), raw]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "start", "n_tokens", "ids"])

    return blocks.join(maybe_broadcast(files), "file_no").mapInArrow(trimmed(run), "doc_id long, start long, n_tokens long, ids binary")


def round_trip(docs: DataFrame, path: str | None = None, end_id: int = 2) -> DataFrame:
    """Write ``docs`` into the shared folder and read them back."""
    folder = f"{shared_dir(docs.sparkSession)}/loomfact/token-files-{uuid.uuid4().hex}"
    write_token_files(docs, folder, path, end_id)
    return read_token_files(docs.sparkSession, folder)
