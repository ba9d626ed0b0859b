"""Exact deduplication by composable polynomial fingerprints.

A text is normalised (each run of ASCII white space becomes one space; null is
the empty text) and hashed as a polynomial in ``BASE`` modulo two primes. Chunks
are hashed on their own and combined by ``H(ab) = H(a) * BASE**len(b) + H(b)``,
so the pieces of a huge document can be hashed anywhere, in any grouping. Only
texts that share length and fingerprint are then compared, chunk by chunk; the
comparison is an aggregation whose map side already collapses equal chunks, so
a group of copies of any size meets as one row per chunk and task.

Defined cases: null text counts as empty; an empty table gives an empty result;
rows with a null doc_id take part and lose against any row with an id; of rows
that repeat doc_id and text one stays; extra columns are ignored by
:func:`exact_groups` and kept by :func:`deduplicate`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ASCII_SPACE, maybe_broadcast, trimmed, written

PRIMES = (2147483647, 2147483629)
BASE = 1_000_003
#: Bytes of a chunk; CHUNK * 255 * 2**31 stays exact in a double.
CHUNK = 4096
#: Bytes of a piece in the comparison of equal fingerprints.
COMPARE_BYTES = 65536


def _powers(prime: int) -> np.ndarray:
    out, x = np.empty(CHUNK), 1
    for i in range(CHUNK - 1, -1, -1):
        out[i] = x
        x = x * BASE % prime
    return out


def combine(left: int, right: int, right_len: int, prime: int) -> int:
    """Fingerprint of two adjoining texts from theirs."""
    return (left * pow(BASE, right_len, prime) + right) % prime


class Fingerprinter:
    """Polynomial fingerprints of byte strings modulo each of ``primes``."""

    def __init__(self, primes: tuple[int, ...] = PRIMES):
        self.primes = primes
        self.powers = np.stack([_powers(p) for p in primes], axis=1)
        self.step = [pow(BASE, CHUNK, p) for p in primes]

    def chunks(self, data: np.ndarray) -> np.ndarray:
        """Hash of each full chunk of ``data``, one row a chunk."""
        n = len(data) // CHUNK
        sums = data[: n * CHUNK].reshape(n, CHUNK).astype(np.float64) @ self.powers
        return np.mod(sums, np.array(self.primes, dtype=np.float64)).astype(np.int64)

    def __call__(self, data: np.ndarray) -> list[int]:
        full = self.chunks(data) if len(data) >= CHUNK else np.empty((0, len(self.primes)), np.int64)
        rest = data[len(full) * CHUNK :]
        tail = rest.astype(np.float64) @ self.powers[CHUNK - len(rest) :]
        out = []
        for k, prime in enumerate(self.primes):
            h = 0
            for c in full[:, k].tolist():
                h = (h * self.step[k] + c) % prime
            out.append(combine(h, int(tail[k] % prime), len(rest), prime))
        return out


def _normal(text):
    return F.regexp_replace(F.coalesce(text, F.lit("")), ASCII_SPACE, " ")


def _hashed(batch: pa.RecordBatch, make: Fingerprinter) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The batch's texts as bytes, their offsets and their fingerprints."""
    text = batch.column("norm").cast(pa.large_binary())
    at = np.frombuffer(text.buffers()[1], np.int64, len(batch) + 1, text.offset * 8)
    raw = text.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.empty(0, np.uint8)
    got = [make(data[s:e]) for s, e in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
    return text, at, np.array(got, np.int64).reshape(len(batch), len(make.primes))


def fingerprints(docs: DataFrame, primes: tuple[int, int] = PRIMES) -> DataFrame:
    """doc_id, text_sha256, n_bytes, f1 and f2 of every row's normalised text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = Fingerprinter(primes)
        for b in batches:
            _, at, f = _hashed(b, make)
            cols = [b.column("doc_id"), b.column("text_sha256"), pa.array(np.diff(at)), pa.array(f[:, 0]), pa.array(f[:, 1])]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "text_sha256", "n_bytes", "f1", "f2"])

    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _normal(F.col("text")).alias("norm"))
    base = base.withColumn("text_sha256", F.sha2(F.col("norm").cast("binary"), 256))
    return base.mapInArrow(trimmed(run), "doc_id long, text_sha256 string, n_bytes long, f1 long, f2 long")


def chunk_rows(docs: DataFrame, primes: tuple[int, int] = PRIMES) -> DataFrame:
    """Every row's normalised text in pieces of COMPARE_BYTES, under its fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = Fingerprinter(primes)
        for b in batches:
            text, at, f = _hashed(b, make)
            size = np.diff(at)
            pieces = np.maximum(1, -(-size // COMPARE_BYTES))
            row = np.repeat(np.arange(len(b)), pieces)
            k = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            cuts = np.append(at[:-1][row] + k * COMPARE_BYTES, at[-1])
            whole = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(row), [None, pa.py_buffer(cuts), text.buffers()[2]])
            cols = [pa.array(size[row]), pa.array(f[row, 0]), pa.array(f[row, 1]), pa.array(k), whole.cast(pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names=["n_bytes", "f1", "f2", "piece", "chunk"])

    base = docs.select(_normal(F.col("text")).alias("norm"))
    return base.mapInArrow(trimmed(run), "n_bytes long, f1 long, f2 long, piece long, chunk binary")


def exact_groups(docs: DataFrame, primes: tuple[int, int] = PRIMES) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256."""
    key = ["n_bytes", "f1", "f2"]
    rows = written(fingerprints(docs, primes).withColumn("rid", F.monotonically_increasing_id()), "fingerprints")
    order = F.struct(F.col("doc_id").isNull().alias("last"), F.col("doc_id").alias("id"), F.col("rid"))
    groups = rows.groupBy(*key).agg(F.min(order).alias("first"), F.count("*").alias("size"))
    groups = written(groups.where("size > 1"), "groups")
    #  Equal fingerprints: the texts are compared piece by piece.
    pieces = chunk_rows(docs, primes).join(maybe_broadcast(groups.select(*key)), key, "left_semi")
    uneven = pieces.distinct().groupBy(*key, "piece").count().where("count > 1")
    uneven = written(uneven.select(*key).distinct(), "collisions")
    joined = rows.join(groups, key, "left")
    size, first = F.coalesce("size", F.lit(1)), F.coalesce("first", order)
    if uneven.limit(1).count():
        #  Different texts under one fingerprint: those groups split by the texts' hashes.
        by_text = [*key, "text_sha256"]
        clash = rows.join(maybe_broadcast(uneven), key, "left_semi")
        split = clash.groupBy(*by_text).agg(F.min(order).alias("own_first"), F.count("*").alias("own_size"))
        joined = joined.join(split, by_text, "left")
        size, first = F.coalesce("own_size", size), F.coalesce("own_first", first)
    return joined.select(
        "doc_id",
        first["id"].alias("keep_id"),
        size.cast("long").alias("group_size"),
        (first["rid"] == F.col("rid")).alias("kept"),
        "text_sha256",
    )


def deduplicate(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.

    A row is recognised by doc_id and the hash of its normalised text; should both
    repeat, one of those equal rows is kept.
    """
    groups = exact_groups(docs)
    gone = groups.where(~F.col("kept")).select(F.col("doc_id").alias("__lf_id"), F.col("text_sha256").alias("__lf_sha"))
    stay = groups.where("kept").select(F.col("doc_id").alias("__lf_id"), F.col("text_sha256").alias("__lf_sha"))
    gone = written(gone.groupBy("__lf_id", "__lf_sha").count(), "copies")
    twice = written(gone.join(stay, ["__lf_id", "__lf_sha"], "left_semi"), "twice")
    if not gone.limit(1).count():
        return docs
    hashed = docs.withColumn("__lf_sha", F.sha2(_normal(F.col("text")).cast("binary"), 256))
    same = (F.col("doc_id").cast("long").eqNullSafe(F.col("gone.__lf_id"))) & (F.col("d.__lf_sha") == F.col("gone.__lf_sha"))
    rest = hashed.alias("d").join(maybe_broadcast(gone).alias("gone"), same, "left_anti")
    if twice.limit(1).count():
        same = (F.col("doc_id").cast("long").eqNullSafe(F.col("t.__lf_id"))) & (F.col("d.__lf_sha") == F.col("t.__lf_sha"))
        one = hashed.alias("d").join(maybe_broadcast(twice).alias("t"), same, "left_semi").dropDuplicates(["doc_id", "__lf_sha"])
        rest = rest.unionByName(one)
    return rest.drop("__lf_sha")
