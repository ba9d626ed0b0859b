"""Packing of tokenised documents into fixed windows by multiway differencing.

A document's ids (its end id included) are cut into pieces of a whole window and
a shorter tail. Whole pieces fill windows of their own. A tail is cut into even
parts, the last of which gives two small ones, as sets of few large parts cannot be
balanced. The parts are dealt into groups of bounded size, and each group is split
into near-equal windows by the Karmarkar-Karp differencing method: every part starts
as a partial partition, the two partial partitions with the largest imbalance are
merged with the heaviest window of one on the lightest of the other, until one is
left. Where a window exceeds the capacity, the group's number of windows rises by one.

Defined cases: a null or empty text is the end id alone; a null doc_id is carried
along; rows that repeat are packed each on its own; an empty table gives no pieces.
"""

from __future__ import annotations

import heapq
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache
from operator import neg

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import trimmed, written
from .tokens import tokenizer, vocabulary

CAPACITY = 2048
#: Parts of tails that one group of differencing holds on average.
GROUP_PARTS = 3600
#: Bytes of text that are tokenised in one go.
SLICE_BYTES = 2 << 20
#: Whole pieces' window numbers start here; groups' numbers stay below.
WHOLE_FROM = 1 << 62


def slices(texts: pa.Array) -> Iterator[tuple[int, pa.Array]]:
    """Runs of the array's texts of about SLICE_BYTES each, with their first positions."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy().astype(np.int64)
    cut = np.flatnonzero(np.diff(np.cumsum(sizes) // SLICE_BYTES)) + 1
    for a, b in zip([0, *cut.tolist()], [*cut.tolist(), len(texts)], strict=True):
        if b > a:
            yield a, texts.slice(a, b - a)


@lru_cache(maxsize=8192)
def tail_cuts(tail: int, capacity: int) -> list[int]:
    """Lengths of the parts of a tail."""
    parts = -(-tail * 3 // capacity)
    even = [tail // parts + (i < tail % parts) for i in range(parts)]
    small = even[-1] // 4 if even else 0
    least = small // 4
    return [x for x in (*even[:-1], (even or [0])[-1] - small, small - least, least) if x]


def cut_pieces(docs: DataFrame, path: str, end_id: int, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, start, length, doc_tokens and ids (little-endian unsigned 32-bit) of each piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lib = tokenizer(path)
        for b in batches:
            for at, texts in slices(b.column("text")):
                flat, size = lib.encode(texts)
                flat, size = np.insert(flat, np.cumsum(size), end_id), size + 1
                lengths = [[capacity] * (n // capacity) + tail_cuts(n % capacity, capacity) for n in size.tolist()]
                row = np.repeat(np.arange(len(size)), [len(x) for x in lengths])
                length = np.array([y for x in lengths for y in x], np.int64)
                ends = np.cumsum(length)
                start = ends - length - (np.cumsum(size) - size)[row]
                cuts = np.concatenate([[0], ends * 4]).astype(np.int32)
                own = pa.Array.from_buffers(pa.binary(), len(row), [None, pa.py_buffer(cuts), pa.py_buffer(flat)])
                cols = [b.column("doc_id").slice(at, len(size)).take(pa.array(row)), pa.array(start), pa.array(length), pa.array(size[row]), own]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "start", "length", "doc_tokens", "ids"])

    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return base.mapInArrow(trimmed(run), "doc_id long, start long, length long, doc_tokens long, ids binary")


def differencing(sizes: list[int], windows: int) -> list[list[int]]:
    """Positions of ``sizes`` in each of ``windows`` near-equal sets.

    A partial partition lists its sums from the heaviest, without those that are zero, so
    two of them that fill no more than all windows together only interleave.
    """
    n = len(sizes)
    left, right = [-1] * n, [-1] * n  # sets are trees: a leaf is a position, an inner node joins two

    def spread(sums: list[int]) -> int:
        return sums[0] - (sums[-1] if len(sums) == windows else 0)

    heap = [(-spread([s]), i, [s], [i]) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    order = n
    while len(heap) > 1:
        _, _, a, a_sets = heapq.heappop(heap)
        _, _, b, b_sets = heap[0]
        if len(a) + len(b) <= windows and len(b) == 1:
            at = len(a) if b[0] <= a[-1] else bisect_right(a, -b[0], key=neg)
            a.insert(at, b[0])
            a_sets.insert(at, b_sets[0])
            sums, sets = a, a_sets
        elif len(a) + len(b) <= windows:
            both = sorted(zip(a + b, a_sets + b_sets, strict=True), reverse=True)
            sums, sets = [x for x, _ in both], [x for _, x in both]
        else:
            sums, sets = _opposed(a, a_sets, b, b_sets, windows, left, right)
        heapq.heapreplace(heap, (-spread(sums), order, sums, sets))
        order += 1
    out: list[list[int]] = []
    for top in heap[0][3] if heap else []:
        got, todo = [], [top]
        while todo:
            x = todo.pop()
            if x < n:
                got.append(x)
            else:
                todo += [left[x], right[x]]
        out.append(sorted(got))
    return [x for x in out if x]


def _opposed(a: list[int], a_sets: list[int], b: list[int], b_sets: list[int], windows: int, left: list[int], right: list[int]) -> tuple[list[int], list[int]]:
    """The heaviest windows of one partition on the lightest of the other; sets that meet become inner nodes."""
    x, x_sets, y, y_sets = np.zeros(windows, np.int64), np.full(windows, -1, np.int64), np.zeros(windows, np.int64), np.full(windows, -1, np.int64)
    x[: len(a)], x_sets[: len(a)] = a, a_sets
    y[windows - len(b) :], y_sets[windows - len(b) :] = b[::-1], b_sets[::-1]
    both = np.flatnonzero((x_sets >= 0) & (y_sets >= 0))
    sets = np.where(x_sets < 0, y_sets, x_sets)
    sets[both] = np.arange(len(left), len(left) + len(both))
    left += x_sets[both].tolist()
    right += y_sets[both].tolist()
    by = np.argsort(-(x + y), kind="stable")
    return (x + y)[by].tolist(), sets[by].tolist()


def near_equal_windows(sizes: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    """Differencing into the fewest windows, one more as long as any exceeds ``capacity``."""
    windows = max(1, -(-sum(sizes) // capacity))
    while True:
        got = differencing(sizes, windows)
        if all(sum(sizes[i] for i in w) <= capacity for w in got):
            return got
        windows += 1


def pack(docs: DataFrame, path: str | None = None, end_id: int = 1, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of all documents with their windows: doc_id, start, length, doc_tokens, sequence_id, offset, ids."""
    pieces = written(cut_pieces(docs, path or vocabulary(), end_id, capacity).withColumn("rid", F.monotonically_increasing_id()), "pieces")
    names = ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"]
    whole = pieces.where(F.col("length") == capacity).withColumn("offset", F.lit(0).cast("long"))
    whole = whole.withColumn("sequence_id", F.lit(WHOLE_FROM) + F.col("rid")).select(*names)
    tails = pieces.where(F.col("length") < capacity)
    groups = max(1, -(-tails.count() // GROUP_PARTS))

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("rid")
        sizes = t.column("length").to_pylist()
        windows = near_equal_windows(sizes, capacity)
        order = np.array([i for w in windows for i in w], np.int64)
        number = np.repeat(np.arange(len(windows)), [len(w) for w in windows])
        offset = np.concatenate([np.cumsum([0, *(sizes[i] for i in w[:-1])]) for w in windows])
        t = t.take(pa.array(order))
        sequence = t.column("grp").to_numpy() * (1 << 32) + number
        cols = [*(t.column(c) for c in names[:4]), pa.array(sequence, pa.int64()), pa.array(offset, pa.int64()), t.column("ids")]
        return pa.Table.from_arrays(cols, names=names)

    dealt = tails.withColumn("grp", F.pmod(F.xxhash64("rid"), F.lit(groups)))
    schema = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"
    return whole.unionByName(dealt.groupBy("grp").applyInArrow(run, schema))
