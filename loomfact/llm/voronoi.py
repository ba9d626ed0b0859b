"""Exact top-k by inner product: a Voronoi join of queries and data.

Pivots from a bounded sample divide all vectors into cells. Summaries of the cells (rows,
radius) give, for each cell of queries, a score that its k best certainly reach: the best
cells are added up by the least score that any of their vectors can have, until they hold
k rows. A data vector v goes to a cell of queries with centre c and radius R only if
c.v + R|v| reaches that score, which no query of the cell can exceed. Cells of queries are
put together into blocks of a bounded size, a hot cell is cut into several; a vector goes
once to each block that needs it. Blocks meet the data in chunks dealt by a hash, so that
no vector, however often it repeats, makes a large group; each chunk answers its block
with the best k of each query, and a window takes the best of these.

Components are floor(64 x), scores integer. Work in floating point is exact, as it is
checked that no sum exceeds 2^53; beyond that whole numbers are used. Bounds are widened
by more than the rounding of their computation.

Defined cases: vectors that are null, or hold null or non-finite components, take no part;
vectors of other lengths count as filled up with zeros; a null vec_id is no query and, as
a candidate, comes last among ties; rows that repeat are rows of their own, so another row
with the query's vec_id is a candidate; extra columns are ignored; an empty table, or one
without queries, gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import trimmed, written

SCALE = 64
#: Pivots, and rows of the sample (smallest hashes) that they come from.
PIVOTS, SAMPLE_ROWS = 96, 2048
#: Queries of a block at most, and data rows of a chunk on average.
BLOCK_QUERIES, CHUNK_ROWS = 2048, 8192
#: Rows that are worked on at once.
ROWS = 1024
#: Share by which bounds are widened.
SLACK = 1e-9
_EXACT = 1 << 53


def quantised(vectors: DataFrame) -> DataFrame:
    """rid, vec_id and v (whole numbers, floor(64 x)) of the rows that take part."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    sound = F.col("embedding").isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where(sound)
    return rows.select(F.monotonically_increasing_id().alias("rid"), "vec_id", F.transform(v, lambda x: F.floor(x * SCALE).cast("long")).alias("v"))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """The lists of a column as rows of ``width`` numbers, short ones filled up with zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    size = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if len(size) and (size == width).all():
        return flat.reshape(len(size), width)
    out = np.zeros((len(size), width), np.int64)
    row = np.repeat(np.arange(len(size)), size)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
    return out


def pivots_of(rows: DataFrame, width: int) -> np.ndarray:
    """Different sample vectors, each far from those before it; at most PIVOTS."""
    sample = rows.orderBy(F.xxhash64("rid"), "rid").limit(SAMPLE_ROWS).select("v").toArrow()
    x = np.unique(matrix(sample.column("v"), width), axis=0).astype(float)
    chosen, far = [0], ((x - x[0]) ** 2).sum(axis=1)
    while len(chosen) < min(PIVOTS, len(x)):
        chosen.append(int(far.argmax()))
        far = np.minimum(far, ((x - x[chosen[-1]]) ** 2).sum(axis=1))
    return x[chosen]


def placed(rows: DataFrame, pivots: np.ndarray, every: int) -> DataFrame:
    """``rows`` with their cell, the distance to its pivot, and whether they are queries."""
    square, width = (pivots**2).sum(axis=1), pivots.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = matrix(b.column("v"), width).astype(float)
            cell = (square - 2 * (x @ pivots.T)).argmin(axis=1)
            far = np.sqrt(((x - pivots[cell]) ** 2).sum(axis=1)) * (1 + SLACK)
            cols = [*b.columns, pa.array(cell, pa.int64()), pa.array(far)]
            yield pa.RecordBatch.from_arrays(cols, names=[*b.schema.names, "cell", "far"])

    out = rows.mapInArrow(trimmed(run), "rid long, vec_id long, v array<long>, cell long, far double")
    return out.withColumn("asks", F.coalesce(F.col("vec_id") % every == 0, F.lit(False)))


class Plan:
    """What the summaries decide: the score that each cell of queries reaches, and the blocks of cells."""

    def __init__(self, cells: list, pivots: np.ndarray, k: int):
        n = len(pivots)
        self.pivots, rows, self.radius, far, asking = pivots, np.zeros(n, np.int64), np.zeros(n), np.zeros(n), np.zeros(n, np.int64)
        for c in cells:
            rows[c.cell], asking[c.cell] = c.rows, c.asking
            self.radius[c.cell], far[c.cell] = c.asking_far or 0.0, c.far
        self.rows, self.queries = int(rows.sum()), int(asking.sum())
        size = np.sqrt((pivots**2).sum(axis=1))
        middle = pivots @ pivots.T
        spread = np.outer(size, far) + np.outer(self.radius, size) + np.outer(self.radius, far)
        least = middle - spread * (1 + SLACK) - SLACK * (1 + np.abs(middle))
        self.reached = np.full(n, -np.inf)
        for c in range(n):
            by = np.argsort(-least[c], kind="stable")
            enough = np.searchsorted(np.cumsum(rows[by]), min(k + 1, self.rows))  # the query itself may be among them
            if self.rows > k:
                self.reached[c] = least[c][by[min(enough, n - 1)]]
        #  Cells of queries in blocks; large cells have blocks of their own.
        self.first, self.parts = np.full(n, -1), np.ones(n, np.int64)
        block, held = 0, 0
        for c in np.flatnonzero(asking).tolist():
            if held and held + asking[c] > BLOCK_QUERIES:
                block, held = block + 1, 0
            self.first[c], self.parts[c] = block, -(-asking[c] // BLOCK_QUERIES)
            held += int(asking[c])
            if self.parts[c] > 1:
                block, held = block + int(self.parts[c]), 0
        self.blocks = block + 1
        self.chunks = max(1, -(-self.rows // CHUNK_ROWS))
        used = np.flatnonzero(asking)
        self.used = used
        self.of_block = [np.flatnonzero((self.first[used] <= b) & (b < self.first[used] + self.parts[used])) for b in range(self.blocks)]

    def needed(self, x: np.ndarray) -> list[np.ndarray]:
        """Rows of ``x`` that each block needs."""
        best = x @ self.pivots[self.used].T
        best += np.outer(np.sqrt((x**2).sum(axis=1)), self.radius[self.used]) * (1 + SLACK)
        best += SLACK * (1 + np.abs(best))
        reach = best >= self.reached[self.used]
        return [np.flatnonzero(reach[:, cells].any(axis=1)) for cells in self.of_block]


def dealt(rows: DataFrame, plan: Plan) -> DataFrame:
    """Data rows for each block that needs them, queries for each chunk of their block: block, chunk, asks, rid, vec_id, v."""
    width = plan.pivots.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, ROWS):
                part = b.slice(at, ROWS)
                for block, own in enumerate(plan.needed(matrix(part.column("v"), width).astype(float))):
                    if len(own):
                        t = part.take(pa.array(own))
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), block)), *t.columns], names=["block", *t.schema.names])

    data = rows.select("rid", "vec_id", "v").mapInArrow(trimmed(run), "block long, rid long, vec_id long, v array<long>")
    data = data.select("block", F.pmod(F.xxhash64("rid"), F.lit(plan.chunks)).alias("chunk"), F.lit(False).alias("asks"), "rid", "vec_id", "v")
    first = F.array(*[F.lit(int(x)) for x in plan.first])[F.col("cell").cast("int")]
    parts = F.array(*[F.lit(int(x)) for x in plan.parts])[F.col("cell").cast("int")]
    block = (first + F.pmod(F.xxhash64("rid", F.lit(1)), parts)).cast("long")
    asking = rows.where("asks").select(block.alias("block"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(plan.chunks - 1).cast("long"))).alias("chunk"), "asks", "rid", "vec_id", "v")
    return data.unionByName(asking)


def best_of(queries: np.ndarray, data: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row of data, score) of the k highest scores of each query, ties to earlier rows; ``own`` is the query's own row or -1."""
    n = len(data)
    most = int(np.abs(queries).max(initial=0)) * int(np.abs(data).max(initial=0)) * max(1, data.shape[1])
    exact = most * n < _EXACT // 4
    left, right = (queries.astype(float), data.T.astype(float)) if exact else (queries.astype(object), data.T.astype(object))
    found = []
    for at in range(0, len(queries), ROWS // 4):
        score = left[at : at + ROWS // 4] @ right
        mine = own[at : at + ROWS // 4]
        #  One number orders a query's rows: the score, then the place.
        key = score * n - np.arange(n)
        row = np.flatnonzero(mine >= 0)
        key[row, mine[row]] = -float("inf")
        if n > k:
            top = np.argpartition(-key, k - 1, axis=1)[:, :k] if exact else np.argsort(-key, axis=1, kind="stable")[:, :k]
        else:
            top = np.broadcast_to(np.arange(n), (len(score), n))
        q = np.repeat(np.arange(len(score)), top.shape[1])
        d = top.ravel()
        keep = d != mine[q]
        found.append((q[keep] + at, d[keep], score[q[keep], d[keep]].astype(np.int64)))
    q, d, s = (np.concatenate(x) for x in zip(*found, strict=True))
    return q, d, s


def top_k(vectors: DataFrame, k: int = 20, every: int = 20) -> DataFrame:
    """query_id, rank (from 1), vec_id and score of the k best rows of each query.

    Queries are the rows of ``vectors`` (vec_id, embedding) whose vec_id is divisible by
    ``every``; candidates are all rows but the query's own, ties go to the smaller vec_id.
    """
    empty = vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    rows = written(quantised(vectors), "quantised")
    width = rows.agg(F.max(F.size("v"))).first()[0]
    if not width:
        if width is None:
            return empty
        rows, width = rows.withColumn("v", F.array(F.lit(0).cast("long"))), 1
    pivots = pivots_of(rows, width)
    rows = written(placed(rows, pivots, every), "cells")
    summary = rows.groupBy("cell").agg(
        F.count(F.lit(1)).alias("rows"), F.max("far").alias("far"), F.count_if("asks").alias("asking"), F.max(F.when(F.col("asks"), F.col("far"))).alias("asking_far")
    )
    plan = Plan(summary.collect(), pivots, k)  # one row for each pivot
    if not plan.queries:
        return empty

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by([("vec_id", "ascending"), ("rid", "ascending")])  # nulls last
        asks = t.column("asks").to_numpy()
        x, rid = matrix(t.column("v"), width), t.column("rid").to_numpy()
        of, to = np.flatnonzero(asks), np.flatnonzero(~asks)
        if not len(of) or not len(to):
            q = d = s = np.zeros(0, np.int64)
        else:
            by = np.argsort(rid[to])
            at = np.minimum(np.searchsorted(rid[to], rid[of], sorter=by), len(to) - 1)
            own = np.where(rid[to][by[at]] == rid[of], by[at], -1)
            q, d, s = best_of(x[of], x[to], own, k)
        mine, other = t.take(pa.array(of[q])), t.take(pa.array(to[d]))
        cols = [mine.column("rid"), mine.column("vec_id"), other.column("vec_id"), other.column("rid"), pa.array(s, pa.int64())]
        return pa.Table.from_arrays(cols, names=["query", "query_id", "vec_id", "rid", "score"])

    found = dealt(rows, plan).groupBy("block", "chunk").applyInArrow(run, "query long, query_id long, vec_id long, rid long, score long")
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "rid")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
