"""Near-duplicate vectors of equal label: exact cosine threshold pairs by cover trees.

Equal vectors of a label are one row with a weight. Labels with more rows than a block
are cut into cells around pivots, the top level of their cover tree: a net over a bounded
sample with halving radii. Small cells share a block, large ones are cut by hash into
several. A row's sketch (its coordinates along some directions and the length of the
rest, from which no cosine comes out too small) goes to the blocks that have a cell whose
ball, widened by the threshold, it reaches, many blocks at a time; the row itself goes
only to the blocks where sketches leave a row that may be linked with it. The driver
knows cells and blocks, never pairs of them. Every task holds two blocks at most, builds
their cover trees and traverses them together; it returns a count and one edge for each
row, so nothing is ever as large as the pairs.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components,
and rows with a null label, link with nothing; repeated vectors link with each other;
vectors of different length never link; an empty table gives no rows; extra columns
are ignored. Repeated ids name one component. vec_id null: the row keeps a null
component unless a link names one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import maybe_broadcast, written
from .components import connected_components
from .covertree import COLUMNS, ROWS, SLACK, Linker, distances

COSINE = 0.93
#: Rows of a block; a task holds two blocks.
BLOCK_ROWS = 16_384
#: Pivots of all large labels together (each has one at least), and rows of the sample that they are chosen from.
PIVOTS = 4096
SAMPLE_ROWS = 16_384
#: Rows whose distances to the pivots are held at once.
AT_ONCE = 1024
#: Rows that a task holds sketches of, twice at most, and their directions.
SKETCH_ROWS, DIRECTIONS = 131_072, 32
#: Slack of a product of sketches of length one in half precision: both are off by at most 2**-11 of their length.
HALF = 1.1e-3


def valid_vectors(vectors: DataFrame) -> DataFrame:
    """vec_id, label and embedding (doubles) of the rows that can link."""
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    good = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    some = F.exists("embedding", lambda x: x != 0)
    return rows.where(F.col("label").isNotNull() & F.col("embedding").isNotNull() & good & some)


def _unit(embedding: pa.Array) -> np.ndarray:
    flat = embedding.flatten().to_numpy(zero_copy_only=False).reshape(len(embedding), -1)
    flat = flat / np.abs(flat).max(axis=1, keepdims=True)
    return flat / np.linalg.norm(flat, axis=1, keepdims=True)


def net(x: np.ndarray, most: int) -> np.ndarray:
    """Positions of pivots: centres of the finest level of halving radii with at most ``most`` centres."""
    best = np.zeros(1, np.int64)
    radius = 1.0
    while True:
        left, centres = np.arange(len(x)), []
        while len(left) and len(centres) <= most:
            centres.append(left[0])
            left = left[distances(x[left], x[left[0]]) > radius]
        if len(left) or radius < 1e-6:
            break
        best, radius = np.array(centres), radius / 2
    if len(best) < most // 2:  # the next level has too many: fill up from it
        best = np.array(list(dict.fromkeys([*best.tolist(), *np.array(centres).tolist()]))[:most])
    return best


def _groups(rows: DataFrame) -> DataFrame:
    """One row for each different vector of a label: its key, smallest vec_id and weight."""
    same = rows.groupBy("label", "embedding").agg(F.min("vec_id").alias("least"), F.count("*").alias("weight"))
    return same.withColumn("key", F.monotonically_increasing_id())


def linked(vectors: DataFrame, cosine: float = COSINE, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One row per row of ``vectors``: vec_id, n_links, component_id and kept."""
    rows = valid_vectors(vectors)
    nodes = written(_groups(rows).withColumn("part", F.concat_ws("/", F.col("label").cast("string"), F.size("embedding").cast("string"))), "vectors")
    pivots, bases = _pivots(nodes, block_rows)
    shared = vectors.sparkSession.sparkContext.broadcast(pivots)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each row's nearest pivot and its distance; -1 for labels without pivots."""
        for b in batches:
            cell, far = np.full(len(b), -1, np.int64), np.zeros(len(b))
            for part, at in _by_part(b.column("part")):
                if part in shared.value:
                    for some in np.array_split(at, -(-len(at) // AT_ONCE)):
                        d = distances(_unit(b.column("embedding").take(pa.array(some))), shared.value[part])
                        cell[some], far[some] = d.argmin(axis=1), d.min(axis=1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell), pa.array(far)], names=[*b.schema.names, "cell", "far"])

    kind = "part string, key long, least long, weight long, embedding array<double>"
    placed = nodes.select("part", "key", "least", "weight", "embedding").mapInArrow(assign, kind + ", cell long, far double")
    return _finish(vectors, nodes, _links(written(placed, "cells"), pivots, bases, cosine, block_rows))


def _by_part(parts: pa.Array) -> Iterator[tuple[str, np.ndarray]]:
    """Each part and the places of its rows."""
    codes = parts.dictionary_encode()
    idx, names = codes.indices.to_numpy(), codes.dictionary.to_pylist()
    order = np.argsort(idx, kind="stable")
    for name, at in zip(names, np.split(order, np.cumsum(np.bincount(idx, minlength=len(names)))[:-1]), strict=True):
        yield name, at


def _pivots(nodes: DataFrame, block_rows: int) -> tuple[dict[str, np.ndarray], dict[int, np.ndarray]]:
    """Pivots of the labels of over ``block_rows`` rows, nets over one bounded sample of them all, and the sample's main directions for each size."""
    large = written(nodes.groupBy("part").agg(F.count("*").alias("n")).where(F.col("n") > block_rows), "large")
    total = large.agg(F.sum("n")).first()[0]
    if not total:
        return {}, {}
    cut = max(1, int(min(1.0, 2.0 * SAMPLE_ROWS / total) * (1 << 20)))
    own = nodes.join(maybe_broadcast(large), "part").where(F.pmod(F.xxhash64("embedding"), F.lit(1 << 20)) < cut)
    sample = own.orderBy(F.xxhash64("embedding"), "key").limit(2 * SAMPLE_ROWS).select("part", "n", "embedding").toArrow().combine_chunks()
    out: dict[str, np.ndarray] = {}
    moments: dict[int, np.ndarray] = {}
    if len(sample):
        embedding, n = sample.column("embedding").combine_chunks(), sample.column("n").to_numpy()
        for part, at in _by_part(sample.column("part").combine_chunks()):
            rows = int(n[at[0]])
            x = _unit(embedding.take(pa.array(at)))
            out[part] = x[net(x, min(max(1, PIVOTS * rows // total), -(-4 * rows // block_rows)))]
            moments[x.shape[1]] = moments.get(x.shape[1], 0.0) + x.T @ x
    return out, {size: np.linalg.eigh(m)[1][:, ::-1][:, :DIRECTIONS] for size, m in moments.items()}


def sketch(x: np.ndarray, base: np.ndarray | None) -> np.ndarray:
    """Coordinates along an orthonormal base (the first ones if None) and the length of the rest: products are no less than the vectors' own, but for ``HALF``."""
    along = x[:, :DIRECTIONS] if base is None else x @ base
    rest = np.sqrt(np.maximum(1.0 - (along * along).sum(axis=1, keepdims=True), 0.0))
    return np.concatenate([along, rest], axis=1).astype(np.float16)


def near_blocks(left: np.ndarray, left_block: np.ndarray, right: np.ndarray, right_block: np.ndarray, least: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """For each row of either side, which blocks of the other hold a row whose sketch's product with its own is ``least`` or more.

    Blocks are numbers from 0; with ``same`` both sides are the same rows, and no row counts for itself.
    """
    a, b = np.zeros((len(left), right_block.max() + 1), bool), np.zeros((len(right), left_block.max() + 1), bool)
    left, right, least = left.astype(np.float32), right.astype(np.float32), np.float32(least)
    for at in range(0, len(left), ROWS):
        for to in range(at if same else 0, len(right), COLUMNS):
            product = left[at : at + ROWS] @ right[to : to + COLUMNS].T
            if product.max() < least:
                continue
            i, j = np.divmod(np.flatnonzero(product >= least), product.shape[1])
            i, j = i + at, j + to
            if same:
                once = i < j
                i, j = i[once], j[once]
            a[i, right_block[j]] = True
            b[j, left_block[i]] = True
    return a, b


class Layout:
    """The blocks of a label: small cells together, a large cell in several; ``holds`` tells which cells have rows in which blocks."""

    def __init__(self, n: np.ndarray, radius: np.ndarray, block_rows: int):
        self.radius = radius
        self.first, self.cuts = np.zeros(len(n), np.int64), np.maximum(1, -(-n // block_rows))
        block, room, last = -1, 0, False
        for cell in range(len(n)):
            if self.cuts[cell] > 1 or n[cell] > room or not last:
                block, room = block + 1, block_rows
            self.first[cell], last = block, self.cuts[cell] == 1
            room -= int(n[cell])
            block += int(self.cuts[cell]) - 1
        self.holds = np.zeros((len(n), block + 1), np.float32)
        for cell in range(len(n)):
            self.holds[cell, self.first[cell] : self.first[cell] + self.cuts[cell]] = 1


def _links(placed: DataFrame, pivots: dict[str, np.ndarray], bases: dict[int, np.ndarray], cosine: float, block_rows: int) -> DataFrame:
    """key, n_links and root of rows with links: sums and one edge for each task."""
    spark = placed.sparkSession
    stats = written(placed.groupBy("part", "cell").agg(F.count("*").alias("n"), F.max("far").alias("far")), "cell-sizes")
    known: dict[str, tuple[np.ndarray, np.ndarray]] = {p: (np.zeros(len(c), np.int64), np.zeros(len(c))) for p, c in pivots.items()}
    for r in stats.where("cell >= 0").collect():  # as many as there are pivots
        known[r["part"]][0][r["cell"]], known[r["part"]][1][r["cell"]] = r["n"], r["far"]
    shared = spark.sparkContext.broadcast(({p: Layout(n, far, block_rows) for p, (n, far) in known.items()}, pivots, bases))
    reach = float(np.sqrt(2 - 2 * cosine))
    wide = max(1, SKETCH_ROWS // block_rows)
    #  A label without pivots is one cell, cut by hash into as many blocks as its rows ask for.
    cuts = stats.where((F.col("cell") < 0) & (F.col("n") > block_rows)).select("part", F.ceil(F.col("n") / block_rows).alias("cuts"))
    ready = placed.join(maybe_broadcast(cuts), "part", "left").select("part", "key", "weight", "embedding", "cell", F.coalesce("cuts", F.lit(1)).cast("long").alias("cuts"))

    def own_blocks(part: str, keys: np.ndarray, cell: np.ndarray, cuts: np.ndarray) -> np.ndarray:
        mix = (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
        if part not in shared.value[0]:
            return (mix % cuts.astype(np.uint64)).astype(np.int64)
        own = shared.value[0][part]
        return own.first[cell] + (mix % own.cuts[cell].astype(np.uint64)).astype(np.int64)

    def reached(part: str, x: np.ndarray, cuts: np.ndarray) -> np.ndarray:
        """For each row and block whether a linked row may lie there."""
        layouts, pivots, _ = shared.value
        if part not in layouts:
            return np.ones((len(x), int(cuts[0])), bool)
        own = layouts[part]
        near = distances(x, pivots[part]) <= own.radius + reach + SLACK
        return near.astype(np.float32) @ own.holds > 0

    def tasks(part: str, mine: np.ndarray, other: np.ndarray) -> tuple[pa.Array, pa.Array]:
        """Names of the tasks for pairs of blocks, and each row's side there: 2 if both are one."""
        side = np.where(mine == other, 2, (mine > other).astype(np.int64)).astype(np.int32)
        names = [f"{part}|{x}|{y}" for x, y in zip(np.minimum(mine, other).tolist(), np.maximum(mine, other).tolist(), strict=True)]
        return pa.array(names, pa.string()), pa.array(side)

    def deal_sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A sketch of each row of a label of several blocks for each task that needs it; a task is a pair of runs of ``wide`` blocks, or one."""
        for b in batches:
            keys, cell, cuts = (b.column(c).to_numpy() for c in ("key", "cell", "cuts"))
            for part, every in _by_part(b.column("part")):
                if part not in shared.value[0] and cuts[every[0]] == 1:
                    continue
                for at in np.array_split(every, -(-len(every) // AT_ONCE)):
                    x = _unit(b.column("embedding").take(pa.array(at)))
                    own, runs = own_blocks(part, keys[at], cell[at], cuts[at]), reached(part, x, cuts[at])
                    runs = np.logical_or.reduceat(runs, np.arange(0, runs.shape[1], wide), axis=1)
                    runs[np.arange(len(at)), own // wide] = True
                    i, other = np.nonzero(runs)
                    rows = pa.array([r.tobytes() for r in sketch(x, shared.value[2].get(x.shape[1]))], pa.binary()).take(pa.array(i))
                    yield pa.RecordBatch.from_arrays([*tasks(part, own[i] // wide, other), pa.array(keys[at][i]), pa.array(own[i]), rows], names=["task", "side", "key", "block", "sketch"])

    def compare(t: pa.Table) -> pa.Table:
        keys, side, block = (t.column(c).to_numpy() for c in ("key", "side", "block"))
        x = np.frombuffer(b"".join(t.column("sketch").to_pylist()), np.float16).reshape(len(keys), -1)
        left, right = (np.flatnonzero(side != 1), np.flatnonzero(side != 0))
        if not len(left) or not len(right):
            return pa.table({"key": keys[:0], "block": block[:0]})
        (names_l, lb), (names_r, rb) = np.unique(block[left], return_inverse=True), np.unique(block[right], return_inverse=True)
        a, b = near_blocks(x[left], lb, x[right], rb, cosine - HALF, bool(side[0] == 2))
        (i, at), (j, to) = np.nonzero(a), np.nonzero(b)
        return pa.table({"key": np.concatenate([keys[left[i]], keys[right[j]]]), "block": np.concatenate([names_r[at], names_l[to]])})

    several = stats.groupBy("part").agg(F.sum("n").alias("n")).where(F.col("n") > block_rows).limit(1).count() > 0
    if several:
        sketches = ready.mapInArrow(deal_sketches, "task string, side int, key long, block long, sketch binary")
        near = written(sketches.groupBy("task").applyInArrow(compare, "key long, block long"), "near-blocks")
        near = written(near.groupBy("key").agg(F.collect_set("block").alias("near")), "row-blocks")
        ready = ready.join(maybe_broadcast(near), "key", "left")
    else:
        ready = ready.withColumn("near", F.lit(None).cast("array<bigint>"))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A copy of each row for each task that needs it; a task is a block or a pair of blocks."""
        for b in batches:
            keys, cell, cuts = (b.column(c).to_numpy() for c in ("key", "cell", "cuts"))
            near = b.column("near")
            n = near.value_lengths().fill_null(0).to_numpy()
            other, first = near.flatten().to_numpy(), np.cumsum(n) - n
            for part, at in _by_part(b.column("part")):
                if part not in shared.value[0] and cuts[at[0]] == 1:  # the label is one block
                    i, blocks = at, np.zeros(len(at), np.int64)
                else:
                    i = np.repeat(at, n[at])
                    blocks = other[np.repeat(first[at], n[at]) + np.arange(len(i)) - np.repeat(np.cumsum(n[at]) - n[at], n[at])]
                own = own_blocks(part, keys[i], cell[i], cuts[i])
                for some in np.array_split(np.arange(len(i)), -(-len(i) // AT_ONCE) or 1):
                    take = b.select(["key", "weight", "embedding"]).take(pa.array(i[some]))
                    yield pa.RecordBatch.from_arrays([*tasks(part, own[some], blocks[some]), *take.columns], names=["task", "side", "key", "weight", "embedding"])

    def solve(t: pa.Table) -> pa.Table:
        t = t.sort_by("key")
        keys, side = t.column("key").to_numpy(), t.column("side").to_numpy()
        x = _unit(t.column("embedding").combine_chunks())
        linker = Linker(x, t.column("weight").to_numpy(), cosine)
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        if (side == 2).any():
            linker.within(linker.tree(np.arange(len(x))))
        elif len(left) and len(right):
            linker.between(linker.tree(left), linker.tree(right))
        hit = np.flatnonzero(linker.links)
        root = linker.roots(hit)
        return pa.table({"key": keys[hit], "n_links": linker.links[hit], "root": keys[root]})

    dealt = ready.mapInArrow(deal, "task string, side int, key long, weight long, embedding array<double>")
    return written(dealt.groupBy("task").applyInArrow(solve, "key long, n_links long, root long"), "vector-links")


def _finish(vectors: DataFrame, nodes: DataFrame, links: DataFrame) -> DataFrame:
    sums = links.groupBy("key").agg(F.sum("n_links").alias("n_links"))
    groups = connected_components(links.select(F.col("key").alias("a"), F.col("root").alias("b")))
    named = groups.join(nodes.select(F.col("key").alias("node"), "least"), "node")
    names = named.groupBy("component").agg(F.min("least").alias("named"))
    by_node = groups.join(names, "component").select(F.col("node").alias("key"), "named")
    known = nodes.join(sums, "key", "left").join(by_node, "key", "left")
    known = known.select(
        F.col("label").alias("k_label"),
        F.col("embedding").alias("k_embedding"),
        (F.coalesce("n_links", F.lit(0)) + F.col("weight") - 1).alias("n_links"),
        F.coalesce("named", "least").alias("component_id"),
    )
    every = vectors.select(F.col("vec_id").cast("long"), F.col("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    out = every.join(known, (F.col("label") == F.col("k_label")) & (F.col("embedding") == F.col("k_embedding")), "left")
    component = F.when(F.col("n_links") > 0, F.col("component_id")).otherwise(F.col("vec_id"))
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
