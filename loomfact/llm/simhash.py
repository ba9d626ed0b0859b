"""Near-duplicates by SimHash fingerprints, found with Golay-code fuzzy hashing.

A fingerprint has 64 bits over the XXH64 hashes of a text's word shingles. Two
fingerprints link if they differ in at most two bits. Candidates come from keys that
linked fingerprints must share: the 64 bits are three segments, and of two errors at
least one segment is free (pigeonhole). For each segment taken as free, the next one
is decoded with the perfect binary Golay code of length 23: a word and its 23
neighbours decode to one or six codewords, and words within two errors always have
one in common. Segment and codeword are the key. A key held by very many fingerprints
takes the codeword of the third segment as well, which two errors allow too. Keys are
joined and each candidate is verified by its differing bits.

Rows with equal fingerprints are one class from the start, so a group of copies is one
node of the graph, however large it is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import maybe_broadcast, trimmed, written
from .components import connected_components

SEED = 42
MAX_BITS = 2
#: Bits of the three segments.
SEGMENTS = (22, 21, 21)
#: Fingerprints under one key beyond which the third segment joins the key.
CROWDED = 64
#: Shingles whose hashes are taken apart in one go.
AT_ONCE = 1 << 16

# ---- fixed values: the generator polynomial of the binary Golay code of length 23,
# x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1
GOLAY = 0b110001110101
# ----


def golay_syndromes() -> np.ndarray:
    """The error of least weight (at most three bits) for each of the 2048 syndromes."""

    def syndrome(word: int) -> int:
        for i in range(22, 10, -1):
            if word >> i & 1:
                word ^= GOLAY << (i - 11)
        return word

    out = np.zeros(2048, np.int64)
    bits = [1 << i for i in range(23)]
    for i, a in enumerate(bits):
        out[syndrome(a)] = a
        for j, b in enumerate(bits[:i]):
            out[syndrome(a | b)] = a | b
            for c in bits[:j]:
                out[syndrome(a | b | c)] = a | b | c
    return out


class Golay:
    """Codeword numbers of 23-bit words."""

    def __init__(self):
        self.error = golay_syndromes()
        #  The syndrome is linear: one table for the high bits, the low 11 stand for themselves.
        high = np.arange(4096, dtype=np.int64) << 11
        for i in range(22, 10, -1):
            high = np.where(high >> i & 1, high ^ (GOLAY << (i - 11)), high)
        self.high = high

    def nearest(self, words: np.ndarray) -> np.ndarray:
        """Number (the upper twelve bits) of the codeword next to each word."""
        syndrome = self.high[words >> 11] ^ (words & 2047)
        return (words ^ self.error[syndrome]) >> 11

    def keys(self, words: np.ndarray) -> np.ndarray:
        """For each word, the numbers of the codewords next to it and to its neighbours; -1 fills up repeats."""
        near = np.stack([self.nearest(words), *(self.nearest(words ^ (1 << i)) for i in range(23))], axis=1)
        near.sort(axis=1)
        near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
        near.sort(axis=1)
        return near[:, -6:]


def simhash(text: bytes, shingle: int = 3) -> int:
    """Fingerprint of one text (UTF-8)."""
    words = text.lower().split()
    if not words:
        return 0
    flat, size = b" ".join(words), np.array([len(w) for w in words])
    ends = np.cumsum(size + 1) - 1
    starts = ends - size
    n = max(1, len(words) - shingle + 1)
    first, last = starts[:n].tolist(), ends[-n:].tolist()
    hash64, votes = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, n, AT_ONCE):
        pairs = zip(first[at : at + AT_ONCE], last[at : at + AT_ONCE], strict=True)
        h = np.array([hash64(flat[a:b], SEED) for a, b in pairs], ">u8")
        votes += _votes(h)
    return int.from_bytes(np.packbits(votes * 2 > n).tobytes(), "big")


def _votes(h: np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit, the highest first."""
    bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1)
    #  Sums of up to 255 rows fit a byte, so most adding is done on bytes.
    whole = len(bits) // 255 * 255
    out = bits[whole:].sum(axis=0, dtype=np.int64)
    if whole:
        out += bits[:whole].reshape(-1, 255, 64).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
    return out


def fingerprints(docs: DataFrame, shingle: int = 3, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """doc_id and its fingerprint as a signed long; null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = b.column("text").cast(pa.large_binary())
            f = [simhash(x.as_buffer().to_pybytes() if x.is_valid else b"", shingle) for x in raw]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(np.array(f, np.uint64).view(np.int64))], names=["doc_id", "fp"])

    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return base.mapInArrow(trimmed(run), "doc_id long, fp long")


def _segments(fp: np.ndarray) -> list[np.ndarray]:
    out, shift = [], 64
    for bits in SEGMENTS:
        shift -= bits
        out.append((fp.view(np.uint64) >> np.uint64(shift)).astype(np.int64) & ((1 << bits) - 1))
    return out


def fuzzy_keys(nodes: DataFrame) -> DataFrame:
    """(key, fp) rows: linked fingerprints share at least one key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = Golay()
        for b in batches:
            fp = b.column("fp").to_numpy()
            parts = _segments(fp)
            near = [code.keys(p) for p in parts]
            for free in range(3):
                decoded = near[(free + 1) % 3]
                key = (np.int64(free) << 40) + (parts[free][:, None] << 12) + decoded
                row, col = np.nonzero(decoded >= 0)
                yield pa.RecordBatch.from_arrays([pa.array(key[row, col]), pa.array(fp[row])], names=["key", "fp"])

    return nodes.mapInArrow(trimmed(run), "key long, fp long")


def third_keys(rows: DataFrame) -> DataFrame:
    """(key, more, fp): crowded keys with the codewords of the segment that they left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = Golay()
        for b in batches:
            fp, key = b.column("fp").to_numpy(), b.column("key").to_numpy()
            near = np.stack([code.keys(p) for p in _segments(fp)])
            decoded = near[((key >> 40) + 2) % 3, np.arange(len(fp))]
            row, col = np.nonzero(decoded >= 0)
            yield pa.RecordBatch.from_arrays([pa.array(key[row]), pa.array(decoded[row, col]), pa.array(fp[row])], names=["key", "more", "fp"])

    return rows.select("key", "fp").mapInArrow(trimmed(run), "key long, more long, fp long")


def _differing(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def fingerprint_links(nodes: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """Pairs a < b of different fingerprints that differ in at most ``max_bits`` (two at most) bits."""
    if max_bits > MAX_BITS:
        raise ValueError("the keys cover two differing bits at most")
    keys = written(fuzzy_keys(nodes), "keys")
    sizes = keys.groupBy("key").count()
    shared = written(sizes.where("count > 1"), "shared")
    verify = (F.col("l.fp") < F.col("r.fp")) & (_differing(F.col("l.fp"), F.col("r.fp")) <= max_bits)

    def joined(rows: DataFrame, by: list[str]) -> DataFrame:
        on = verify
        for c in by:
            on = (F.col(f"l.{c}") == F.col(f"r.{c}")) & on
        return rows.alias("l").join(rows.alias("r"), on).select(F.col("l.fp").alias("a"), F.col("r.fp").alias("b"))

    few = shared.where(F.col("count") <= CROWDED).select("key")
    many = shared.where(F.col("count") > CROWDED).select("key")
    plain = written(keys.join(maybe_broadcast(few), "key", "left_semi"), "plain")
    found = joined(plain, ["key"])
    if many.limit(1).count():
        crowded = third_keys(keys.join(maybe_broadcast(many), "key", "left_semi"))
        found = found.union(joined(written(crowded, "crowded"), ["key", "more"]))
    return found.distinct()


def near_groups(docs: DataFrame, shingle: int = 3, max_bits: int = MAX_BITS) -> DataFrame:
    """One row per row of ``docs``: doc_id, fingerprint (16 hex digits) and component_id.

    The component is the smallest doc_id that links reach. Defined cases: null or empty
    text has fingerprint zero and links like any other; rows with a null doc_id take
    part, but do not name a component unless all of its doc_ids are null; repeated rows
    and ties are equal fingerprints; an empty table gives no rows; extra columns are
    ignored.
    """
    rows = written(fingerprints(docs, shingle), "simhash")
    nodes = rows.groupBy("fp").agg(F.min("doc_id").alias("least"))
    nodes = written(nodes, "nodes")
    links = connected_components(fingerprint_links(nodes.select("fp"), max_bits))
    linked = links.join(nodes, links.node == nodes.fp).groupBy("component").agg(F.min("least").alias("named"))
    names = written(links.join(linked, "component").select(F.col("node").alias("fp"), "named"), "names")
    named = nodes.join(names, "fp", "left").select("fp", F.coalesce("named", "least").alias("component_id"))
    out = rows.join(named, "fp")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
