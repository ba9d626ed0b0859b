"""Alignment of two tokenizers' tokens of the same texts, and statistics of their links.

A byte-level vocabulary (A) and a SentencePiece model (B) cut the same bytes. Both lists
of cumulative token ends are merged with two pointers: where they meet, a group of A and B
tokens closes, and every A token of a group is linked with every B token of it. Spark then
counts in how many documents each pair of ids is linked, and joins the counts and the
highest count of either side back to the links.

A text falls into units that neither side's tokens cross: white space and what follows it,
up to the next blank or line feed (of those that no piece of B holds behind another
character). A unit's tokens depend on nothing around it, so each worker keeps a bounded
table of units and sends only new ones through the libraries and the merge, many as one
text. Units that end in white space go alone.

Defined cases: null and empty texts, and texts whose bytes either side does not give back
(a literal mark of B's, say), have no tokens: zeros and an empty string. Rows that repeat
count as documents of their own; a null doc_id stays null; extra columns are ignored; an
empty table gives no rows. No text is cut; a unit may be as long as its text.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, maybe_broadcast, written
from .packing import slices
from .tokens import vocabulary

MARK = "▁"
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: New units that go through the libraries as one text.
JOINED = 2048
#: Units, and links and letters of units, that a worker's table holds at most.
TABLE_UNITS, TABLE_LINKS = 400_000, 4_000_000
#: Rows of the pair table up to which it may be broadcast (its bytes are bounded too).
PAIR_ROWS = 2_000_000
COUNTS = ("n_a", "n_b", "n_groups", "n_links")


def byte_level() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable Latin-1 itself, the rest from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


def merged(ends_a: np.ndarray, ends_b: np.ndarray) -> np.ndarray:
    """Positions (i, j) behind which both lists of cumulative ends meet: two pointers, the one that lags moves."""
    out, i, j, a, b = [], 0, 0, ends_a.tolist(), ends_b.tolist()
    n, m = len(a), len(b)
    while i < n and j < m:
        x, y = a[i], b[j]
        if x == y:
            i, j = i + 1, j + 1
            out.append((i, j))
        elif x < y:
            i += 1
        else:
            j += 1
    return np.array(out, np.int64).reshape(-1, 2)


class Aligner:
    """Tokens, groups and links of texts under two vocabularies."""

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.lib_a = Tokenizer.from_file(path_a)
        self.lib_a.encode_special_tokens = True
        self.lib_b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        letters, vocab = byte_level(), self.lib_a.get_vocab()
        self.raw_a = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            self.raw_a[i] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
        names = [self.lib_b.id_to_piece(i) for i in range(self.lib_b.vocab_size())]
        self.raw_b = [bytes([int(p[3:5], 16)]) if self.lib_b.is_byte(i) else p.replace(MARK, " ").encode() for i, p in enumerate(names)]
        self.size_a, self.size_b = (np.array([len(x) for x in raw], np.int64) for raw in (self.raw_a, self.raw_b))
        own = [p for i, p in enumerate(names) if not self.lib_b.is_byte(i)]
        behind = {c for p in own for b, c in zip(p, p[1:], strict=False) if c in " \n" + MARK and b not in " \n" + MARK}
        #  A line feed before a unit stands for any text before it, so no piece may hold one.
        self.cut = np.zeros(256, bool)
        if MARK not in behind and not any("\n" in p or " " in p for p in own):
            self.cut[[0x20, 0x0A]] = True
        self.lead = self.lib_b.encode("\n")
        self.clear()

    def clear(self) -> None:
        self.known: dict[bytes, int] = {}
        self.texts: list[str] = []
        self.numbers = np.zeros((1024, 6), np.int64)  # n_a, n_b, n_groups, n_links, first link, bad
        self.pool, self.used, self.letters = np.zeros(1 << 16, np.int64), 0, 0

    def cuts(self, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """First positions of all units of ``data``, whose texts begin at ``starts``."""
        at = np.flatnonzero(self.cut[data[1:]] & ~_SPACE[data[:-1]]) + 1
        p1, p2, p3 = (data[np.maximum(at - k, 0)] for k in (1, 2, 3))
        #  White space outside ASCII (or a separator) before a blank: A's tokens may hold both.
        odd = (p1 >= 0x1C) & (p1 <= 0x1F) | (p2 == 0xC2) & ((p1 == 0x85) | (p1 == 0xA0)) | (p3 == 0xE1) & (p2 == 0x9A) & (p1 == 0x80)
        odd |= (p3 == 0xE2) & ((p2 == 0x80) & ((p1 <= 0x8A) | (p1 == 0xA8) | (p1 == 0xA9) | (p1 == 0xAF)) | (p2 == 0x81) & (p1 == 0x9F))
        odd |= (p3 == 0xE3) & (p2 == 0x80) & (p1 == 0x80)
        return np.union1d(at[~odd], starts)

    def _ids_b(self, text: str) -> list[int]:
        if text[0] == " " and len(text) > 1:
            return self.lib_b.encode(text[1:])
        return self.lib_b.encode("\n" + text)[len(self.lead) :]

    def learn(self, units: list[bytes]) -> None:
        """Put new units into the table."""
        together, alone = [], []
        for u in units:
            (alone if u[-1:].isspace() or u.decode()[-1].isspace() or not self.cut[u[0]] or len(u) > 4096 else together).append(u)
        for at in range(0, len(together), JOINED):
            self._learn(together[at : at + JOINED])
        for u in alone:
            self._learn([u])

    def _learn(self, units: list[bytes]) -> None:
        whole = b"".join(units)
        text = whole.decode()
        a = np.array(self.lib_a.encode(text, add_special_tokens=False).ids, np.int64)
        b = np.array(self._ids_b(text), np.int64)
        bounds = np.cumsum([len(u) for u in units])
        ends_a, ends_b = np.cumsum(self.size_a[a]), np.cumsum(self.size_b[b])
        same = len(a) and len(b) and ends_a[-1] == ends_b[-1] == len(whole)
        same = same and b"".join(map(self.raw_a.__getitem__, a.tolist())) == whole == b"".join(map(self.raw_b.__getitem__, b.tolist()))
        meets = merged(ends_a, ends_b) if same else np.zeros((0, 2), np.int64)
        last = np.searchsorted(ends_a[meets[:, 0] - 1], bounds) if same else bounds
        if not same or (ends_a[meets[np.minimum(last, len(meets) - 1), 0] - 1] != bounds).any():
            if len(units) > 1:
                for u in units:
                    self._learn([u])
            else:
                self._add(units, np.zeros((1, 4), np.int64), np.zeros(0, np.int64), [""], 1)
            return
        #  Groups end at meets; all pairs of a group, group by group.
        from_a, from_b = np.vstack([[0, 0], meets[:-1]]).T
        n_a, n_b = meets[:, 0] - from_a, meets[:, 1] - from_b
        n = n_a * n_b
        r = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        per = np.repeat(n_b, n)
        links = a[np.repeat(from_a, n) + r // per] << 32 | b[np.repeat(from_b, n) + r % per]
        ends = meets[last]
        first = np.concatenate([[0], last[:-1] + 1])
        total = np.concatenate([[0], np.cumsum(n)])
        counts = np.column_stack([np.diff(ends[:, 0], prepend=0), np.diff(ends[:, 1], prepend=0), last + 1 - first, total[last + 1] - total[first]])
        sa, sb, cut = list(map(str, a.tolist())), list(map(str, b.tolist())), meets.tolist()
        texts, x, y, g = [], 0, 0, 0
        for end in (last + 1).tolist():
            parts = []
            for i, j in cut[g:end]:
                parts.append(f"{','.join(sa[x:i])}|{','.join(sb[y:j])}")
                x, y = i, j
            texts.append(";".join(parts))
            g = end
        self._add(units, counts, links, texts, 0)

    def _add(self, units: list[bytes], counts: np.ndarray, links: np.ndarray, texts: list[str], bad: int) -> None:
        at, n = len(self.texts), len(units)
        if at + n > len(self.numbers):
            self.numbers = np.concatenate([self.numbers, np.zeros((max(len(self.numbers), n), 6), np.int64)])
        if self.used + len(links) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros(max(len(self.pool), len(links)), np.int64)])
        self.pool[self.used : self.used + len(links)] = links
        self.numbers[at : at + n, :4] = counts
        self.numbers[at : at + n, 4] = self.used + np.cumsum(counts[:, 3]) - counts[:, 3]
        self.numbers[at : at + n, 5] = bad
        self.used += len(links)
        self.letters += sum(map(len, units)) + sum(map(len, texts))
        self.texts += texts
        self.known.update(zip(units, range(at, at + n), strict=True))

    def align(self, texts: pa.Array) -> pd.DataFrame:
        """n_a, n_b, n_groups, n_links, groups and links (a << 32 | b) with their occurrences (times) of each text."""
        if len(self.texts) > TABLE_UNITS or self.used > TABLE_LINKS or self.letters > 16 * TABLE_LINKS:
            self.clear()
        n = len(texts)
        texts = texts.cast(pa.large_binary())
        there = pc.greater(pc.fill_null(pc.binary_length(texts), 0), 0)
        spaced = pc.if_else(there, pc.binary_join_element_wise(pa.scalar(b" ", pa.large_binary()), texts, pa.scalar(b"", pa.large_binary())), pa.scalar(b"", pa.large_binary()))
        offsets = np.frombuffer(spaced.buffers()[1], np.int64, n + 1, spaced.offset * 8)
        data = np.frombuffer(spaced.buffers()[2], np.uint8, int(offsets[-1] - offsets[0]), int(offsets[0])) if offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
        at = offsets - offsets[0]
        if not len(data):
            return pd.DataFrame({c: np.zeros(n, np.int64) for c in COUNTS} | {"groups": [""] * n, "links": [np.zeros(0, np.int64)] * n, "times": [np.zeros(0, np.int64)] * n})
        starts = self.cuts(data, at[:-1][at[1:] > at[:-1]])
        units = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(np.append(starts, len(data)).astype(np.int64)), pa.py_buffer(data)]).dictionary_encode()
        different = units.dictionary.to_pylist()
        self.learn([u for u in different if u not in self.known])
        slot = np.array([self.known[u] for u in different], np.int64)[units.indices.to_numpy()]
        first = np.searchsorted(starts, at)  # units before each text
        doc = np.repeat(np.arange(n), np.diff(first))
        numbers = self.numbers[slot]
        sums = np.vstack([np.zeros((1, 6), np.int64), np.cumsum(numbers, axis=0)])
        of = sums[first[1:]] - sums[first[:-1]]
        good = of[:, 5] == 0
        out = pd.DataFrame({c: np.where(good, of[:, k], 0) for k, c in enumerate(COUNTS)})
        out["groups"] = [";".join(map(self.texts.__getitem__, slot[a:b].tolist())) if ok else "" for a, b, ok in zip(first[:-1].tolist(), first[1:].tolist(), good.tolist(), strict=True)]
        count = np.where(good[doc], numbers[:, 3], 0)
        flat = self.pool[np.repeat(numbers[:, 4] - (np.cumsum(count) - count), count) + np.arange(count.sum())]
        ends = np.concatenate([[0], np.cumsum(np.bincount(doc, count, n).astype(np.int64))])
        links, times = [], []
        for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
            x, k = np.unique(flat[a:b], return_counts=True)
            links.append(x), times.append(k)
        out["links"], out["times"] = links, times
        return out


@lru_cache(maxsize=1)
def aligner(path_a: str, path_b: str) -> Aligner:
    """One aligner and its table for each worker process."""
    return Aligner(path_a, path_b)


def alignments(docs: DataFrame, path_a: str | None = None, path_b: str | None = None) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, groups and links of each row.

    groups is ``a1,a2|b1;a3|b2,b3``, the ids of A and B tokens group by group; links has
    the different pairs of linked ids as numbers: the pair ``a << 32 | b`` in
    ``links`` and how often it is linked in ``times``, at the same place.
    """
    own = path_a or vocabulary("byte_bpe_50k.json"), path_b or vocabulary("piece_bpe_32k.model")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lib = aligner(*own)
        try:
            for f in frames:
                for at, texts in slices(pa.array(f["text"], pa.large_string(), from_pandas=True)):
                    out = lib.align(texts)
                    out.insert(0, "doc_id", f["doc_id"].iloc[at : at + len(texts)].to_numpy())
                    yield out
        finally:
            give_back()

    counts = ", ".join(f"{c} long" for c in COUNTS)
    #  As a string a doc_id passes through pandas unchanged, null or not.
    rows = docs.select(F.col("doc_id").cast("long").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = rows.mapInPandas(run, f"doc_id string, {counts}, groups string, links array<long>, times array<long>")
    return found.withColumn("doc_id", F.col("doc_id").cast("long"))


def pair_counts(links: DataFrame) -> DataFrame:
    """pair, count (rows that hold it linked), best_a and best_b (whether no pair of its A id, or B id, has more)."""
    pairs = links.groupBy("pair").agg(F.count(F.lit(1)).alias("count"))
    pairs = written(pairs.withColumn("a", F.shiftright("pair", 32)).withColumn("b", F.col("pair").bitwiseAND(0xFFFFFFFF)), "pairs")
    most = {s: pairs.groupBy(s).agg(F.max("count").alias(f"most_{s}")) for s in "ab"}
    both = pairs.join(most["a"], "a").join(most["b"], "b")
    return both.select("pair", "count", (F.col("count") == F.col("most_a")).alias("best_a"), (F.col("count") == F.col("most_b")).alias("best_b"))


def aligned(docs: DataFrame, path_a: str | None = None, path_b: str | None = None) -> DataFrame:
    """Alignment and link statistics of each row.

    doc_id, n_a, n_b, n_groups, n_links, n_best (links whose pair has the highest count of
    its A id), n_best_b (of its B id), count_sum (of the links' counts) and groups_sha256.
    """
    found = alignments(docs, path_a, path_b).withColumn("rid", F.monotonically_increasing_id())
    digest = F.when(F.col("groups") == "", "").otherwise(F.sha2(F.col("groups").cast("binary"), 256))
    rows = written(found.select("rid", "doc_id", *COUNTS, digest.alias("groups_sha256"), "links", "times"), "aligned")
    links = rows.select("rid", F.inline(F.arrays_zip("links", "times"))).withColumnsRenamed({"links": "pair", "times": "n"})
    pairs = written(pair_counts(links), "pair-counts")
    held = links.join(maybe_broadcast(pairs, PAIR_ROWS), "pair")
    best = lambda s: F.sum(F.when(F.col(s), F.col("n")).otherwise(0))
    sums = held.groupBy("rid").agg(best("best_a").alias("n_best"), best("best_b").alias("n_best_b"), F.sum(F.col("n") * F.col("count")).alias("count_sum"))
    zero = {"n_best": 0, "n_best_b": 0, "count_sum": 0}
    return rows.join(sums, "rid", "left").fillna(zero).select("doc_id", *COUNTS, "n_best", "n_best_b", "count_sum", "groups_sha256")
