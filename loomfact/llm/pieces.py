"""SentencePiece encoding and decoding of whole texts by a batched Viterbi search.

The pieces and scores come from a public model file. A text is prepared as the model
does (a space in front, spaces as the model's mark) and cut where no piece can reach
across: before a mark behind another character, and around line feeds if no piece
holds one. Words of equal length advance together: for each end position the rolling
hashes of all substrings are probed in the sorted hashes of the pieces, hits are
confirmed by their characters, and the best piece is stored as a backpointer. A
character without a piece becomes its bytes. Long words whose length few others have, as
in texts without spaces, are searched alone, all places of a word together.

What is best follows the model's kind. With unigram scores it is the highest sum, the
longer last piece on a tie. With merges every beginning of a word has just one last
piece: the one that merges would leave standing next to the last piece before it. Two
pieces stand together if undoing their merges, the latest first, never shows a pair
that would have merged across them before; so the same search gives the merges' result.
(Runs of marks are left to the library: the model ranks the shortest of them last, so
their merges do not come in the order of their ranks.)

Defined cases: null text counts as empty and has no ids; the mark itself reads back as
a space; rows that repeat are encoded each; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import trimmed
from .packing import slices
from .tokens import WordTable, vocabulary

MARK = "▁"
#: Words of equal length that advance together.
TOGETHER = 1 << 16
#: Words of more characters than this, if there are fewer than FEW_WORDS of their length, are searched alone.
LONG_WORD, FEW_WORDS = 24, 8
_BASE = np.uint64(0x9E3779B97F4A7C15)
#: Bits of a hash that are left for the marks by which most substrings are passed over.
_SHIFT = np.uint64(64 - 18)
#: How far below the lowest score a character without a piece is.
_UNKNOWN = 10.0


class Pieces:
    """The pieces of a model file, and the search over them."""

    def __init__(self, path: str):
        import sentencepiece

        lib = self.lib = sentencepiece.SentencePieceProcessor(model_file=path)
        n = lib.vocab_size()
        self.names = [lib.id_to_piece(i) for i in range(n)]
        special = [lib.is_unknown(i) or lib.is_control(i) or lib.is_byte(i) or lib.is_unused(i) for i in range(n)]
        self.unknown_id = lib.unk_id()
        self.bytes = np.full(256, self.unknown_id, np.int64)
        for i in range(n):
            if lib.is_byte(i):
                self.bytes[int(self.names[i][3:5], 16)] = i
        own = [i for i in range(n) if not special[i]]
        self.longest = max(len(self.names[i]) for i in own)
        hashes = np.array([self._hash(self.names[i]) for i in own], np.uint64)
        order = np.argsort(hashes)
        self.keys, self.ids = hashes[order], np.array(own)[order]
        self.scores = np.array([lib.get_score(i) for i in own])[order]
        self.sizes = np.array([len(self.names[i]) for i in own])[order]
        self.chars = np.zeros((len(own), self.longest), np.uint32)
        for k, i in enumerate(self.ids.tolist()):
            self.chars[k, : len(self.names[i])] = [ord(c) for c in self.names[i]]
        self.marked = np.zeros((self.longest + 1, 1 << 18), bool)
        self.marked[self.sizes, (self.keys >> _SHIFT).astype(np.int64)] = True
        self.merges = self._kind(path) == 2
        if self.merges:
            self._prepare_merges()
        self.lowest = float(self.scores.min()) - _UNKNOWN
        self.power = np.ones(self.longest + 1, np.uint64)
        for k in range(1, self.longest + 1):
            self.power[k] = int(self.power[k - 1]) * int(_BASE) & 0xFFFFFFFFFFFFFFFF
        self.feeds_alone = not any("\n" in self.names[i] for i in own)
        self.table = WordTable()
        text = ["" if special[i] else self.names[i].replace(MARK, " ") for i in range(n)]
        self.raw = [t.encode() for t in text]
        for b, i in enumerate(self.bytes.tolist()):
            if i != self.unknown_id:
                self.raw[i] = bytes([b])

    @staticmethod
    def _hash(text: str) -> int:
        h = 0
        for c in text:
            h = (h * int(_BASE) + ord(c) + 1) & 0xFFFFFFFFFFFFFFFF
        return h

    @staticmethod
    def _kind(path: str) -> int:
        """1 for a model with unigram scores, 2 for one made by merges."""
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        return model.trainer_spec.model_type

    def _prepare_merges(self) -> None:
        """Rank of each piece by its merge (0 for characters), the two pieces it is merged of, and all pairs that merge."""
        n = len(self.keys)
        names = [self.names[i] for i in self.ids.tolist()]
        at = {t: k for k, t in enumerate(names)}
        order = np.unique(-self.scores[self.sizes > 1], return_inverse=True)[1]
        self.rank = np.zeros(n, np.int64)
        self.rank[self.sizes > 1] = order + 1
        rank = self.rank.tolist()
        self.head, self.tail = np.full(n, -1, np.int64), np.full(n, -1, np.int64)
        self.whole = np.zeros(n, bool)  # pieces that the merges leave as they are
        pairs, made = [], []
        for k, t in enumerate(names):
            for i in range(1, len(t)):
                x, y = at.get(t[:i]), at.get(t[i:])
                if x is not None and y is not None:
                    pairs.append(x << 20 | y)
                    made.append(k)
            parts, last = list(t), None
            while len(parts) > 1:
                found = [(rank[at[x + y]], i) for i, (x, y) in enumerate(zip(parts, parts[1:], strict=False)) if x + y in at]
                if not found:
                    break
                i = min(found)[1]
                last = (parts[i], parts[i + 1])
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
            if len(parts) == 1:
                self.whole[k] = True
                if last:
                    self.head[k], self.tail[k] = at[last[0]], at[last[1]]
        by = np.argsort(pairs)
        self.pairs, self.made = np.array(pairs, np.int64)[by], np.array(made)[by]
        self.paired = np.zeros(1 << 20, bool)
        self.paired[self._pair_mark(self.pairs)] = True

    @staticmethod
    def _pair_mark(pairs: np.ndarray) -> np.ndarray:
        return ((pairs.astype(np.uint64) * _BASE) >> np.uint64(44)).astype(np.int64)

    def together(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Which pairs of pieces the merges leave standing side by side."""
        ok, open_ = np.ones(len(left), bool), np.arange(len(left))
        x, y, limit = left.copy(), right.copy(), np.full(len(left), 1 << 40)
        while len(open_):
            pair = x << 20 | y
            maybe = np.flatnonzero(self.paired[self._pair_mark(pair)])
            at = np.minimum(np.searchsorted(self.pairs, pair[maybe]), len(self.pairs) - 1)
            crossed = maybe[(self.pairs[at] == pair[maybe]) & (self.rank[self.made[at]] < limit[maybe])]
            ok[open_[crossed]] = False
            #  Undo the later of the two merges; of equal ones the left was first.
            back = self.rank[x] > self.rank[y]
            limit = np.where(back, self.rank[x], self.rank[y] + 1)
            more = np.where(back, self.tail[x], self.head[y])
            go = more >= 0
            go[crossed] = False
            x, y = np.where(back, more, x)[go], np.where(back, y, more)[go]
            limit, open_ = limit[go], open_[go]
        return ok

    def search(self, words: list[str]) -> list[bytes]:
        """ids (little-endian unsigned 32-bit) of each word."""
        out: list[bytes] = [b""] * len(words)
        by_size: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            if self.merges and w.startswith(MARK + MARK):
                out[i] = np.array(self.lib.encode(w[1:].replace(MARK, " ")), "<u4").tobytes()
                continue
            by_size.setdefault(len(w), []).append(i)
        for size, at in by_size.items():
            if size > LONG_WORD and len(at) < FEW_WORDS:
                for i in at:
                    out[i] = self._long(words[i])
                continue
            step = max(1, TOGETHER // max(1, size))
            for a in range(0, len(at), step):
                part = at[a : a + step]
                for i, ids in zip(part, self._equal([words[i] for i in part], size), strict=True):
                    out[i] = ids
        return out

    def _equal(self, words: list[str], size: int) -> list[bytes]:
        n = len(words)
        codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4").reshape(n, size)
        h = np.zeros((size + 1, n), np.uint64)
        for j in range(size):
            h[j + 1] = h[j] * _BASE + codes[:, j] + np.uint64(1)
        best = np.full((size + 1, n), -np.inf)
        best[0] = 0.0
        back, piece = np.zeros((size + 1, n), np.int32), np.full((size + 1, n), -1, np.int64)
        last = np.full((size + 1, n), -1, np.int64)  # the piece's place among the keys
        for j in range(1, size + 1):
            for m in range(min(self.longest, j), 0, -1):
                want = h[j] - h[j - m] * self.power[m]
                hit = np.flatnonzero(self.marked[m][want >> _SHIFT])
                want = want[hit]
                k = np.minimum(np.searchsorted(self.keys, want), len(self.keys) - 1)
                good = (self.keys[k] == want) & (self.sizes[k] == m)
                hit, k = hit[good], k[good]
                good = (self.chars[k, :m] == codes[hit, j - m : j]).all(axis=1)
                hit, k = hit[good], k[good]
                if m == 1:
                    known = np.zeros(n, bool)
                    known[hit] = True
                if self.merges:
                    free = (back[j, hit] == 0) & self.whole[k]
                    hit, k = hit[free], k[free]
                    before = last[j - m, hit]
                    fits = before < 0
                    fits[~fits] = self.together(before[~fits], k[~fits])
                    hit, k, score = hit[fits], k[fits], np.zeros(int(fits.sum()))
                else:
                    score = best[j - m, hit] + self.scores[k]
                more = score > best[j, hit]
                who = hit[more]
                best[j, who], back[j, who], piece[j, who], last[j, who] = score[more], m, self.ids[k[more]], k[more]
                if m == 1:
                    none = ~known
                    score = best[j - 1] + self.lowest
                    who = np.flatnonzero(none & (score > best[j]))
                    best[j, who], back[j, who], piece[j, who] = score[who], 1, -1
        path, at, steps = np.full((size, n), -2, np.int64), np.full(n, size), 0
        every = np.arange(n)
        while (at > 0).any():
            open_ = every[at > 0]
            path[steps, open_] = piece[at[open_], open_]
            at[open_] -= back[at[open_], open_]
            steps += 1
        path = path[:steps][::-1].T
        raw = path[path > -2].astype("<u4").tobytes()
        ends = (np.cumsum((path > -2).sum(axis=1)) * 4).tolist()
        out = [raw[a:b] for a, b in zip([0, *ends], ends, strict=False)]
        for i in np.flatnonzero((path == -1).any(axis=1)).tolist():
            out[i] = self._with_bytes(words[i], path[i][path[i] > -2]).astype("<u4").tobytes()
        return out

    def _long(self, word: str) -> bytes:
        """ids of one long word: all its substrings are probed, and all neighbouring pieces compared, in one go each.

        Alone, a word has nothing to advance together with, so its places take the words'
        part; what is left for each place is to pick among the few pieces that end there.
        """
        size = len(word)
        codes = np.frombuffer(word.encode("utf-32-le", "surrogatepass"), "<u4")
        rolled, h = [0], 0
        for c in codes.tolist():
            h = (h * int(_BASE) + c + 1) & 0xFFFFFFFFFFFFFFFF
            rolled.append(h)
        h, ends, lengths, places = np.array(rolled, np.uint64), [], [], []
        for m in range(min(self.longest, size), 0, -1):
            want = h[m:] - h[:-m] * self.power[m]
            at = np.flatnonzero(self.marked[m][want >> _SHIFT])
            k = np.minimum(np.searchsorted(self.keys, want[at]), len(self.keys) - 1)
            good = (self.keys[k] == want[at]) & (self.sizes[k] == m)
            if self.merges:
                good &= self.whole[k]
            at, k = at[good], k[good]
            good = (self.chars[k, :m] == codes[at[:, None] + np.arange(m)]).all(axis=1)
            ends.append(at[good] + m), places.append(k[good]), lengths.append(np.full(int(good.sum()), m))
        end, k, m = (np.concatenate(x) for x in (ends, places, lengths))
        order = np.lexsort((-m, end))
        end, k, m = end[order], k[order], m[order]
        begin = end - m
        low = np.searchsorted(end, np.arange(size + 2), "left").tolist()
        high = low[1:]
        best, picked = [0.0] + [-np.inf] * size, [-1] * (size + 1)  # the piece that ends at each place
        if self.merges:
            counts = (np.array(high)[begin] - np.array(low[:-1])[begin]) * (begin > 0)
            base = np.concatenate([[0], np.cumsum(counts)])
            fits = np.empty(int(base[-1]), bool)
            for a in range(0, len(k), TOGETHER):
                z = min(len(k), a + TOGETHER)
                own = np.repeat(np.arange(a, z), counts[a:z])
                before = np.arange(base[a], base[z]) - base[own] + np.array(low)[begin[own]]
                fits[base[a] : base[z]] = self.together(k[before], k[own])
            starts, offset, fits = begin.tolist(), base.tolist(), fits.tolist()
            for j in range(1, size + 1):
                for c in range(low[j], high[j]):
                    p = picked[starts[c]]
                    if p < 0 or fits[offset[c] + p - low[starts[c]]]:
                        picked[j] = c
                        break
        else:
            starts, scores = begin.tolist(), self.scores[k].tolist()
            single = (m == 1).tolist()
            for j in range(1, size + 1):
                known = False
                for c in range(low[j], high[j]):
                    known |= single[c]
                    if (score := best[starts[c]] + scores[c]) > best[j]:
                        best[j], picked[j] = score, c
                if not known and (score := best[j - 1] + self.lowest) > best[j]:
                    best[j], picked[j] = score, -1
        ids, path, j = self.ids[k].tolist(), [], size
        while j > 0:
            c = picked[j]
            path.append(ids[c] if c >= 0 else -1)
            j = starts[c] if c >= 0 else j - 1
        path = np.array(path[::-1], np.int64)
        return (self._with_bytes(word, path) if (path < 0).any() else path).astype("<u4").tobytes()

    def _with_bytes(self, word: str, ids: np.ndarray) -> np.ndarray:
        out, at = [], 0
        for i in ids.tolist():
            if i < 0:
                out += self.bytes[list(word[at].encode("utf-8", "surrogatepass"))].tolist()
                at += 1
            else:
                out.append(i)
                at += len(self.names[i])
        return np.array(out, np.int64)

    def _split(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The texts' bytes with a space in front of each that isn't empty (and room behind), and their words."""
        texts = pc.replace_substring(texts.fill_null("").cast(pa.large_string()), MARK, " ")
        texts = pc.if_else(pc.equal(texts, ""), texts, pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), texts, pa.scalar("", pa.large_string())))
        at = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
        n, raw = int(at[-1] - at[0]), texts.buffers()[2]
        data = np.full(n + WordTable.WIDTH + 9, 0x20, np.uint8)
        if n:
            data[:n] = np.frombuffer(raw, np.uint8, n, int(at[0]))
        space, feed = data[:n] == 0x20, (data[:n] == 0x0A) & self.feeds_alone
        first = feed.copy()
        first[1:] |= feed[:-1] | (space[1:] & ~space[:-1])
        first[(at[:-1] - at[0])[at[1:] > at[:-1]]] = True
        starts = np.flatnonzero(first)
        return data, starts, np.diff(np.append(starts, n)), np.searchsorted(starts, at - at[0])

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """ids of all texts one after the other, and the number of ids of each; null counts as empty."""
        return self.table.looked_up(*self._split(texts), lambda new: self.search([w.decode().replace(" ", MARK) for w in new]))

    def decode(self, ids: list[bytes]) -> list[str]:
        raw = self.raw
        out = []
        for x in ids:
            text = b"".join([raw[i] for i in np.frombuffer(x, "<u4").tolist()]).decode("utf-8", "replace")
            out.append(text[1:] if text.startswith(" ") else text)
        return out


@lru_cache(maxsize=2)
def pieces(path: str) -> Pieces:
    return Pieces(path)


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_ids and ids (little-endian unsigned 32-bit) of each row's whole text."""
    path = path or vocabulary("piece_bpe_32k.model")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pieces(path)
        for b in batches:
            for at, texts in slices(b.column("text")):
                flat, size = model.encode(texts)
                cuts = np.concatenate([[0], np.cumsum(size) * 4]).astype(np.int32)
                ids = pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(cuts), pa.py_buffer(flat)])
                cols = [b.column("doc_id").slice(at, len(size)), pa.array(size), ids]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_ids", "ids"])

    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return base.mapInArrow(trimmed(run), "doc_id long, n_ids long, ids binary")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, ids and text of each row of ids."""
    path = path or vocabulary("piece_bpe_32k.model")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pieces(path)
        for b in batches:
            text = pa.array(model.decode(b.column("ids").to_pylist()), pa.string())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("ids"), text], names=["doc_id", "ids", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(trimmed(run), "doc_id long, ids binary, text string")
