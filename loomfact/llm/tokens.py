"""Token ids of whole texts with a vocabulary file of the ``tokenizers`` library.

The vocabulary splits texts at white space before anything else, and lower-cases, so
each white-space separated word has ids of its own. Words repeat: every worker keeps
bounded tables of ids, filled by the library, and only what they do not hold goes
through the library again. All words of a batch are looked up together, by their bytes,
in a table of numpy arrays. A new word of letters with marks behind it is made of its
letters, in lower case, and its marks, as the vocabulary's own rule splits it too.
"""

from __future__ import annotations

import os
from collections.abc import Callable
from functools import lru_cache
from string import punctuation

import numpy as np
import pyarrow as pa

#: Letters of words that a worker's tables hold at most.
TABLE_LETTERS = 300_000
#: New words that go through the library as one text.
JOINED = 512
#: Letters below this have one lower-case form, are composed and were letters in every version of Unicode in use.
_LATIN_END = "Ͱ"
#: White space that ends a word; the library sees to any other.
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


class WordTable:
    """ids of words of up to WIDTH bytes, by open addressing over arrays; a full table starts again."""

    WIDTH, SLOTS, PROBES = 23, 1 << 21, 8
    _MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
    _MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)

    def __init__(self):
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros((self.SLOTS, 3), np.uint64)
        self.at = np.full(self.SLOTS, -1, np.int32)
        self.size = np.zeros(self.SLOTS, np.int32)
        self.pool, self.used, self.words = np.zeros(1 << 20, np.uint32), 0, 0

    def keyed(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes and the size of each word as three numbers, and its first slot; ``data`` goes on for WIDTH bytes."""
        window = np.lib.stride_tricks.sliding_window_view(data, 8)
        keys = np.empty((len(starts), 3), np.uint64)
        for k in range(3):
            raw = window[starts + 8 * k].view("<u8")[:, 0]
            keys[:, k] = raw & self._MASKS[np.clip(sizes - 8 * k, 0, 8)]
        keys[:, 2] |= np.minimum(sizes, 255).astype(np.uint64) << np.uint64(56)  # a word may end in zero bytes
        mixed = (keys * self._MIX).sum(axis=1, dtype=np.uint64)
        mixed ^= mixed >> np.uint64(29)
        return keys, ((mixed * self._MIX[1]) >> np.uint64(43)).astype(np.int64)

    def find(self, keys: np.ndarray, slots: np.ndarray) -> np.ndarray:
        """Slot of each word, -1 if it isn't there."""
        out = np.full(len(slots), -1, np.int64)
        left = np.arange(len(slots))
        for probe in range(self.PROBES):
            s = (slots[left] + probe) & (self.SLOTS - 1)
            there = self.at[s] >= 0
            same = there & (self.keys[s] == keys[left]).all(axis=1)
            out[left[same]] = s[same]
            left = left[there & ~same]
            if not len(left):
                break
        return out

    def add(self, keys: np.ndarray, slots: np.ndarray, ids: list[bytes]) -> np.ndarray:
        """Put words that aren't there into the table; their slots, -1 where there was no room."""
        flat = np.frombuffer(b"".join(ids), "<u4")
        sizes = np.array([len(x) // 4 for x in ids], np.int64)
        if self.used + len(flat) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros(max(len(self.pool), len(flat)), np.uint32)])
        self.pool[self.used : self.used + len(flat)] = flat
        at = self.used + np.cumsum(sizes) - sizes
        self.used += len(flat)
        out, left = np.full(len(ids), -1, np.int64), np.arange(len(ids))
        for probe in range(self.PROBES):
            s = (slots[left] + probe) & (self.SLOTS - 1)
            free = np.flatnonzero(self.at[s] < 0)
            _, first = np.unique(s[free], return_index=True)
            won = free[first]
            who, where = left[won], s[won]
            self.keys[where], self.at[where], self.size[where] = keys[who], at[who], sizes[who]
            out[who] = where
            left = np.delete(left, won)
            if not len(left):
                break
        self.words += int((out >= 0).sum())
        return out

    def looked_up(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, before: np.ndarray, make: Callable[[list[bytes]], list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
        """ids of words given by place and size, and the number of ids of each text.

        ``before`` has the number of words before each text; ``make`` gives the ids of
        different words that the table does not hold.
        """
        if self.words > self.SLOTS // 2:
            self.clear()
        short = sizes <= self.WIDTH
        keys, slots = self.keyed(data, starts, sizes)
        where = self.find(keys, slots)
        where[~short] = -1
        missing = np.flatnonzero(where < 0)
        own: dict[bytes, int] = {}
        raw, of = data.tobytes(), np.empty(len(missing), np.int64)
        for k, (a, n) in enumerate(zip(starts[missing].tolist(), sizes[missing].tolist(), strict=True)):
            of[k] = own.setdefault(raw[a : a + n], len(own))
        ids = make(list(own))
        one = np.zeros(len(own), np.int64)
        one[of[::-1]] = missing[::-1]  # a place where each new word stands
        fits = np.flatnonzero(short[one])
        if self.words + len(fits) <= self.SLOTS * 3 // 4:
            self.add(keys[one[fits]], slots[one[fits]], [ids[i] for i in fits.tolist()])
        #  Lay out the ids: words of the table from its pool, new ones from their own.
        fresh = np.frombuffer(b"".join(ids), "<u4")
        fresh_size = np.array([len(x) // 4 for x in ids], np.int64)
        fresh_at = self.used + np.cumsum(fresh_size) - fresh_size
        count, source = self.size[where].astype(np.int64), self.at[where].astype(np.int64)
        count[missing], source[missing] = fresh_size[of], fresh_at[of]
        ends = np.cumsum(count)
        total = int(ends[-1]) if len(ends) else 0
        index = np.repeat(source - (ends - count), count) + np.arange(total)
        pool = np.concatenate([self.pool[: self.used], fresh]) if len(fresh) else self.pool
        bounds = np.concatenate([[0], ends])[before]
        return pool[index].astype("<u4", copy=False), np.diff(bounds)


class WordTokenizer:
    """ids of texts without special tokens."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.lib.encode_special_tokens = True
        vocab = self.lib.get_vocab()
        self.is_end = np.zeros(max(vocab.values()) + 1, bool)
        self.is_end[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.table = WordTable()
        self.marks: dict[str, bytes] = {"": b""}
        self.letters: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _alone(self, word: str) -> bytes:
        return np.array(self.lib.encode(word, add_special_tokens=False).ids, "<u4").tobytes()

    def _encode_letters(self, words: list[str]) -> list[bytes]:
        """ids of words of letters only: each is one piece, whose last id ends a word."""
        parts = [words[at : at + JOINED] for at in range(0, len(words), JOINED)]
        got = self.lib.encode_batch_fast([" ".join(p) for p in parts], add_special_tokens=False)
        out: list[bytes] = []
        for part, x in zip(parts, got, strict=True):
            ids = np.array(x.ids, "<u4")
            ends = np.flatnonzero(self.is_end[ids]) + 1
            if len(ends) != len(part):
                out += map(self._alone, part)
                continue
            raw, at4 = ids.tobytes(), (ends * 4).tolist()
            out += [raw[a:b] for a, b in zip([0, *at4], at4, strict=False)]
        return out

    def _known(self, letters: str) -> bytes | None:
        got = self.letters.get(letters)
        if got is None and (got := self.older.get(letters)) is not None:
            self.letters[letters] = got
        return got

    def words(self, words: list[str]) -> list[bytes]:
        """ids (little-endian unsigned 32-bit) of different words without white space that ends a word."""
        if len(self.letters) > TABLE_LETTERS:
            self.older, self.letters = self.letters, {}
        if len(self.marks) > TABLE_LETTERS:
            self.marks = {"": b""}
        marks, known, letters = self.marks, self._known, self.letters
        out: list[bytes] = [b""] * len(words)
        waiting, odd = [], []
        for i, w in enumerate(words):
            core = w.rstrip(punctuation).lower()
            ids, tail = letters.get(core) or known(core), marks.get(w[len(core) :])
            if ids is not None and tail is not None:
                out[i] = ids + tail if tail else ids
            elif core.isalpha() and (core.isascii() or max(core) < _LATIN_END):
                waiting.append((i, core, w[len(core) :]))
            else:
                odd.append(i)
        fresh = list({c for _, c, _ in waiting if known(c) is None})
        self.letters.update(zip(fresh, self._encode_letters(fresh), strict=True))
        for i, core, tail in waiting:
            if tail not in marks:
                marks[tail] = self._alone(tail)
            out[i] = self.letters[core] + marks[tail]
        got = self.lib.encode_batch_fast([words[i] for i in odd], add_special_tokens=False)
        for i, x in zip(odd, got, strict=True):
            out[i] = np.array(x.ids, "<u4").tobytes()
        return out

    def _split(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The texts' bytes (with room behind), first positions and sizes of words, and words before each text."""
        texts = texts.cast(pa.large_string())
        at = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
        raw = texts.buffers()[2]
        n = int(at[-1] - at[0])
        data = np.full(n + 1 + WordTable.WIDTH + 8, 0x20, np.uint8)
        if n:
            data[1 : n + 1] = np.frombuffer(raw, np.uint8, n, int(at[0]))
        gap = _SPACE[data[: n + 2]]
        edge = np.zeros(n + 2, bool)  # a text's first byte starts a word, whatever is before it
        edge[(at[:-1] - at[0] + 1)[at[1:] > at[:-1]]] = True
        word = ~gap
        first = word.copy()
        first[1:] &= gap[:-1] | edge[1:]
        last = word.copy()
        last[:-1] &= gap[1:] | edge[1:]
        starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        return data, starts, ends - starts, np.searchsorted(starts, at - at[0] + 1)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """ids of all texts one after the other, and the number of ids of each; null counts as empty."""
        return self.table.looked_up(*self._split(texts.fill_null("")), lambda new: self.words([w.decode() for w in new]))


@lru_cache(maxsize=2)
def tokenizer(path: str) -> WordTokenizer:
    """One tokenizer and word table for each worker process."""
    return WordTokenizer(path)


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
