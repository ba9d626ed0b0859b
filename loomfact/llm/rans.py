"""Static range asymmetric numeral system for token ids.

One frequency table, made of all documents, is shared by all blocks. A block holds
the ids of whole documents and is coded on its own: LANES coders take turns over
its ids (the id at position i belongs to lane i mod LANES), so each step is one
vectorised operation over all lanes. A block carries its final states, checkpoints
(the states and the position in the words after every CHECK_STEPS steps, from which
decoding can start) and a checksum of its ids.
"""

from __future__ import annotations

import zlib

import numpy as np

LANES = 1024
CHECK_STEPS = 128
BITS = 20
_LOW = np.uint64(1 << 31)
_32 = np.uint64(32)


def quantised(counts: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Frequencies of all symbols, adding up to ``2**bits``; 0 only for symbols that do not occur."""
    counts = counts.astype(np.float64)
    seen = counts > 0
    if not seen.any():
        return np.zeros(len(counts), np.int64)
    if seen.sum() > 1 << bits:
        raise ValueError("more symbols than the table has slots")
    out = np.where(seen, np.maximum(1, np.floor(counts * ((1 << bits) / counts.sum()))), 0).astype(np.int64)
    order = np.argsort(-out, kind="stable")[: int(seen.sum())]
    left = (1 << bits) - int(out.sum())
    while left:
        room = out[order] - 1 if left < 0 else np.full(len(order), left)
        step = np.minimum(room, max(1, abs(left) // len(order)))
        step = np.where(np.cumsum(step) <= abs(left), step, 0)
        out[order] += step if left > 0 else -step
        left = (1 << bits) - int(out.sum())
    return out


class Coder:
    """Encodes and decodes blocks with one table of frequencies."""

    def __init__(self, freq: np.ndarray, bits: int = BITS, lanes: int = LANES):
        self.bits, self.lanes = np.uint64(bits), lanes
        self.freq = freq.astype(np.uint64)
        self.start = (np.cumsum(freq) - freq).astype(np.uint64)
        self.symbol = np.repeat(np.arange(len(freq), dtype=np.uint32), freq)
        self.most = int(np.argmax(freq)) if len(freq) else 0

    def encode(self, ids: np.ndarray) -> dict:
        """The block's fields; ``ids`` holds at least one id."""
        lanes = min(self.lanes, len(ids))
        steps = -(-len(ids) // lanes)
        padded = np.full(steps * lanes, self.most, np.int64)
        padded[: len(ids)] = ids
        grid = padded.reshape(steps, lanes)
        x = np.full(lanes, _LOW, np.uint64)
        shift = np.uint64(63) - self.bits
        words, checks, n_words = [], [], 0
        for t in range(steps - 1, -1, -1):
            f, c = self.freq[grid[t]], self.start[grid[t]]
            full = x >= (f << shift)
            out = x[full]
            words.append((out & np.uint64(0xFFFFFFFF)).astype("<u4"))
            n_words += len(out)
            x = np.where(full, x >> _32, x)
            q = x // f
            x = (q << self.bits) + (x - q * f) + c
            if t % CHECK_STEPS == 0 and t:
                checks.append((t, n_words, x))
        stream = np.concatenate(words[::-1]) if words else np.empty(0, "<u4")
        checks = checks[::-1]
        return {
            "n_ids": len(ids),
            "lanes": lanes,
            "states": x.astype("<u8").tobytes(),
            "words": stream.tobytes(),
            "check_steps": [t for t, _, _ in checks],
            "check_words": [len(stream) - n for _, n, _ in checks],
            "check_states": b"".join(s.astype("<u8").tobytes() for _, _, s in checks),
            "crc32": zlib.crc32(ids.astype("<u4").tobytes()),
        }

    def decode(self, block: dict, check: int | None = None) -> np.ndarray:
        """All ids of a block, or those from its checkpoint number ``check`` on."""
        lanes, n = block["lanes"], block["n_ids"]
        steps, stream = -(-n // lanes), np.frombuffer(block["words"], "<u4").astype(np.uint64)
        if check is None:
            first, at, x = 0, 0, np.frombuffer(block["states"], "<u8").astype(np.uint64)
        else:
            first, at = block["check_steps"][check], block["check_words"][check]
            x = np.frombuffer(block["check_states"], "<u8", lanes, check * lanes * 8).astype(np.uint64)
        grid = np.empty((steps - first, lanes), np.uint32)
        mask = np.uint64((1 << int(self.bits)) - 1)
        for t in range(steps - first):
            slot = x & mask
            s = self.symbol[slot.astype(np.int64)]
            grid[t] = s
            x = self.freq[s] * (x >> self.bits) + slot - self.start[s]
            low = np.flatnonzero(x < _LOW)
            if len(low):
                x[low] = (x[low] << _32) | stream[at : at + len(low)]
                at += len(low)
        ids = grid.reshape(-1)[: n - first * lanes]
        if check is None and zlib.crc32(ids.astype("<u4").tobytes()) != block["crc32"]:
            raise ValueError("a block's checksum does not fit its ids")
        return ids
