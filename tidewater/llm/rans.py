"""Static range asymmetric numeral system over arrays of token ids, in numpy.

A block holds up to ``BLOCK`` ids on ``lanes`` interleaved 64-bit states: id i belongs
to lane i mod lanes, so that one numpy step codes one id of every lane. All blocks of
a file share one table of frequencies that add up to 2**BITS.
"""

from __future__ import annotations

import numpy as np

BITS = 20
BLOCK = 1 << 18
LANES = 1024
_LOW = np.uint64(1 << 31)
_B, _W = np.uint64(BITS), np.uint64(32)
_MASK = np.uint64((1 << BITS) - 1)


def table(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct ids and frequencies of at least 1 that add up to 2**BITS."""
    if len(ids) and ids.max() < 1 << 22:
        counts = np.bincount(ids)
        symbols = np.flatnonzero(counts)
        counts = counts[symbols]
    else:
        symbols, counts = np.unique(ids, return_counts=True)
    if not len(symbols):
        return symbols.astype(np.uint32), counts.astype(np.uint32)
    if len(symbols) > 1 << (BITS - 1):
        raise ValueError("too many different ids for one table")
    freq = np.maximum(1, np.floor(counts * ((1 << BITS) / counts.sum()))).astype(np.int64)
    over = int(freq.sum()) - (1 << BITS)
    if over < 0:
        freq[np.argmax(freq)] -= over
    for k in np.argsort(-freq, kind="stable") if over > 0 else ():
        cut = min(over, int(freq[k]) // 2)
        freq[k] -= cut
        over -= cut
        if not over:
            break
    return symbols.astype(np.uint32), freq.astype(np.uint32)


class Coder:
    def __init__(self, symbols: np.ndarray, freq: np.ndarray):
        self.symbols, self.freq = symbols, freq.astype(np.uint64)
        self.start = np.concatenate(([0], np.cumsum(freq, dtype=np.uint64)[:-1])).astype(np.uint64) if len(freq) else np.zeros(0, np.uint64)
        self.slots = None
        self.place = None
        if len(symbols) and symbols[-1] < 1 << 22:
            self.place = np.zeros(int(symbols[-1]) + 1, np.uint32)
            self.place[symbols] = np.arange(len(symbols), dtype=np.uint32)

    def encode(self, ids: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
        """(lanes, final states, words in the order in which decoding reads them)."""
        n = len(ids)
        lanes = int(min(LANES, max(1, n // 64)))
        at = np.searchsorted(self.symbols, ids) if self.place is None else self.place[ids]
        freq, start = self.freq[at], self.start[at]
        limit = freq << np.uint64(31 - BITS + 32)
        state = np.full(lanes, _LOW, np.uint64)
        words = []
        for lo in range((n - 1) // lanes * lanes, -1, -lanes):
            hi = min(n, lo + lanes)
            x, f = state[: hi - lo], freq[lo:hi]
            full = x >= limit[lo:hi]
            if full.any():
                words.append(x[full].astype(np.uint32))
                x = np.where(full, x >> _W, x)
            q = x // f
            state[: hi - lo] = (q << _B) + (x - q * f) + start[lo:hi]
        return lanes, state, np.concatenate(words[::-1]) if words else np.zeros(0, np.uint32)

    def decode(self, n: int, lanes: int, state: np.ndarray, words: np.ndarray) -> np.ndarray:
        if self.slots is None:
            self.slots = np.repeat(np.arange(len(self.symbols), dtype=np.uint32), self.freq.astype(np.int64))
        out = np.empty(n, np.uint32)
        state, at = state.copy(), 0
        for lo in range(0, n, lanes):
            hi = min(n, lo + lanes)
            x = state[: hi - lo]
            slot = x & _MASK
            s = self.slots[slot]
            out[lo:hi] = s
            x = self.freq[s] * (x >> _B) + slot - self.start[s]
            low = np.flatnonzero(x < _LOW)
            if len(low):
                x[low] = (x[low] << _W) | words[at : at + len(low)].astype(np.uint64)
                at += len(low)
            state[: hi - lo] = x
        if at != len(words) or not (state == _LOW).all():
            raise ValueError("block is damaged: states do not end where they began")
        return self.symbols[out]
