"""Hashes of words and of runs of words, for whole batches at once.

A word's hash takes its bytes eight at a time: each step adds eight bytes and
spreads every bit over the whole number, so nothing cancels as it does in a
polynomial. Long words are hashed one by one by xxh3. The hash of a run of k
words is built from those of its halves in the same way, by powers of two, so
that the cost is a few array operations for each binary digit of k.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash

from .shared import bytes_of

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
# Odd multipliers, and for each seed a number to begin with.
_STEP, _PAIR = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_SEEDS = (0x243F6A8885A308D3, 0x13198A2E03707344)
#: Bytes from which on a word is hashed alone.
LONG = 256


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every bit over the whole number (a bijection)."""
    x = x ^ (x >> np.uint64(33))
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def both(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The hash of two runs, one after the other, from theirs."""
    return mix(a * _PAIR + b)


class Words:
    """The words of a string array: runs of anything but ASCII white space.

    Where results rest on hashes alone, ``secret`` is a number drawn for the run: no words can be made to collide under it.

    ``starts`` and ``stops`` are places in ``raw``; the words of text i are those from ``first[i]`` to ``first[i + 1]``.
    """

    def __init__(self, texts: pa.Array, lower: bool = False, secret: int = 0):
        self.secret = secret
        raw, ends = bytes_of(texts)
        self.raw = _LOWER[raw] if lower else raw
        word = ~_SPACE[raw]
        opens, closes = word.copy(), word.copy()
        opens[1:] &= ~word[:-1]
        closes[:-1] &= ~word[1:]
        edge = ends[:-1][ends[:-1] < len(raw)]
        opens[edge] = word[edge]
        edge = ends[1:][ends[1:] > 0] - 1
        closes[edge] = word[edge]
        self.starts = np.flatnonzero(opens)
        self.stops = np.flatnonzero(closes) + 1
        self.first = np.searchsorted(self.starts, ends)
        self._hashes: dict[int, np.ndarray] = {}

    def hashes(self, seed: int = 0) -> np.ndarray:
        if seed not in self._hashes:
            length = self.stops - self.starts
            padded = np.concatenate([self.raw, np.zeros(8, np.uint8)])
            eight = np.ndarray((len(self.raw) + 1,), "<u8", padded, strides=(1,))  # the eight bytes from each place on
            h = mix(length.astype(np.uint64) * _STEP + np.uint64(_SEEDS[seed] ^ self.secret))
            left = np.flatnonzero(length < LONG)
            done = 0
            while len(left):
                some = np.minimum(length[left] - done, 8).astype(np.uint64)
                block = eight[self.starts[left] + done] & (np.uint64(2**64 - 1) >> (np.uint64(64) - some * np.uint64(8)))
                h[left] = mix((h[left] ^ block) * _STEP)
                done += 8
                left = left[length[left] > done]
            raw = memoryview(np.ascontiguousarray(self.raw))
            for i in np.flatnonzero(length >= LONG).tolist():
                h[i] = xxhash.xxh3_64_intdigest(raw[self.starts[i] : self.stops[i]], seed=_SEEDS[seed] ^ self.secret)
            self._hashes[seed] = h
        return self._hashes[seed]

    def runs(self, k: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all runs of k words within one text, in order, and for each text the offset of its first."""
        n = np.maximum(np.diff(self.first) - k + 1, 0)
        offsets = np.concatenate([[0], np.cumsum(n)])
        if not offsets[-1]:
            return np.zeros(0, np.uint64), offsets
        # Every run of k in a row, also over the ends of texts; those within a text are taken from it.
        power, size, whole, taken = self.hashes(seed), 1, None, 0
        places = len(power) - k + 1
        while True:
            if k & size:
                part = power[taken : taken + places]
                whole = part if whole is None else both(whole, part)
                taken += size
            if 2 * size > k:
                break
            power, size = both(power[: len(power) - size], power[size:]), 2 * size
        at = np.repeat(self.first[:-1] - offsets[:-1], n) + np.arange(int(offsets[-1]))
        return (whole if len(whole) == len(at) else whole[at]), offsets

    def spaced(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The bytes with every run of white space after a word as one space, and where each word starts and stops there."""
        kept = ~_SPACE[self.raw]
        after = self.stops[self.stops < len(self.raw)]
        kept[after] = True  # the white space after a word, or the first byte of the next text
        moved = np.concatenate([[0], np.cumsum(kept)])
        return np.where(_SPACE[self.raw], np.uint8(0x20), self.raw)[kept], moved[self.starts], moved[self.stops]
