"""Words of many texts as numbers, and hashes of their runs."""

from __future__ import annotations

import numpy as np
import xxhash

from .common import raw

#: White space that parts words: a fixed value of the queries' contract.
SPACE = np.zeros(256, bool)
SPACE[[32, *range(9, 14)]] = True
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
ODD = np.uint64(0xD6E8FEB86659FD93)
#: Keeps the first k bytes of eight.
FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
#: Longer words are hashed one by one.
LONG = 512


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(32))) * ODD
    return x ^ (x >> np.uint64(29))


def rolling(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of every run of ``size`` words, built from runs of 1, 2, 4, ... words by the binary digits of ``size``."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    part, span, at, left = words, 1, 0, size
    while left:
        if left & 1:
            out = mixed(out * MULTIPLIER + part[at : at + n])
            at += span
        left >>= 1
        if left:
            part = mixed(part[: len(part) - span] * MULTIPLIER + part[span:])
            span *= 2
    return mixed(out + np.uint64(size))


def numbers(body: bytes, start: np.ndarray, end: np.ndarray, seed: int) -> np.ndarray:
    """Hash of every word: its bytes in chunks of eight, each mixed into the state (not a sum, so that no family of words cancels out)."""
    size = end - start
    eight = np.ndarray((len(body) + 1,), np.uint64, body + bytes(8), 0, (1,))  # the eight bytes from each place on
    state = mixed(size.astype(np.uint64) * MULTIPLIER + np.uint64(seed))
    state = mixed((state ^ (eight[start] & FIRST[np.minimum(size, 8)])) * MULTIPLIER)
    left = np.flatnonzero((size > 8) & (size <= LONG))
    done = 8
    while len(left):
        chunk = eight[start[left] + done] & FIRST[np.minimum(size[left] - done, 8)]
        state[left] = mixed((state[left] ^ chunk) * MULTIPLIER)
        done += 8
        left = left[size[left] > done]
    for i in np.flatnonzero(size > LONG).tolist():
        state[i] = xxhash.xxh3_64_intdigest(body[start[i] : end[i]], seed)
    return state


class Slice:
    """The words of a slice's texts end to end as 64-bit numbers, and where each text's begin."""

    def __init__(self, column, fold: bytes | None = None):
        body, begins = raw(column)
        self.body = body = body.translate(fold) if fold else body
        letters = np.frombuffer(body, np.uint8)
        inside = ~SPACE[letters]
        edge = np.zeros(len(letters) + 1, bool)  # between texts
        edge[begins] = True
        first, last = inside.copy(), inside.copy()
        first[1:] &= ~inside[:-1] | edge[1:-1]
        last[:-1] &= ~inside[1:] | edge[1:-1]
        self.start, self.end = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.numbers = numbers(body, self.start, self.end, 1)
        self.begins = np.searchsorted(self.start, begins).astype(np.int64)

    def fits(self, n: int, size: int) -> np.ndarray:
        """Whether the run of ``size`` words at each of the first n places lies within one text."""
        ok = np.ones(n, bool)
        for b in self.begins[1:-1].tolist():
            ok[max(0, b - size + 1) : b] = False
        return ok

    def runs(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all runs of ``size`` words, and whether each lies within one text."""
        hashes = rolling(self.numbers, size)
        return hashes, self.fits(len(hashes), size)

    def wide_runs(self, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The same with 128-bit hashes, as two independent halves."""
        hashes, ok = self.runs(size)
        return hashes, rolling(numbers(self.body, self.start, self.end, 2), size), ok

    def anchored(self, n: int, size: int) -> np.ndarray:
        """Whether a run at each of the first n places begins at a multiple of ``size`` in its text."""
        sizes = np.diff(self.begins)
        place = np.arange(int(self.begins[-1])) - np.repeat(self.begins[:-1], sizes)
        return place[:n] % size == 0
