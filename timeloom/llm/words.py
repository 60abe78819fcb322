"""Words of whole Arrow batches as numpy arrays: where they start and end, and a 64-bit hash of each."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

import numpy as np

U = np.uint64

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Digits, letters and everything beyond ASCII; A-Z count as they are lower-cased first.
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[65:91] = ALNUM[97:123] = ALNUM[128:] = True

#: Everything but space and the controls from tab to carriage return.
SPACED = np.ones(256, bool)
SPACED[[32, 9, 10, 11, 12, 13]] = False


class Words(NamedTuple):
    data: np.ndarray  # lower-cased bytes
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray  # of each row, and behind the last

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)


def find(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> Words:
    """Words never reach over the border between two rows."""
    inside = is_word[data]
    before = np.empty_like(inside)
    after = np.empty_like(inside)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    edges = offsets[(offsets > 0) & (offsets < len(data))]
    if len(data):
        before[0] = after[-1] = False
        before[edges] = after[edges - 1] = False
    start = np.flatnonzero(inside & ~before)
    end = np.flatnonzero(inside & ~after) + 1
    return Words(LOWER[data], start, end, np.searchsorted(start, offsets))


def mix(h: np.ndarray) -> np.ndarray:
    """The finaliser of SplitMix64."""
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


def other_mix(h: np.ndarray) -> np.ndarray:
    """The finaliser of MurmurHash3."""
    h = (h ^ (h >> U(33))) * U(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> U(33))) * U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> U(33))


def hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, mix: Callable[[np.ndarray], np.ndarray] = mix) -> np.ndarray:
    """Equal for equal byte strings, in any process: eight bytes at a time. Another ``mix`` gives other hashes."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray(len(data) + 1, "<u8", padded, 0, (1,))
    size = (end - start).astype(np.int64)
    h = mix(size.astype(U) + U(0x9E3779B97F4A7C15))
    live, at = None, 0
    while True:
        s, left = (start, size) if live is None else (start[live], size[live])
        left = left - at
        value = eight[s + at]
        short = np.maximum(8 - left, 0).astype(U) * U(8)
        value = np.where(short >= U(64), U(0), (value << (short & U(63))) >> (short & U(63)))
        if live is None:
            h = mix(h ^ value)
        else:
            h[live] = mix((h[live] + U(0x9E3779B97F4A7C15)) ^ value)
        at += 8
        longer = np.flatnonzero(left > 8)
        live = longer if live is None else live[longer]
        if not len(live):
            return h


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of k consecutive words, from each position that has k words after it in ``h``."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, U)
    out = np.zeros(n, U)
    for i in range(k):
        out = out * U(0xD6E8FEB86659FD93) + h[i : n + i]
    return mix(out)
