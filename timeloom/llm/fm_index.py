"""An FM-index over integer symbols: suffix order, wavelet-matrix ranks and sampled suffix positions.

Symbol 0 ends a run. Ends sort before all words and among themselves by position, so no
suffix comparison and no backward walk passes the border between two runs.
"""

from __future__ import annotations

import numpy as np

U = np.uint64


def suffix_order(sym: np.ndarray) -> np.ndarray:
    """Ranks of all suffixes of ``sym``, which has to end with 0; prefix doubling on what is still tied."""
    n = len(sym)
    pos_bits = max(1, (n + 1).bit_length())
    sym_bits = max(1, int(sym.max()).bit_length())
    step = max(1, (63 - pos_bits) // sym_bits)
    key, alive, digit = sym.astype(np.int64), sym != 0, sym.astype(np.int64)
    used = 1
    while used < step and alive.any():
        digit = np.append(digit[1:], 0)
        here = np.where(alive, digit, 0)
        key = (key << sym_bits) | here
        alive = alive & (here != 0)
        used += 1
    packed = np.sort((key << pos_bits) | np.arange(n))
    order, key = packed & ((1 << pos_bits) - 1), packed >> pos_bits
    head = np.empty(n, bool)
    head[0] = True
    head[1:] = (key[1:] != key[:-1]) | ~alive[order[1:]]
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    tied = order[~(head & np.append(head[1:], True))]
    h = used
    while len(tied):
        mine, later = rank[tied], rank[tied + h]
        if 3 * pos_bits <= 63:
            packed = np.sort((mine << (2 * pos_bits)) | (later << pos_bits) | tied)
            tied = packed & ((1 << pos_bits) - 1)
            pair = packed >> pos_bits
            mine = packed >> (2 * pos_bits)
            new = pair[1:] != pair[:-1]
        else:
            by = np.lexsort((later, mine))
            tied, mine, later = tied[by], mine[by], later[by]
            new = (mine[1:] != mine[:-1]) | (later[1:] != later[:-1])
        at = np.arange(len(tied))
        head = np.concatenate([[True], new])
        bucket = np.concatenate([[True], mine[1:] != mine[:-1]])
        rank[tied] = mine + np.maximum.accumulate(np.where(head, at, 0)) - np.maximum.accumulate(np.where(bucket, at, 0))
        tied = tied[~(head & np.append(head[1:], True))]
        h *= 2
    return rank


class Bits:
    """A bit vector with rank: 64-bit words and the ones before each."""

    def __init__(self, bits: np.ndarray):
        self.words = np.packbits(np.append(bits, np.zeros(64 - len(bits) % 64 + 64, bool)), bitorder="little").view(U)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)])

    def rank1(self, i: np.ndarray) -> np.ndarray:
        w = i >> 6
        return self.before[w] + np.bitwise_count(self.words[w] & ((U(1) << (i & 63).astype(U)) - U(1))).astype(np.int64)

    def get(self, i: np.ndarray) -> np.ndarray:
        return ((self.words[i >> 6] >> (i & 63).astype(U)) & U(1)).astype(bool)


class FMIndex:
    def __init__(self, sym: np.ndarray, sample: int = 16):
        self.n = n = len(sym)
        rank = suffix_order(sym)
        bwt = np.empty(n, np.int64)
        bwt[rank] = np.concatenate([sym[-1:], sym[:-1]])
        counts = np.bincount(sym)
        self.smaller = np.concatenate([[0], np.cumsum(counts)])
        kept = (np.arange(n) % sample == 0) | (np.concatenate([[0], sym[:-1]]) == 0)
        marked = np.zeros(n, bool)
        marked[rank[kept]] = True
        where = np.empty(n, np.int64)
        where[rank] = np.arange(n)
        self.marked, self.sampled = Bits(marked), where[marked]
        self.levels: list[tuple[int, Bits, int]] = []
        for shift in range(max(1, int(sym.max()).bit_length()) - 1, -1, -1):
            ones = (bwt >> shift) & 1 == 1
            self.levels.append((shift, Bits(ones), n - int(ones.sum())))
            bwt = np.concatenate([bwt[~ones], bwt[ones]])
        self.first = np.searchsorted(_wavelet_keys(bwt, self.levels), _wavelet_keys(np.arange(len(counts)), self.levels))

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often each symbol stands in the first i places of the transform."""
        for shift, bits, zeros in self.levels:
            ones = bits.rank1(i)
            i = np.where((symbol >> shift) & 1 == 1, zeros + ones, i - ones)
        return i - self.first[symbol]

    def find(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row intervals of patterns of one length (a matrix): backward search, all patterns at once."""
        lo, hi = np.zeros(len(patterns), np.int64), np.zeros(len(patterns), np.int64)
        known = (patterns < len(self.smaller) - 1).all(axis=1)
        live = np.flatnonzero(known)
        lo[live], hi[live] = 0, self.n
        for column in range(patterns.shape[1] - 1, -1, -1):
            c = patterns[live, column]
            lo[live] = self.smaller[c] + self.rank(c, lo[live])
            hi[live] = self.smaller[c] + self.rank(c, hi[live])
            live = live[lo[live] < hi[live]]
        return lo, np.maximum(hi, lo)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows: backwards until a sampled suffix."""
        rows, out = rows.copy(), np.zeros(len(rows), np.int64)
        live, steps = np.arange(len(rows)), 0
        while len(live):
            there = self.marked.get(rows[live])
            done = live[there]
            out[done] = self.sampled[self.marked.rank1(rows[done])] + steps
            live = live[~there]
            i, symbol = rows[live], np.zeros(len(live), np.int64)
            for _, bits, zeros in self.levels:
                one, ones = bits.get(i), bits.rank1(i)
                i = np.where(one, zeros + ones, i - ones)
                symbol = (symbol << 1) | one
            rows[live] = self.smaller[symbol] + i - self.first[symbol]
            steps += 1
        return out


def _wavelet_keys(symbols: np.ndarray, levels: list) -> np.ndarray:
    """The order in which the last level of a wavelet matrix holds symbols: by their bits from the lowest."""
    key = np.zeros(len(symbols), np.int64)
    for shift, _, _ in levels:
        key |= ((symbols >> shift) & 1) << (len(levels) - 1 - shift)
    return key
