"""An FM-index over integer symbols: suffix array, Burrows-Wheeler transform, wavelet matrix, sampled positions.

Symbol 0 separates; no pattern holds it. All separators are distinct for the order of suffixes, the earlier the smaller, so
that no comparison runs past one.
"""

from __future__ import annotations

import numpy as np

SAMPLE = 8


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Suffixes in order, by doubling; after each round only the suffixes that still tie are sorted again."""
    n = len(symbols)
    separators = np.flatnonzero(symbols == 0)
    first = symbols.astype(np.int64) + len(separators)
    first[separators] = np.arange(len(separators))
    order = np.argsort(first, kind="stable")
    rank = np.empty(n + 1, dtype=np.int64)
    rank[n] = -1

    def ranked(key: np.ndarray, base: np.ndarray) -> np.ndarray:
        fresh = np.ones(len(key), dtype=bool)
        fresh[1:] = key[1:] != key[:-1]
        return base[np.maximum.accumulate(np.where(fresh, np.arange(len(key)), 0))]

    rank[order] = ranked(first[order], np.arange(n))
    step = 1
    active = np.arange(n)  # places in ``order`` that tie with a neighbour
    while True:
        r = rank[order[active]]
        tie = np.zeros(len(active), dtype=bool)
        same = r[1:] == r[:-1]
        tie[1:] |= same
        tie[:-1] |= same
        active = active[tie]
        if not len(active):
            return order
        suffixes = order[active]
        key = rank[suffixes] * (n + 1) + rank[np.minimum(suffixes + step, n)] + 1
        by = np.argsort(key, kind="stable")
        suffixes, key = suffixes[by], key[by]
        order[active] = suffixes
        rank[suffixes] = ranked(key, active)
        step *= 2


class BitVector:
    """Bits with the number of ones before any place."""

    def __init__(self, bits: np.ndarray) -> None:
        padded = np.zeros((len(bits) // 64 + 1) * 64, dtype=np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)])[:-1].astype(np.int32)

    def ones(self, place: np.ndarray) -> np.ndarray:
        word = place >> 6
        mask = (np.uint64(1) << (place & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & mask)

    def get(self, place: np.ndarray) -> np.ndarray:
        return (self.words[place >> 6] >> (place & 63).astype(np.uint64)) & np.uint64(1)


class WaveletMatrix:
    """Ranks of symbols in a sequence, one bit vector for each bit of the alphabet."""

    def __init__(self, symbols: np.ndarray, alphabet: int) -> None:
        self.bits = max(1, int(alphabet - 1).bit_length())
        self.levels: list[BitVector] = []
        self.zeros: list[int] = []
        now = symbols
        for level in range(self.bits - 1, -1, -1):
            bit = ((now >> level) & 1).astype(bool)
            self.levels.append(BitVector(bit))
            self.zeros.append(int(len(bit) - bit.sum()))
            now = np.concatenate([now[~bit], now[bit]])
        self.start = np.searchsorted(now_keys(now, self.bits), now_keys(np.arange(1 << self.bits), self.bits)[: 1 << self.bits]) if len(now) else np.zeros(1 << self.bits, np.int64)

    def rank(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        """How often the symbol stands before the place."""
        at = place
        for k, level in enumerate(self.levels):
            one = ((symbol >> (self.bits - 1 - k)) & 1).astype(bool)
            ones = level.ones(at)
            at = np.where(one, self.zeros[k] + ones, at - ones)
        return at - self.start[symbol]

    def access(self, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at the place, and its rank there."""
        at, symbol = place, np.zeros(len(place), dtype=np.int64)
        for k, level in enumerate(self.levels):
            bit = level.get(at).astype(bool)
            ones = level.ones(at)
            at = np.where(bit, self.zeros[k] + ones, at - ones)
            symbol = (symbol << 1) | bit
        return symbol, at - self.start[symbol]


def now_keys(symbols: np.ndarray, bits: int) -> np.ndarray:
    """Bit-reversed symbols, the order in which the last level holds them."""
    out = np.zeros(len(symbols), dtype=np.int64)
    for b in range(bits):
        out = (out << 1) | ((symbols >> b) & 1)
    return out


class FMIndex:
    """Counts and locates patterns in a sequence of symbols from 0 to ``alphabet`` - 1."""

    def __init__(self, symbols: np.ndarray, alphabet: int, sample: int = SAMPLE) -> None:
        symbols = np.concatenate([symbols, [0]])
        order = suffix_array(symbols)
        bwt = symbols[order - 1]  # of the first suffix: the last symbol, a separator
        self.first = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=alphabet))])
        self.tree = WaveletMatrix(bwt, alphabet)
        # places after a separator are sampled too, so that no walk crosses one
        kept = (order % sample == 0) | (bwt == 0)
        self.sampled = BitVector(kept)
        self.positions = order[kept].astype(np.int32 if len(symbols) < 1 << 31 else np.int64)

    def search(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows [low, high) of each pattern, by backward search; patterns are aligned to the right."""
        n, width = patterns.shape
        low, high = np.zeros(n, np.int64), np.full(n, self.first[-1], np.int64)
        alive = np.flatnonzero(lengths > 0)
        for k in range(1, width + 1):
            alive = alive[(lengths[alive] >= k) & (low[alive] < high[alive])]
            if not len(alive):
                break
            symbol = patterns[alive, width - k]
            both = self.tree.rank(np.concatenate([symbol, symbol]), np.concatenate([low[alive], high[alive]]))
            low[alive] = self.first[symbol] + both[: len(alive)]
            high[alive] = self.first[symbol] + both[len(alive) :]
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """The positions of the suffixes at the rows, by walking back to a sampled one."""
        out = np.empty(len(rows), dtype=np.int64)
        todo, at, steps = np.arange(len(rows)), rows, 0
        while len(todo):
            hit = self.sampled.get(at).astype(bool)
            out[todo[hit]] = self.positions[self.sampled.ones(at[hit])] + steps
            todo, at = todo[~hit], at[~hit]
            if len(todo):
                symbol, rank = self.tree.access(at)
                at = self.first[symbol] + rank
                steps += 1
        return out
