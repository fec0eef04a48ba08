"""An FM-index of a text of symbols, in numpy: all patterns take each backward step together.

Symbols are integers over 0; 0 ends a run, and no pattern has it. Each 0 is a terminator of its own (they are ordered by position), so
suffixes need only be compared up to their next 0. Ranks come from a wavelet matrix whose bits are packed in 64-bit words. Suffix positions
are sampled at each start of a run and at every RATE-th place of it, so the walk from a row to a sampled one never steps over a 0.
"""

from __future__ import annotations

import numpy as np

RATE = 16


class Bits:
    """A bit string with rank: the ones before a place."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits, bitorder="little")
        self.words = np.append(packed, np.zeros(-len(packed) % 8 + 8, np.uint8)).view("<u8")
        self.before = np.append(0, np.cumsum(np.bitwise_count(self.words), dtype=np.int64))[:-1].astype(np.int32)

    def rank(self, at: np.ndarray) -> np.ndarray:
        low = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        word = at >> 6
        return self.before[word] + np.bitwise_count(self.words[word] & low)

    def get(self, at: np.ndarray) -> np.ndarray:
        return (self.words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) != 0


class WaveletMatrix:
    """Ranks of symbols in a sequence: one bit string for each bit of a symbol, the highest first, zeros before ones in the next."""

    def __init__(self, symbols: np.ndarray, largest: int):
        self.depth = max(1, int(largest).bit_length())
        self.levels: list[tuple[Bits, int]] = []
        for k in range(self.depth - 1, -1, -1):
            bits = (symbols >> k & 1).astype(bool)
            self.levels.append((Bits(bits), len(bits) - int(bits.sum())))
            symbols = np.concatenate([symbols[~bits], symbols[bits]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often symbol[i] stands before at[i]."""
        start = np.zeros_like(at)
        for k, (bits, zeros) in zip(range(self.depth - 1, -1, -1), self.levels, strict=True):
            one = (symbol >> k & 1).astype(bool)
            a, b = bits.rank(at), bits.rank(start)
            at, start = np.where(one, zeros + a, at - a), np.where(one, zeros + b, start - b)
        return at - start

    def symbol_and_rank(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each place, and how often it stands before."""
        symbol, start = np.zeros_like(at), np.zeros_like(at)
        for bits, zeros in self.levels:
            one = bits.get(at)
            a, b = bits.rank(at), bits.rank(start)
            at, start = np.where(one, zeros + a, at - a), np.where(one, zeros + b, start - b)
            symbol = symbol << 1 | one
        return symbol, at - start


def suffix_order(text: np.ndarray, largest: int) -> np.ndarray:
    """Where suffixes begin, in their order. text ends with 0. Prefix doubling over what is not yet told apart."""
    n, bits = len(text), max(1, int(largest).bit_length())
    depth = max(1, 62 // bits)
    key, open_, next_ = text.astype(np.int64), text != 0, text.astype(np.int64)
    for _ in range(depth - 1):
        next_ = np.where(open_, np.append(next_[1:], 0), 0)
        key = key << bits | next_
        open_ = next_ != 0
    order = np.argsort(key, kind="stable")
    sorted_key, unended = key[order], open_[order]
    # of suffixes with the same key those that met a 0 are told apart by position, which the stable sort has done
    new = np.append(True, (sorted_key[1:] != sorted_key[:-1]) | ~unended[1:])
    group = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank = np.empty(n, np.int64)
    rank[order] = group
    first = np.append(np.flatnonzero(new), n)
    left = np.flatnonzero(np.repeat(np.diff(first) > 1, np.diff(first)))  # rows whose group has others
    while len(left):
        own = order[left]
        both = rank[own] * n + rank[own + depth]
        again = np.argsort(both, kind="stable")
        own, both = own[again], both[again]
        order[left] = own
        new = np.append(True, both[1:] != both[:-1])
        group = left[np.maximum.accumulate(np.where(new, np.arange(len(left)), 0))]
        rank[own] = group
        first = np.append(np.flatnonzero(new), len(left))
        left = left[np.repeat(np.diff(first) > 1, np.diff(first))]
        depth *= 2
    return order


class FMIndex:
    def __init__(self, text: np.ndarray, largest: int):
        """text: symbols up to largest; its last one is 0."""
        order = suffix_order(text, largest)
        self.bwt = WaveletMatrix(text[order - 1], largest)  # the first place is preceded by the last, which is 0
        self.first = np.append(0, np.cumsum(np.bincount(text, minlength=largest + 1)))  # rows that begin with a smaller symbol
        zero = text == 0
        start = np.append(True, zero[:-1])
        place = np.arange(len(text)) - np.maximum.accumulate(np.where(start, np.arange(len(text)), 0))
        sampled = (place % RATE == 0)[order]
        self.marks, self.samples, self.rows = Bits(sampled), order[sampled].astype(np.int32), len(text)

    def find(self, patterns: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows [low, high) whose suffixes begin with patterns[i, :sizes[i]]; sizes are at least 1."""
        low, high = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.rows, np.int64)
        for back in range(1, patterns.shape[1] + 1 if len(patterns) else 0):
            live = np.flatnonzero((sizes >= back) & (low < high))
            if not len(live):
                break
            symbol = patterns[live, sizes[live] - back]
            ranks = self.bwt.rank(np.tile(symbol, 2), np.concatenate([low[live], high[live]])).reshape(2, -1)
            low[live], high[live] = self.first[symbol] + ranks
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Where the suffixes of rows begin, by steps back to a sampled row."""
        out, at, walking = np.zeros(len(rows), np.int64), rows.astype(np.int64), np.arange(len(rows))
        steps = 0
        while len(walking):
            done = self.marks.get(at)
            out[walking[done]] = self.samples[self.marks.rank(at[done])] + steps
            walking, at = walking[~done], at[~done]
            symbol, rank = self.bwt.symbol_and_rank(at)
            at = self.first[symbol] + rank
            steps += 1
        return out
