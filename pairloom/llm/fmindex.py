"""A compressed FM-index over word ids: wavelet matrix of packed bits, backward search, matching statistics.

All methods work on arrays of lanes, one lane a query, so that a step of thousands of searches is a few
NumPy calls.
"""

from __future__ import annotations

import numpy as np

SEPARATOR = 0


class Bits:
    """A packed bit vector with ranks: one bit a place, and one count for each 64 of them."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits, bitorder="little")
        self.words = np.concatenate([packed, np.zeros(16 - len(packed) % 8, np.uint8)])[: (len(packed) // 8 + 1) * 8].view(np.uint64)
        ones = np.bitwise_count(self.words).astype(np.int64)
        self.before = (np.cumsum(ones) - ones).astype(np.int32)

    def ones(self, i: np.ndarray) -> np.ndarray:
        """How many bits are set before place i."""
        word = i >> 6
        low = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & low)


class WaveletMatrix:
    """rank(c, i): how often symbol c occurs before i, by one bit vector for each bit of a symbol."""

    def __init__(self, symbols: np.ndarray, n_symbols: int):
        self.n, self.levels = len(symbols), max(1, int(n_symbols - 1).bit_length())
        self.bits, self.zeros = [], []
        now = symbols.astype(np.uint32)
        for level in reversed(range(self.levels)):
            bits = (now >> np.uint32(level) & np.uint32(1)).astype(bool)
            self.bits.append(Bits(bits))
            self.zeros.append(int(self.n - bits.sum()))
            now = np.concatenate([now[~bits], now[bits]])

    def narrow(self, c: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """rank(c, lo), rank(c, hi) by lane; the third is where c's block starts in the last level."""
        lanes = len(c)
        start, at = np.zeros(lanes, np.int64), np.concatenate([lo, hi])
        for level in range(self.levels):
            one = (c >> np.uint32(self.levels - 1 - level) & np.uint32(1)).astype(bool)
            ones = self.bits[level].ones(np.concatenate([at, start])).astype(np.int64)
            two = np.concatenate([one, one])
            at = np.where(two, self.zeros[level] + ones[: 2 * lanes], at - ones[: 2 * lanes])
            start = np.where(one, self.zeros[level] + ones[2 * lanes :], start - ones[2 * lanes :])
        return at[:lanes] - start, at[lanes:] - start, start


class FmIndex:
    """Index of texts, each an array of word ids from 1; `depth` is the threshold of the matching statistics."""

    def __init__(self, texts: list[np.ndarray], n_symbols: int, depth: int, owner: np.ndarray | None = None):
        sizes = np.array([len(t) + 1 for t in texts])
        whole = np.zeros(int(sizes.sum()), np.int64)
        whole[np.arange(len(whole)) != np.repeat(np.cumsum(sizes) - 1, sizes)] = np.concatenate(texts)
        n = len(whole)
        rank, width, ranks = whole.copy(), 1, {1: whole}
        while True:  # prefix doubling; equal ranks mean equal first `width` symbols
            nxt = np.zeros(n, np.int64)
            nxt[: n - width] = rank[width:] + 1
            both = rank * (int(rank.max()) + 2) + nxt if width > 1 else rank * (n_symbols + 2) + nxt
            sa = np.argsort(both, kind="stable")
            new = np.concatenate([[0], np.cumsum(both[sa][1:] != both[sa][:-1])])
            rank = np.empty(n, np.int64)
            rank[sa] = new
            width *= 2
            if width <= depth:
                ranks[width] = rank
            if new[-1] == n - 1:
                break
            if width > 2 * n:
                raise AssertionError("suffixes do not settle")
        half = max(w for w in ranks if w <= depth)
        tail = np.full(n, -1, np.int64)
        tail[: n - (depth - half)] = ranks[half][depth - half :]
        a, b = ranks[half][sa], tail[sa]
        #: rows whose suffixes share their first `depth` words form one run
        begins = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
        self.run_bits, self.run_first = Bits(begins), np.flatnonzero(begins)
        self.run_end = np.append(self.run_first[1:], n)
        self.depth, self.n = depth, n
        bwt = whole[sa - 1]
        self.first = np.concatenate([[0], np.cumsum(np.bincount(bwt, minlength=n_symbols))])
        self.tree = WaveletMatrix(bwt, n_symbols)
        if owner is not None:
            self.run_least = np.minimum.reduceat(np.repeat(owner, sizes)[sa], self.run_first)

    def extend(self, c: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One step of backward search: the rows of c followed by what [lo, hi) matches."""
        a, b, _ = self.tree.narrow(c.astype(np.uint32), lo, hi)
        return self.first[c] + a, self.first[c] + b

    def runs(self, queries: list[np.ndarray]) -> list[np.ndarray]:
        """For each query and window start, the run of rows whose suffixes begin with the window's `depth` words, or -1.

        Matching statistics capped at `depth`, from right to left: a full match is widened to its run and
        extended by the word before; where that fails, the window before is searched afresh.
        """
        flat = np.concatenate(queries)
        base = np.cumsum([0] + [len(q) for q in queries[:-1]])
        out = [np.full(max(0, len(q) - self.depth + 1), -1, np.int64) for q in queries]
        out_base = np.cumsum([0] + [len(o) for o in out[:-1]])
        found = np.full(sum(map(len, out)), -1, np.int64)
        lane = np.flatnonzero([len(o) > 0 for o in out])
        p = np.array([len(out[k]) - 1 for k in lane], np.int64)  # the window sought
        got = np.zeros(len(lane), np.int64)  # words matched of it, from its right end
        lo, hi = np.zeros(len(lane), np.int64), np.full(len(lane), self.n, np.int64)
        while len(lane):
            grown = got == self.depth  # [lo, hi) matches window p + 1
            c = flat[base[lane] + np.where(grown, p, p + self.depth - 1 - got)]
            lo, hi = self.extend(c, lo, hi)
            there = hi > lo
            full = there & (grown | (got + 1 == self.depth))
            run = self.run_bits.ones(np.where(full, lo, 0) + 1).astype(np.int64) - 1
            found[(out_base[lane] + p)[full]] = run[full]
            lo, hi = np.where(full, self.run_first[run], lo), np.where(full, self.run_end[run], hi)
            miss = ~there
            p = p - (full | (miss & ~grown))
            got = np.where(full, self.depth, np.where(miss, 0, got + 1))
            lo, hi = np.where(miss, 0, lo), np.where(miss, self.n, hi)
            on = p >= 0
            if not on.all():
                lane, p, got, lo, hi = lane[on], p[on], got[on], lo[on], hi[on]
        return np.split(found, np.cumsum([len(o) for o in out])[:-1])

    def least_owner(self, queries: list[np.ndarray]) -> list[np.ndarray]:
        """For each query and window start, the least owner of a text that holds the window; -1 where none does."""
        return [np.where(r < 0, -1, self.run_least[r]) for r in self.runs(queries)]
