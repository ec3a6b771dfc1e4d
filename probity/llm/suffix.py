"""Suffix arrays, common-prefix intervals and an FM-index over integer sequences, all with numpy."""

from __future__ import annotations

import numpy as np


class SuffixArray:
    """Suffix array by prefix doubling; only suffixes that still tie are sorted again. A suffix's rank is the first place of
    its group of ties; each level's ranks are kept, 4 bytes a symbol, so that common prefixes are found without reading the text again.
    Levels are the binary logarithm of the longest repeat."""

    def __init__(self, seq: np.ndarray):
        n = self.n = len(seq)
        self.levels: list[np.ndarray] = []
        self.order = order = np.argsort(seq)
        if n == 0:
            return
        value = seq[order]
        head = np.concatenate(([True], value[1:] != value[:-1]))
        rank = np.empty(n, np.int32)
        rank[order] = np.maximum.accumulate(np.where(head, np.arange(n), 0))
        self.levels.append(rank)
        tied, h = np.flatnonzero(~head | ~np.append(head[1:], True)), 1
        while len(tied):
            sub = order[tied]
            after = sub + h
            key = rank[sub].astype(np.int64) * (n + 1) + np.where(after < n, rank[np.minimum(after, n - 1)] + 1, 0)
            by = np.argsort(key)
            key, sub = key[by], sub[by]
            order[tied] = sub
            head = np.concatenate(([True], key[1:] != key[:-1]))
            rank = rank.copy()
            rank[sub] = np.maximum.accumulate(np.where(head, tied, 0))
            self.levels.append(rank)
            tied = tied[~head | ~np.append(head[1:], True)]
            h *= 2

    def common_prefixes(self, least: int = 1) -> np.ndarray:
        """lcp[i]: common prefix of the i-th and (i-1)-th suffix in order; 0 where it is known to be below `least`."""
        lcp = np.zeros(self.n, np.int64)
        if self.n < 2:
            return lcp
        a, b = self.order[:-1], self.order[1:]
        known = min(least.bit_length() - 1, len(self.levels) - 1)
        pairs = np.flatnonzero(self.levels[known][a] == self.levels[known][b])
        a, b, found = a[pairs].copy(), b[pairs].copy(), np.zeros(len(pairs), np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            i = np.flatnonzero(np.maximum(a, b) + (1 << k) <= self.n)  # equal ranks then mean equal blocks of 2^k symbols
            same = i[self.levels[k][a[i]] == self.levels[k][b[i]]]
            a[same] += 1 << k
            b[same] += 1 << k
            found[same] += 1 << k
        lcp[1:][pairs] = found
        return lcp


def interval_tree(lcp: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(length, first, last, parent) of the nodes of the common-prefix interval tree with length >= least, parents before children, and
    the innermost node of each suffix; -1 where there is none.

    One scan over the enhanced suffix array with a stack of open intervals tells parents as well; parts whose common prefix is shorter
    than `least` are skipped without entering the scan.
    """
    length: list[int] = []
    first: list[int] = []
    last: list[int] = []
    parent: list[int] = []
    top = np.full(len(lcp) + 1, -1, np.int64)  # the node that holds suffixes i - 1 and i
    deep = lcp >= least
    edges = np.flatnonzero(np.diff(np.concatenate(([0], deep.astype(np.int8), [0]))))
    for s, e in zip(edges[::2].tolist(), edges[1::2].tolist()):
        stack: list[int] = []
        held = []
        for i, v in enumerate([*lcp[s:e].tolist(), 0], s):
            left, child = i - 1, -1
            while stack and length[stack[-1]] > v:
                child = stack.pop()
                last[child], left = i - 1, first[child]
                if stack and length[stack[-1]] >= v:
                    parent[child], child = stack[-1], -1
            if v and (not stack or length[stack[-1]] < v):
                if child >= 0:
                    parent[child] = len(length)
                stack.append(len(length))
                length.append(v)
                first.append(left)
                last.append(-1)
                parent.append(-1)
            held.append(stack[-1] if stack else -1)
        top[s : e + 1] = held
    up = np.array(parent, np.int64)
    by = np.lexsort((-np.array(last, np.int64), np.array(first, np.int64)))
    name = np.full(len(by) + 1, -1, np.int64)  # the last one stands for none
    name[by] = np.arange(len(by))
    depth = np.append(lcp, 0)
    inner = name[np.where(depth[:-1] >= depth[1:], top[:-1], top[1:])]
    return np.array(length, np.int64)[by], np.array(first, np.int64)[by], np.array(last, np.int64)[by], name[up[by]], inner


def repeat_tree(seq: np.ndarray, least: int, separator: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """interval_tree without nodes whose occurrences all have one symbol on their left, and the suffix order. What holds a node left
    in the tree has more on its left, so it stays as well, and a suffix's node is the innermost that stays."""
    sa = SuffixArray(seq)
    length, first, last, parent, inner = interval_tree(sa.common_prefixes(least), least)
    before = np.where(sa.order > 0, seq[np.maximum(sa.order - 1, 0)], separator - 1)
    own = before <= separator
    change = np.concatenate(([0], np.cumsum((before[1:] != before[:-1]) | own[1:] | own[:-1])))
    stays = change[last] > change[first]
    new = np.append(np.where(stays, np.cumsum(stays) - 1, -1), -1)
    for k in np.flatnonzero(~stays).tolist():  # parents come first
        new[k] = new[parent[k]]
    return length[stays], first[stays], last[stays], new[parent[stays]], new[inner], sa.order


def maximal_repeats(seq: np.ndarray, least: int, separator: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All maximal repeats of at least `least` symbols: (length, first, last) and the suffix order they refer to.

    The occurrences of repeat k are order[first[k] : last[k] + 1], all of them. An interval is reported when its occurrences
    differ in the symbol to their left (a text start or a separator counts as a symbol of its own); to the right they
    differ because the interval ends there. Separators are distinct values up to `separator`, so that no repeat crosses one.
    """
    length, first, last, _, _, order = repeat_tree(seq, least, separator)
    return length, first, last, order


def ranges(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... for size[0] places, then on from first[1], and so on."""
    return np.repeat(first - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(int(size.sum()))


class FMIndex:
    """FM-index of a sequence over 1..sigma-1: wavelet-matrix ranks, sampled suffix positions. 0 is the terminator."""

    def __init__(self, seq: np.ndarray, sigma: int, every: int = 8):
        text = np.concatenate((np.asarray(seq, np.int64), [0]))
        self.n, self.every = len(text), every
        sa = SuffixArray(text).order
        self.bwt = text[sa - 1]
        self.starts = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=sigma))))
        self.bits = max(1, (max(1, sigma - 1)).bit_length())
        self.ranks, self.zeros, cur = [], [], self.bwt
        for k in range(self.bits - 1, -1, -1):
            bit = (cur >> k) & 1
            self.ranks.append(np.concatenate(([0], np.cumsum(bit))).astype(np.int32))
            self.zeros.append(int(self.n - bit.sum()))
            cur = np.concatenate((cur[bit == 0], cur[bit == 1]))
        # where each symbol's block begins in the bottom level
        first = np.zeros(sigma, np.int64)
        syms = np.arange(sigma)
        self._first = self._descend(syms, first)
        marked = sa % every == 0
        self.mark = np.concatenate(([0], np.cumsum(marked)))
        self.sampled = sa[marked]
        self.is_marked = marked

    def _descend(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        at = at.astype(np.int64)
        for level, k in enumerate(range(self.bits - 1, -1, -1)):
            ones = self.ranks[level][at]
            at = np.where((symbols >> k) & 1 == 1, self.zeros[level] + ones, at - ones)
        return at

    def rank(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs in the first `at` places of the transformed text."""
        return self._descend(symbols, at) - self._first[symbols]

    def find(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals [lo, hi) of all phrases (rows, right-aligned symbols) by backward search, all phrases in step."""
        lo, hi = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        width = phrases.shape[1]
        for step in range(width):
            live = np.flatnonzero((lengths > step) & (lo < hi))
            if not len(live):
                break
            sym = phrases[live, width - 1 - step]
            lo[live] = self.starts[sym] + self.rank(sym, lo[live])
            hi[live] = self.starts[sym] + self.rank(sym, hi[live])
        return lo, np.maximum(lo, hi)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows of the transformed text, by walking to the nearest sampled position."""
        at, steps, out = rows.astype(np.int64).copy(), np.zeros(len(rows), np.int64), np.empty(len(rows), np.int64)
        todo = np.arange(len(rows))
        while len(todo):
            hit = self.is_marked[at[todo]]
            done = todo[hit]
            out[done] = self.sampled[self.mark[at[done]]] + steps[done]
            todo = todo[~hit]
            sym = self.bwt[at[todo]]
            at[todo] = self.starts[sym] + self.rank(sym, at[todo])
            steps[todo] += 1
        return out
