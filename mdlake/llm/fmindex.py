"""An FM-index over a sequence of symbols: suffix array, wavelet matrix, backward search, sampled positions."""

from __future__ import annotations

import numpy as np

_SAMPLE = 8  # every eighth position is stored


def suffix_array(text: np.ndarray) -> np.ndarray:
    """By prefix doubling; only suffixes whose rank is still shared are sorted again. The last symbol must be unique and least."""
    n = len(text)
    order = np.argsort(text, kind="stable")
    ranks = np.empty(n, np.int64)
    new = np.ones(n, bool)
    new[1:] = text[order[1:]] != text[order[:-1]]
    ranks[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    step = 1
    while True:
        at = ranks[order]
        shared = np.zeros(n, bool)
        same = at[1:] == at[:-1]
        shared[1:] |= same
        shared[:-1] |= same
        open_ = np.flatnonzero(shared)
        if not len(open_):
            return order
        suffix = order[open_]
        following = ranks[suffix + step]
        by = np.lexsort((following, at[open_]))
        suffix, following, at = suffix[by], following[by], at[open_][by]
        order[open_] = suffix
        new = np.ones(len(open_), bool)
        new[1:] = (at[1:] != at[:-1]) | (following[1:] != following[:-1])
        ranks[suffix] = np.maximum.accumulate(np.where(new, open_, 0))
        step *= 2


class FMIndex:
    """Counts and locates phrases in runs of symbols 1 .. sigma - 1; no phrase reaches from one run into the next.

    Runs are laid out one after another, each with a separator in front. Separators differ from one another while suffixes
    are sorted, so that equal runs are told apart by the end of the run; in the index they are one symbol, 0.
    """

    def __init__(self, symbols: np.ndarray, starts: np.ndarray, sigma: int):
        """``starts``: first positions of the runs in ``symbols``."""
        runs, n = len(starts), len(symbols)
        text = np.empty(n + runs + 1, np.int64)
        place = np.arange(n) + np.searchsorted(starts, np.arange(n), "right")  # where each symbol goes
        separator = np.ones(len(text), bool)
        separator[place] = False
        where = np.flatnonzero(separator)
        text[place] = symbols + runs
        text[where] = np.arange(runs, -1, -1)
        order = suffix_array(text)
        before = text[order - 1]
        self.bwt = np.where(before <= runs, 0, before - runs)
        plain = np.where(separator, 0, text - runs)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(plain, minlength=sigma))])
        self.origin = np.full(len(text), -1, np.int64)
        self.origin[place] = np.arange(n)
        first_of_run = np.zeros(len(text), bool)
        first_of_run[place[starts]] = True
        self.sampled = (order % _SAMPLE == 0) | first_of_run[order]
        self.position = np.where(self.sampled, order, -1)[self.sampled]
        self.sample_rank = np.cumsum(self.sampled) - 1
        self._wavelet(max(1, int(sigma - 1).bit_length()))

    def _wavelet(self, levels: int) -> None:
        self.ones, self.zeros, row = [], [], self.bwt
        for level in range(levels - 1, -1, -1):
            bit = (row >> level) & 1
            self.ones.append(np.concatenate([[0], np.cumsum(bit)]))
            self.zeros.append(int(len(row) - bit.sum()))
            row = np.concatenate([row[bit == 0], row[bit == 1]])

    def rank(self, symbol: np.ndarray, row: np.ndarray) -> np.ndarray:
        """How often each symbol occurs in the first ``row`` rows of the transform."""
        start = np.zeros(len(symbol), np.int64)
        levels = len(self.ones)
        for k, (ones, zeros) in enumerate(zip(self.ones, self.zeros)):
            bit = ((symbol >> (levels - 1 - k)) & 1).astype(bool)
            start = np.where(bit, zeros + ones[start], start - ones[start])
            row = np.where(bit, zeros + ones[row], row - ones[row])
        return row - start

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges of phrases of one length (rows of a matrix), by backward search of all at once."""
        low = np.zeros(len(phrases), np.int64)
        high = np.full(len(phrases), len(self.bwt), np.int64)
        live = np.arange(len(phrases))
        for k in range(phrases.shape[1] - 1, -1, -1):
            symbol = phrases[live, k]
            low[live] = self.first[symbol] + self.rank(symbol, low[live])
            high[live] = self.first[symbol] + self.rank(symbol, high[live])
            live = live[low[live] < high[live]]
        return low, high

    def locate(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index of the phrase, position in ``symbols``) of every occurrence."""
        size = np.maximum(high - low, 0)
        phrase = np.repeat(np.arange(len(low)), size)
        row = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + low[phrase]
        position, steps, todo = np.zeros(len(row), np.int64), np.zeros(len(row), np.int64), np.arange(len(row))
        while len(todo):
            done = self.sampled[row[todo]]
            hit = todo[done]
            position[hit] = self.position[self.sample_rank[row[hit]]] + steps[hit]
            todo = todo[~done]
            symbol = self.bwt[row[todo]]
            row[todo] = self.first[symbol] + self.rank(symbol, row[todo])
            steps[todo] += 1
        return phrase, self.origin[position]
