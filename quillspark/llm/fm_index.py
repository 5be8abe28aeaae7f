"""FM-index over integer symbols: suffix order, Burrows-Wheeler transform in a wavelet matrix, sampled suffix positions."""

from __future__ import annotations

import numpy as np


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Start positions of the suffixes of ``text`` in order, by prefix doubling; symbols are at least 0.

    A round sorts only the suffixes whose place is still open: after a few words, those of repeats.
    """
    n = len(text)
    order = np.argsort(text, kind="stable")
    rank = np.empty(n, np.int64)  # the place where the suffix's group begins
    new = np.concatenate([[True], text[order[1:]] != text[order[:-1]]])[:n]
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    step = 1
    last = np.concatenate([new[1:], [True]])[:n]
    places = np.flatnonzero(~(new & last))  # places of groups with several members
    while len(places):
        own = order[places]
        behind = own + step
        key = rank[own] * (n + 1) + np.where(behind < n, rank[np.minimum(behind, n - 1)] + 1, 0)
        by = np.argsort(key, kind="stable")
        own, key = own[by], key[by]
        order[places] = own
        new = np.concatenate([[True], key[1:] != key[:-1]])
        rank[own] = places[np.maximum.accumulate(np.where(new, np.arange(len(own)), 0))]
        last = np.concatenate([new[1:], [True]])
        places = places[~(new & last)]
        step *= 2
    return order


class WaveletMatrix:
    """rank over a sequence of integers; one counted bit vector for each bit, highest first."""

    def __init__(self, symbols: np.ndarray):
        self.bits = max(1, int(symbols.max(initial=0)).bit_length())
        self.ones, self.zeros = [], []
        for b in range(self.bits - 1, -1, -1):
            bit = (symbols >> b) & 1
            self.ones.append(np.concatenate([[0], np.cumsum(bit, dtype=np.int32)]).astype(np.int32))
            self.zeros.append(len(symbols) - int(bit.sum()))
            symbols = np.concatenate([symbols[bit == 0], symbols[bit == 1]])

    def rank(self, symbol: np.ndarray, end: np.ndarray) -> np.ndarray:
        """How often ``symbol`` is among the first ``end``."""
        first, last = np.zeros_like(end), end
        for b, ones, zeros in zip(range(self.bits - 1, -1, -1), self.ones, self.zeros, strict=True):
            one = (symbol >> b) & 1 == 1
            first = np.where(one, zeros + ones[first], first - ones[first])
            last = np.where(one, zeros + ones[last], last - ones[last])
        return last - first

    def access(self, at: np.ndarray) -> np.ndarray:
        symbol = np.zeros_like(at)
        for ones, zeros in zip(self.ones, self.zeros, strict=True):
            one = ones[at + 1] - ones[at]
            symbol = symbol * 2 + one
            at = np.where(one == 1, zeros + ones[at], at - ones[at])
        return symbol


class FMIndex:
    """Index of several runs of symbols (each at least 1); a match never crosses from run to run."""

    def __init__(self, runs: list[np.ndarray], sample: int = 8):
        lengths = np.array([len(r) for r in runs], np.int64)
        n_runs = len(runs)
        self.starts = np.cumsum(lengths + 1) - lengths - 1  # a separator follows each run
        text = np.zeros(int((lengths + 1).sum()), np.int64)
        inside = np.ones(len(text), bool)
        inside[self.starts + lengths] = False
        text[inside] = np.concatenate(runs) if runs else []
        apart = text + n_runs  # separators differ, so that order is decided within a run
        apart[~inside] = np.arange(n_runs)
        order = suffix_order(apart)
        self.n = len(text)
        self.bwt = WaveletMatrix(text[order - 1])
        self.before = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=1))])  # symbols less than each
        begins = np.zeros(len(text), bool)
        begins[self.starts[lengths >= 0]] = True
        kept = (order % sample == 0) | begins[order]  # a walk back never leaves its run
        self.kept = np.concatenate([[0], np.cumsum(kept)])
        self.positions = order[kept]

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last-exclusive rows for each row of ``patterns`` (all of one length), by backward search."""
        first = np.zeros(len(patterns), np.int64)
        last = np.full(len(patterns), self.n, np.int64)
        live = np.arange(len(patterns))
        top = len(self.before) - 1
        for column in range(patterns.shape[1] - 1, -1, -1):
            symbol = patterns[live, column]
            known = symbol < top
            low = self.before[np.where(known, symbol, 0)]
            first[live] = low + self.bwt.rank(symbol, first[live])
            last[live] = np.where(known, low + self.bwt.rank(symbol, last[live]), first[live])
            live = live[last[live] > first[live]]
        last = np.maximum(last, first)
        dead = np.ones(len(patterns), bool)
        dead[live] = False
        last[dead] = first[dead]
        return first, last

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of ``rows``: walk back to a sampled suffix, counting the steps."""
        out, rows, todo, steps = np.zeros(len(rows), np.int64), rows.copy(), np.arange(len(rows)), 0
        while len(todo):
            at = rows[todo]
            sampled = self.kept[at + 1] > self.kept[at]
            out[todo[sampled]] = self.positions[self.kept[at[sampled]]] + steps
            todo, at = todo[~sampled], at[~sampled]
            symbol = self.bwt.access(at)
            rows[todo] = self.before[symbol] + self.bwt.rank(symbol, at)
            steps += 1
        return out
