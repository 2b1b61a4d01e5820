"""A trie of number sequences in two arrays, BASE and CHECK."""

from __future__ import annotations

import numpy as np


class DoubleArrayTrie:
    """Children of a state s stand at ``base[s] + symbol`` with ``check`` equal to s; state 0 is the root.

    Built from sorted distinct prefixes: level by level, each state's children are put at the first base where
    all their places are free.  Symbols are dense numbers from 0.
    """

    def __init__(self, rows: list[np.ndarray]):
        """``rows[d]``: the d-th symbols of the sequences in lexicographic order that are longer than d, with their sequence: (2, n) arrays."""
        symbols = 1 + max((int(r[0].max()) for r in rows if r.shape[1]), default=0)
        self.base = np.zeros(1, dtype=np.int64)
        self.check = np.full(1 + symbols, -1, dtype=np.int64)
        self.check[0] = 0  # the root's own place
        self._free = 1
        state = np.zeros(1 + max((int(r[1].max()) for r in rows if r.shape[1]), default=0), dtype=np.int64)
        self.base.resize(len(self.check), refcheck=False)
        for symbol, sequence in rows:
            parent = state[sequence]
            new = np.append(True, (np.diff(parent) != 0) | (np.diff(symbol) != 0)) if len(symbol) else np.zeros(0, bool)
            starts = np.flatnonzero(new)
            owners, first = np.unique(parent[starts], return_index=True)
            order = np.argsort(first)
            bounds = np.append(first[order], len(starts))
            for owner, i, j in zip(owners[order].tolist(), bounds[:-1].tolist(), bounds[1:].tolist()):
                self._place(owner, symbol[starts[i:j]])
            state[sequence] = self.base[parent] + symbol

    def _place(self, owner: int, children: np.ndarray) -> None:
        least = int(children[0])
        while self._free < len(self.check) and self.check[self._free] >= 0:
            self._free += 1
        at = self._free
        while True:
            base = at - least
            need = base + int(children[-1]) + 1
            if need > len(self.check):
                grown = max(need, 2 * len(self.check))
                self.check = np.append(self.check, np.full(grown - len(self.check), -1, dtype=np.int64))
                self.base = np.append(self.base, np.zeros(grown - len(self.base), dtype=np.int64))
            if (self.check[base + children] < 0).all():
                break
            at += 1
            while at < len(self.check) and self.check[at] >= 0:
                at += 1
        self.base[owner] = base
        self.check[base + children] = owner

    def step(self, states: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        """The states that follow, -1 where there is none."""
        at = self.base[states] + symbols
        inside = (states >= 0) & (at >= 0) & (at < len(self.check))
        ok = inside & (self.check[np.where(inside, at, 0)] == states) & (at != 0)
        return np.where(ok, at, -1)
