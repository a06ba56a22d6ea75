"""The best rows of many queries, kept while a task's rows go by."""

from __future__ import annotations

import numpy as np


class RunningTop:
    """The ``k`` best (score, key) of each query: descending scores, then ascending keys."""

    def __init__(self, queries: int, k: int):
        self.k = k
        self.held: list[list[tuple]] = [[] for _ in range(queries)]
        self.floor = np.full(queries, -np.inf)

    def add(self, scores: np.ndarray, keys: list) -> None:
        """``scores``: (rows, queries), -inf where a row doesn't count; ``keys``: one for each row."""
        n = len(keys)
        least = self.floor
        if n > self.k:
            least = np.maximum(least, np.partition(scores, n - self.k, axis=0)[n - self.k])
        row, query = np.nonzero((scores >= least) & (scores > -np.inf))
        order = np.argsort(query, kind="stable")
        row, query = row[order], query[order]
        cuts = [0, *(np.flatnonzero(np.diff(query)) + 1).tolist(), len(query)]
        for s, e in zip(cuts, cuts[1:], strict=False):
            if s == e:
                continue
            q = int(query[s])
            new = zip((-scores[row[s:e], q]).tolist(), (keys[i] for i in row[s:e].tolist()), strict=True)
            self.held[q] = sorted([*self.held[q], *new])[: self.k]
            if len(self.held[q]) == self.k:
                self.floor[q] = -self.held[q][-1][0]

    def rows(self) -> tuple[list, list, list]:
        """(query numbers, keys, scores)"""
        out = [(q, key, -s) for q, held in enumerate(self.held) for s, key in held]
        return tuple(map(list, zip(*out, strict=True))) if out else ([], [], [])
