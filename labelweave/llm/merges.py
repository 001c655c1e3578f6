"""Whether two neighbouring pieces of a BPE vocabulary stay apart, for many pairs at once."""

from __future__ import annotations

import numpy as np


class Merges:
    """The merges of a vocabulary: rank of the merge that makes a piece (-1: none does), its two parts, and every pair that merges.

    pairs holds a * n + b for pieces a and b, sorted, and pair_rank the rank of each.
    """

    def __init__(self, n: int):
        self.n = n
        self.rank, self.left, self.right = (np.full(n, -1) for _ in range(3))
        self.pairs, self.pair_rank = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def apart(self, a: np.ndarray, b: np.ndarray, limit: np.ndarray | None = None) -> np.ndarray:
        """Whether a and b come out again when their characters are merged; ids below 0 are unknown characters.

        Merges are undone from the last to the first, and no pair at the seam may merge sooner than what is
        undone. With `limit`, only merges of a lower rank are looked at.
        """
        ok = np.ones(len(a), bool)
        left, right = a.copy(), b.copy()
        live = np.flatnonzero((a >= 0) & (b >= 0))
        limit = np.full(len(a), np.iinfo(np.int64).max) if limit is None else limit.copy()
        while len(live) and len(self.pairs):
            key = left[live] * self.n + right[live]
            at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
            clash = (self.pairs[at] == key) & (self.pair_rank[at] < limit[live])
            ok[live[clash]] = False
            live = live[~clash]
            ra, rb = self.rank[left[live]], self.rank[right[live]]
            live, ra, rb = live[more := (ra >= 0) | (rb >= 0)], ra[more], rb[more]
            undo = ra > rb
            x, y = live[undo], live[~undo]
            limit[x], left[x] = ra[undo], self.right[left[x]]
            limit[y], right[y] = rb[~undo] + 1, self.left[right[y]]
        return ok
