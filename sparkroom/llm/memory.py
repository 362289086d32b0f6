"""Token ids of pieces of text, remembered in a worker."""

from __future__ import annotations

import numpy as np

#: Characters of all pieces that a memory holds (up to 4 bytes each, and 4 for each id).
LETTERS = 1 << 25


def spread(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each stretch of the given sizes."""
    return np.repeat(start - (np.cumsum(size) - size), size) + np.arange(size.sum())


class PieceMemory:
    """Ids of up to ``most`` distinct pieces, of up to ``letters`` characters together, in
    one growing array; a piece is known by its slot. When it is full it starts anew, so
    that long unbroken words do not outgrow a worker."""

    def __init__(self, most: int, letters: int = LETTERS) -> None:
        self.most, self.letters = most, letters
        self.clear()

    def clear(self) -> None:
        self.slot: dict[str, int] = {}
        self.held = 0
        self.start, self.size = np.zeros(1024, np.int64), np.zeros(1024, np.int64)
        self.pool, self.used = np.zeros(4096, np.uint32), 0

    def missing(self, pieces: list[str]) -> set[str]:
        """Those that are not known; with too many, all of them after a new start."""
        new = set(pieces).difference(self.slot)
        if new and (len(self.slot) + len(new) > self.most or self.held + sum(map(len, new)) > self.letters):
            self.clear()
            new = set(pieces)
        return new

    def keep(self, pieces: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        """Remember the ids of new pieces, which lie one after another."""
        n, m = len(self.slot), len(self.slot) + len(pieces)
        self.slot.update(zip(pieces, range(n, m)))
        self.held += sum(map(len, pieces))
        while len(self.start) < m:
            self.start, self.size = (np.concatenate((x, np.zeros_like(x))) for x in (self.start, self.size))
        self.start[n:m], self.size[n:m] = self.used + np.cumsum(sizes) - sizes, sizes
        while len(self.pool) < self.used + len(ids):
            self.pool = np.concatenate((self.pool, np.zeros_like(self.pool)))
        self.pool[self.used : self.used + len(ids)] = ids
        self.used += len(ids)

    def ids(self, pieces: list[str], at: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts, one after another, and where each text's end. A text is the
        pieces ``at[ends[i]:ends[i + 1]]``, given as places in ``pieces``."""
        slot = np.fromiter(map(self.slot.__getitem__, pieces), np.int64, len(pieces))[at]
        size = self.size[slot]
        upto = np.concatenate(([0], np.cumsum(size)))
        return self.pool[spread(self.start[slot], size)], upto[ends]
