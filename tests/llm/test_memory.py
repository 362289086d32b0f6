"""The memory of pieces is bounded by number and by characters."""

import numpy as np

from sparkroom.llm.memory import PieceMemory


def test_memory_starts_anew():
    m = PieceMemory(4, letters=20)
    ids = lambda ps: (np.array([len(p) for p in ps], np.uint32), np.ones(len(ps), np.int64))
    keep = lambda ps: m.keep(ps, *ids(ps))
    first = sorted(m.missing(["a", "bb"]))
    keep(first)
    assert m.missing(["a", "bb", "ccc"]) == {"ccc"}
    keep(["ccc"])
    # by characters: 6 are held, 15 more do not fit
    assert m.missing(["a", "x" * 15]) == {"a", "x" * 15} and m.held == 0
    keep(["a", "x" * 15])
    got, ends = m.ids(["x" * 15, "a"], np.array([1, 0, 1]), np.array([0, 2, 3]))
    assert got.tolist() == [1, 15, 1] and ends.tolist() == [0, 2, 3]
    # one set of pieces larger than the bound is kept whole, and the next call starts anew
    big = ["y" * 30]
    keep(sorted(m.missing(big)))
    assert m.missing(["y" * 30]) == set() and m.missing(["z"]) == {"z"} and not m.slot
    # by number
    keep(sorted(m.missing(["p", "q", "r", "s"])))
    assert m.missing(["p", "t"]) == {"p", "t"}
