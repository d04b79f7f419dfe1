"""Similarity of many pairs of short names at once, slips of the pen counted as single steps."""

from __future__ import annotations

import numpy as np

#: Letters up to which names are compared in batches, and cells of a batch.
SHORT, CELLS = 48, 4_000_000


def _codes(names: list[str], width: int) -> np.ndarray:
    out = np.full((len(names), width), -1, np.int32)
    for i, s in enumerate(names):
        if len(s) <= width:
            out[i, : len(s)] = np.frombuffer(s.encode("utf-32-le", "surrogatepass"), np.int32)
    return out


def _letters(names: list[str]) -> np.ndarray:
    """A bit per letter, modulo 64."""
    return np.array([sum(1 << b for b in {ord(c) % 64 for c in s}) for s in names], np.uint64)


def steps(a: np.ndarray, la: np.ndarray, b: np.ndarray, lb: np.ndarray) -> np.ndarray:
    """Letters to add, drop, replace, or swap with their neighbour, for rows of letter codes of lengths ``la`` and ``lb``."""
    n, most_a, most_b = len(a), int(la.max(initial=0)), int(lb.max(initial=0))
    a, b = np.ascontiguousarray(a[:, :most_a].T), np.ascontiguousarray(b[:, :most_b].T)
    before, last = None, np.repeat(np.arange(most_b + 1, dtype=np.int16)[:, None], n, 1)
    out, every = lb.astype(np.int16).copy(), np.arange(n)
    for i in range(1, most_a + 1):
        now = np.empty_like(last)
        now[0] = i
        for j in range(1, most_b + 1):
            d = np.minimum(np.minimum(last[j], now[j - 1]) + 1, last[j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1:
                swap = (a[i - 1] == b[j - 2]) & (a[i - 2] == b[j - 1])
                d = np.where(swap, np.minimum(d, before[j - 2] + 1), d)
            now[j] = d
        ends = la == i
        out[ends] = now[lb[ends], every[ends]]
        before, last = last, now
    return out


def _steps_of_two(a: str, b: str, most: int) -> int:
    """The same of one pair along a band of ``most`` steps around the diagonal; more than that comes out as most + 1."""
    before, last = {}, {j: j for j in range(min(len(b), most) + 1)}
    for i in range(1, len(a) + 1):
        now: dict[int, int] = {}
        for j in range(max(0, i - most), min(len(b), i + most) + 1):
            d = last.get(j, most) + 1
            if j:
                d = min(d, now.get(j - 1, most) + 1, last.get(j - 1, most + 1) + (a[i - 1] != b[j - 1]))
                if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                    d = min(d, before.get(j - 2, most) + 1)
            now[j] = d
        before, last = last, now
    return min(last.get(len(b), most + 1), most + 1)


class Names:
    """The names of one side, ready to be compared."""

    def __init__(self, names: list[str]):
        self.names = names
        self.length = np.array([len(s) for s in names], np.int64)
        self.width = int(self.length[self.length <= SHORT].max(initial=0))
        self.codes, self.letters = _codes(names, self.width), _letters(names)


def similarity(left: Names, right: Names, i: np.ndarray, j: np.ndarray, least: float) -> np.ndarray:
    """1 - steps / longer length of the pairs (i, j), exact from ``least`` on; 0 below.

    Lengths and letters that one name lacks bound the steps from below, so most pairs need no comparison. Two empty names are equal.
    """
    out = np.zeros(len(i))
    la, lb = left.length[i], right.length[j]
    longest = np.maximum(la, lb)
    most = np.floor((1 - least) * longest + 1e-9).astype(np.int64)
    ma, mb = left.letters[i], right.letters[j]
    lacking = np.maximum(np.bitwise_count(ma & ~mb), np.bitwise_count(mb & ~ma))
    maybe = (np.abs(la - lb) <= most) & (lacking <= most)
    short = np.flatnonzero(maybe & (longest <= SHORT))
    short = short[np.argsort(longest[short], kind="stable")]
    at = 0
    while at < len(short):
        step = max(1, CELLS // (int(longest[short[min(len(short), at + 4096) - 1]]) + 1) ** 2)
        k = short[at : at + min(step, 4096)]
        d = steps(left.codes[i[k]], la[k], right.codes[j[k]], lb[k])
        out[k] = np.where(d <= most[k], 1 - d / np.maximum(longest[k], 1), 0.0)
        at += len(k)
    for k in np.flatnonzero(maybe & (longest > SHORT)):
        d = _steps_of_two(left.names[i[k]], right.names[j[k]], int(most[k]))
        out[k] = 1 - d / longest[k] if d <= most[k] else 0.0
    return out
