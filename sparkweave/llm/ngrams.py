"""Byte n-grams as integers: vectorised codes, counts and lookups."""

from __future__ import annotations

import numpy as np


def codes(data: np.ndarray, off: np.ndarray, k: int) -> np.ndarray:
    """At each byte, it and the k-1 bytes before it in its text as one integer; 0 stands for what is before a text."""
    kind = np.uint32 if k <= 4 else np.uint64
    out = data.astype(kind)
    starts = off[:-1][np.diff(off) > 0]
    for j in range(1, k):
        back = np.zeros(len(data), kind)
        back[j:] = data[: len(data) - j]
        for i in range(j):
            at = starts + i
            back[at[at < len(data)]] = 0
        out |= back << kind(8 * j)
    return out


def counted(x: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values, sorted, and how often they occur (or the sums of ``n``)."""
    if not len(x):
        return x, np.zeros(0, np.int64)
    if n is None:
        x = np.sort(x)
        start = np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1])))
        return x[start], np.diff(np.append(start, len(x)))
    order = np.argsort(x, kind="stable")
    x, n = x[order], n[order]
    start = np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1])))
    return x[start], np.add.reduceat(n, start)


class Counter:
    """Sums of counts over many steps, in memory in proportion to the distinct values."""

    def __init__(self, room: int = 2_000_000):
        self.parts, self.held, self.room = [], 0, room

    def add(self, x: np.ndarray, n: np.ndarray) -> None:
        self.parts.append((x, n))
        self.held += len(x)
        if self.held > self.room:
            x, n = self.total()
            self.parts, self.held, self.room = [(x, n)], len(x), max(self.room, 2 * len(x))

    def total(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.parts:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        return counted(np.concatenate([x for x, _ in self.parts]), np.concatenate([n for _, n in self.parts]))


class Index:
    """Places of distinct integer keys: two hashed tables, and a search for the few that fit in neither."""

    _MUL = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))

    def __init__(self, keys: np.ndarray):
        self.keys = np.ascontiguousarray(keys)
        self.shift = np.uint64(64 - max(8, int(np.ceil(np.log2(max(1, 4 * len(keys)))))))
        self.tables, rest = [], np.arange(len(keys), dtype=np.int32)
        for which in range(2):
            table = np.full(1 << (64 - int(self.shift)), -1, np.int32)
            slot = self._slot(self.keys[rest], which)
            table[slot] = rest
            self.tables.append(table)
            rest = rest[table[slot] != rest]
        self.rest = rest[np.argsort(self.keys[rest])]

    def _slot(self, x: np.ndarray, which: int) -> np.ndarray:
        return (x.astype(np.uint64) * self._MUL[which] >> self.shift).astype(np.int64)

    def find(self, x: np.ndarray) -> np.ndarray:
        """Place of each value among the keys, -1 where it isn't one."""
        if not len(self.keys):
            return np.full(len(x), -1, np.int32)
        at = self.tables[0][self._slot(x, 0)]
        miss = np.flatnonzero(self.keys[at] != x)
        if len(miss):
            y = x[miss]
            two = self.tables[1][self._slot(y, 1)]
            two[self.keys[two] != y] = -1
            left = np.flatnonzero(two < 0)
            if len(self.rest) and len(left):
                k = np.minimum(np.searchsorted(self.keys[self.rest], y[left]), len(self.rest) - 1)
                hit = self.keys[self.rest[k]] == y[left]
                two[left[hit]] = self.rest[k[hit]]
            at[miss] = two
        return at


def text_sums(values: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Sums of per-byte values over each text; zeros for empty texts."""
    out = np.zeros((len(off) - 1, *values.shape[1:]), np.float64)
    some = np.diff(off) > 0
    if some.any():
        out[some] = np.add.reduceat(values, off[:-1][some], axis=0, dtype=np.float64)
    return out
