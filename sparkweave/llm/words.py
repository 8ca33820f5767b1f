"""Ids of words, each distinct one encoded once while a worker's store holds it.

Words are spans of a byte array. They are named by a 64-bit hash and checked by a second one, both
taken eight bytes at a time for all words together; the store is a few flat arrays of bounded size.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np

from .common import mix, ragged
from .ngrams import Index

#: Longer words are encoded each time, one by one.
LONG = 256
_MASK = np.array([(1 << 8 * k) - 1 for k in range(8)] + [2**64 - 1], np.uint64)
_SEED, _STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def hashes(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of each span; of spans longer than LONG, those of their first LONG bytes and their size."""
    eight = np.zeros(len(data) // 8 + 2, np.uint64)
    eight.view(np.uint8)[: len(data)] = data
    one = mix(size.astype(np.uint64) * _STEP + _SEED)
    two = size.astype(np.uint64) + _STEP
    live, at = np.flatnonzero(size > 0), 0
    while len(live):
        place = start[live] + at
        word, shift = place >> 3, ((place & 7) << 3).astype(np.uint64)
        x = (eight[word] >> shift) | ((eight[word + 1] << np.uint64(1)) << (np.uint64(63) - shift))
        x &= _MASK[np.minimum(size[live] - at, 8)]
        one[live] = mix(one[live] * _STEP + x)
        y = (two[live] ^ x) * _SEED
        two[live] = y ^ (y >> np.uint64(29))
        at += 8
        live = live[size[live] > at] if at < LONG else live[:0]
    return one, two


def names(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A 64-bit hash of all bytes of each span."""
    out = hashes(data, start, size)[0]
    for i in np.flatnonzero(size > LONG):
        out[i] = int.from_bytes(hashlib.blake2b(data[start[i] : start[i] + size[i]].tobytes(), digest_size=8).digest(), "little")
    return out


class WordIds:
    """``encode(words as bytes)`` gives the ids of words, one after another, and how many each has."""

    def __init__(self, encode: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]], room: int = 600_000):
        self.encode, self.room = encode, room
        self._clear()

    def _clear(self) -> None:
        self.index, self.check = Index(np.zeros(0, np.uint64)), np.zeros(0, np.uint64)
        self.begin, self.size, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def _add(self, words: list[bytes]) -> None:
        ids, n = self.encode(words)
        self.begin = np.concatenate((self.begin, len(self.flat) + np.cumsum(n) - n))
        self.size = np.concatenate((self.size, n))
        self.flat = np.concatenate((self.flat, ids.astype(np.int32, copy=False)))

    def ids(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(the ids of all spans, how many each span has)."""
        size = end - start
        if len(self.check) > self.room:
            self._clear()
        one, two = hashes(data, start, size)
        at = self.index.find(one)
        miss = np.flatnonzero((at < 0) & (size <= LONG))
        if len(miss):
            _, first = np.unique(one[miss], return_index=True)
            new, raw = miss[first], data.tobytes()
            self._add([raw[a:b] for a, b in zip(start[new].tolist(), end[new].tolist(), strict=True)])
            self.check = np.concatenate((self.check, two[new]))
            self.index = Index(np.concatenate((self.index.keys, one[new])))
            at[miss] = self.index.find(one[miss])
        # long words, and different words of one hash: encoded for this call only
        odd = np.flatnonzero((at < 0) | (self.check[at] != two if len(self.check) else True))
        kept = len(self.check), len(self.flat)
        if len(odd):
            known: dict[bytes, int] = {}
            at[odd] = [known.setdefault(data[a:b].tobytes(), kept[0] + len(known)) for a, b in zip(start[odd].tolist(), end[odd].tolist(), strict=True)]
            self._add(list(known))
        n = self.size[at]
        out = self.flat[ragged(self.begin[at], n)]
        self.begin, self.size, self.flat = self.begin[: kept[0]], self.size[: kept[0]], self.flat[: kept[1]]
        return out, n
