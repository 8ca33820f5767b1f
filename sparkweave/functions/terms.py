"""Which of many terms stand in a text: one pass over the text, however many the terms."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable

import ahocorasick


class _Fold(dict):
    """One character for one character: upper, then lower case, where each is one character; so places in a text stay."""

    def __missing__(self, code: int) -> int:
        c = chr(code)
        up = c.upper() if len(c.upper()) == 1 else c
        low = up.lower() if len(up.lower()) == 1 else up
        self[code] = ord(low)
        return self[code]


_FOLD = _Fold({ord("İ"): ord("i")})


def folded(text: str) -> str:
    return text.lower() if text.isascii() else text.translate(_FOLD)


def in_word(c: str) -> bool:
    """Letters, numbers and the underscore."""
    return c == "_" or unicodedata.category(c)[0] in "LN"


class Terms:
    """Terms in the order of their rank; ``first`` tells the least rank of those that stand in a text.

    ``whole``: only where no letter, number or underscore touches the term, in any case; else anywhere, as
    the texts stand. An empty term stands in every text if it need not be whole, and in none otherwise.
    """

    def __init__(self, ranked: Iterable[tuple[int, str]], whole: bool = False):
        self.whole, self.everywhere, least = whole, None, {}
        for rank, term in ranked:
            key = folded(term) if whole else term
            if key:
                least[key] = min(rank, least.get(key, rank))
            elif not whole:
                self.everywhere = rank if self.everywhere is None else min(rank, self.everywhere)
        self.automaton = ahocorasick.Automaton()
        for key, rank in least.items():
            self.automaton.add_word(key, (rank, len(key)))
        if least:
            self.automaton.make_automaton()
        self.some = bool(least)

    def first(self, text: str | None) -> int | None:
        if text is None:
            return None
        best = self.everywhere
        if self.some:
            t = folded(text) if self.whole else text
            for end, (rank, size) in self.automaton.iter(t):
                if (best is None or rank < best) and not (self.whole and self._touched(t, end - size, end + 1)):
                    best = rank
        return best

    @staticmethod
    def _touched(t: str, before: int, after: int) -> bool:
        return (before >= 0 and in_word(t[before])) or (after < len(t) and in_word(t[after]))
