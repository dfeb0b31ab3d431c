"""Hashed character n-grams of words, and tables that hold what a model says of each word it has met."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

#: Words kept at most in a worker's table; when more come it starts anew.
KEPT_WORDS = 300_000
#: Words whose n-grams are held at once.
RATED = 20_000
_MIX, _STEP = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x9E3779B97F4A7C15)


def grams(words: list[str], sizes: tuple[int, ...], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes (below 2**bits) of the n-grams of each word between blanks, and the word that each belongs to."""
    if not words:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    text = " " + " ".join(words) + " "
    flat = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)
    blanks = np.concatenate([[0], np.cumsum(flat == 32)])
    hashes, owners = [], []
    for n in sizes:
        m = len(flat) - n + 1
        if m <= 0:
            continue
        h = np.full(m, n, np.uint64)
        for k in range(n):
            h = h * _STEP + flat[k : k + m]
        h ^= h >> np.uint64(29)
        h *= _MIX
        inside = blanks[n - 1 : n - 1 + m] == blanks[1 : 1 + m]  # no blank but at either end
        hashes.append((h[inside] >> np.uint64(64 - bits)).astype(np.int64))
        # before the first character of an n-gram stand as many blanks as words, less one if it begins with a blank
        owners.append(np.minimum(blanks[1 : 1 + m][inside] - 1, len(words) - 1))
    if not hashes:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(hashes), np.concatenate(owners)


class WordTable:
    """Rows of numbers for words; ``rate`` computes those of new words, many at a time."""

    def __init__(self, rate: Callable[[list[str]], np.ndarray], kept: int = KEPT_WORDS):
        self.rate, self.kept = rate, kept
        self.index: dict[str, int] = {}
        self.rows: np.ndarray | None = None

    def look_up(self, lists: list[list[str]] | list[set[str]]) -> tuple[list[list[int]], np.ndarray]:
        """For each list the rows of its words, and the rows."""
        new = set().union(*lists).difference(self.index)
        if len(self.index) + len(new) > self.kept:
            self.index, self.rows = {}, None
            new = set().union(*lists)
        if new:
            new = list(new)
            rows = np.concatenate([self.rate(new[a : a + RATED]) for a in range(0, len(new), RATED)])
            at = len(self.index)
            self.index.update(zip(new, range(at, at + len(new)), strict=True))
            if self.rows is None:
                self.rows = rows.copy()
            else:
                if at + len(new) > len(self.rows):  # grows by doubling
                    more = np.zeros((max(2 * len(self.rows), at + len(new)), *rows.shape[1:]), rows.dtype)
                    more[:at] = self.rows[:at]
                    self.rows = more
                self.rows[at : at + len(new)] = rows
        find = self.index
        return [[find[w] for w in words] for words in lists], self.rows if self.rows is not None else self.rate([])
