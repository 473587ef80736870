"""Texts of a batch as one array of code points, and what is counted on it."""

from __future__ import annotations

from collections.abc import Sequence
from functools import lru_cache

import numpy as np

from .common import mix64


@lru_cache(maxsize=1)
def tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every code point: is it a letter, is it upper case, and its lower case (itself if that is longer)."""
    every = [chr(i) for i in range(0x110000)]
    letter = np.fromiter((c.isalpha() for c in every), bool, len(every))
    upper = np.fromiter((c.isupper() for c in every), bool, len(every))
    lower = np.arange(len(every), dtype=np.uint32)
    for i in np.flatnonzero(upper):
        small = every[i].lower()
        if len(small) == 1:
            lower[i] = ord(small)
    return letter, upper, lower


class Batch:
    """Texts in a row, a NUL between them: `cp` the code points, `doc` the number of the text of each."""

    def __init__(self, texts: Sequence[str | None]):
        texts = ["" if t is None else t for t in texts]
        self.n = len(texts)
        self.size = np.fromiter((len(t) for t in texts), np.int64, self.n)
        self.cp = np.frombuffer("\0".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
        self.start = np.concatenate([[0], np.cumsum(self.size + 1)[:-1]]).astype(np.int64)
        self.letter = tables()[0][self.cp]

    def of(self, places: np.ndarray) -> np.ndarray:
        """The number of the text that each place belongs to."""
        return np.searchsorted(self.start, places, "right") - 1

    def runs(self, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and stops of the maximal runs of a mask; the NULs, outside of it, keep texts apart."""
        edge = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8)))
        return edge[::2], edge[1::2]

    def trigrams(self, places: np.ndarray, buckets: int) -> np.ndarray:
        """Hash, below `buckets`, of the lower-cased letters at and around each place; non-letters count as one border mark."""
        low = np.where(self.letter, tables()[2][self.cp], 0).astype(np.uint64)
        low = np.concatenate([[np.uint64(0)], low, [np.uint64(0)]])
        key = (low[places] << np.uint64(42)) | (low[places + 1] << np.uint64(21)) | low[places + 2]
        return (mix64(key) % np.uint64(buckets)).astype(np.int64)
