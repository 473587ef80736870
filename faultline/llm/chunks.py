"""Distinct-chunk tables: texts cut before marked words, each distinct one segmented once, ids joined back by position."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from functools import lru_cache

import numpy as np

#: The mark that stands for a space in pieces.
MARK = "▁"
#: A table with more chunks than this, or of more code points, is begun anew: it bounds a worker's memory, not the result.
MOST_CHUNKS, MOST_CHARS = 1 << 18, 1 << 24
#: A space behind something that is neither white space nor a mark, and before anything: no piece or pre-token holds one inside.
# The space comes first, as a search for one letter is much faster than a look behind each.
_CUT = re.compile(rf" (?<=[^\s{MARK}] )(?=.)", re.DOTALL)


def marked(text: str) -> list[str]:
    """The marked words of a space and `text`, each without its first space; a word keeps white space that can't be cut off."""
    return _CUT.split(text) if text else []


def whole(text: str) -> list[str]:
    """The text as one chunk, for models whose pieces may cross marks."""
    return [text] if text else []


class Codes(dict):
    """Numbers of chunks in the order in which they are first asked for; `fresh` are the new ones."""

    def __init__(self):
        super().__init__()
        self.fresh: list[str] = []

    def __missing__(self, chunk: str) -> int:
        code = self[chunk] = len(self)
        self.fresh.append(chunk)
        return code


class ChunkTable:
    """Chunks seen by one task and the ids of each, by one or more encoders (lists of chunks to lists of ids)."""

    def __init__(self, encoders: Sequence[Callable[[list[str]], list[Sequence[int]]]], cut: Callable[[str], list[str]] = marked, most: int = MOST_CHUNKS, chars: int = MOST_CHARS):
        self.encoders, self.cut, self.most, self.chars = encoders, cut, most, chars
        self.segmented = 0
        self._clear()

    def _clear(self) -> None:
        self.codes, self.held = Codes(), 0
        self.lengths = [np.zeros(0, np.int64) for _ in self.encoders]
        self.flat = [np.zeros(0, np.int32) for _ in self.encoders]

    def ids(self, texts: Sequence[str | None]) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each encoder the ids of all texts in a row, and the offsets of each text in them; null and empty texts have none."""
        if len(self.codes) > self.most or self.held > self.chars:
            self._clear()
        look = self.codes.__getitem__
        codes = [list(map(look, self.cut(t))) if t else [] for t in texts]
        fresh, self.codes.fresh = self.codes.fresh, []
        self.segmented += len(fresh)
        self.held += sum(map(len, fresh))
        counts = np.fromiter(map(len, codes), np.int64, len(codes))
        at = np.fromiter((c for row in codes for c in row), np.int64, int(counts.sum()))
        edges = np.concatenate([[0], np.cumsum(counts)])
        out = []
        for k, encode in enumerate(self.encoders):
            if fresh:
                new = encode(fresh)
                self.lengths[k] = np.append(self.lengths[k], np.fromiter(map(len, new), np.int64, len(new)))
                self.flat[k] = np.append(self.flat[k], np.fromiter((x for ids in new for x in ids), np.int32))
            starts = np.cumsum(self.lengths[k]) - self.lengths[k]
            n = self.lengths[k][at]
            ends = np.concatenate([[0], np.cumsum(n)])
            gather = np.repeat(starts[at] - ends[:-1], n) + np.arange(ends[-1])
            out.append((self.flat[k][gather], ends[edges]))
        return out


@lru_cache(maxsize=4)
def piece_model(proto: bytes):
    """The model of a file's bytes; one a worker process."""
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_proto=proto)


@lru_cache(maxsize=4)
def piece_cut(proto: bytes) -> Callable[[str], list[str]]:
    """How to cut texts for a model: at marked words, if no piece holds a mark behind another character and texts are not normalised."""
    model = piece_model(proto)
    crossing = any(MARK in model.id_to_piece(i).lstrip(MARK) for i in range(model.get_piece_size()))
    sample = " a  b\tﬁ Å\n　x "
    return whole if crossing or model.normalize(sample) != f" {sample}".replace(" ", MARK) else marked
