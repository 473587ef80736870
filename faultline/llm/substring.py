"""Substring dedup: level-wise doubling of word windows, from at most five words to the whole length."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Rolling, drop_written, mix64, split_join, tune, written
from .windows import candidates, firsts, keyed, repeated, segments, twice_found

#: Words of a window that must not occur twice; words of the windows of the first level, at most.
WINDOW, FIRST = 20, 5
_BASES = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F


class Words:
    """64-bit hashes of words, remembered for frequent ones; grams of any length from prefix sums."""

    LIMIT = 200_000

    def __init__(self) -> None:
        self.known: dict[bytes, int] = {}
        self.rolling = [Rolling(b) for b in _BASES]

    def hashes(self, words: list[bytes]) -> np.ndarray:
        import xxhash

        if len(self.known) > self.LIMIT:
            self.known.clear()
        known, digest = self.known, xxhash.xxh3_64_intdigest
        out = []
        for w in words:
            h = known.get(w)
            if h is None:
                h = known[w] = digest(w)
            out.append(h)
        return np.array(out, np.uint64)

    def grams(self, values: np.ndarray, n: int, which: int = 0) -> np.ndarray:
        if len(values) < n:
            return np.zeros(0, np.uint64)
        r = self.rolling[which]
        at = np.arange(len(values) - n + 1)
        return r.ranges(r.prefix(values), at, at + n)


_WORDS = Words()


def levels(window: int, first: int = FIRST) -> list[int]:
    """Lengths in words: `window` halved, rounded up, until at most `first`; each is at most twice the one before."""
    out = [window]
    while out[-1] > first:
        out.append((out[-1] + 1) // 2)
    return out[::-1]


def _surviving(values: np.ndarray, size: int, window: int, repeated_minima: list[int]) -> np.ndarray:
    """Of each window of a text, whether the least of its runs of `size` words is among the repeated ones."""
    alive = np.zeros(max(0, len(values) - window + 1), bool)
    low, start, stop = segments(_WORDS.grams(values, size), window - size + 1)
    for s, e in zip(*(x[np.isin(low, np.array(repeated_minima, np.int64).view(np.uint64))] for x in (start, stop))):
        alive[s:e] = True
    return alive


def _extended(batches: Iterator[pa.RecordBatch], size: int, longer: int, window: int) -> Iterator[pa.RecordBatch]:
    """(a, tk, twice): of the windows that survived runs of `size` words, the least of their runs of `longer` words; as in `windows.repeated`."""
    for b in batches:
        found, keys, twice = [], [], []
        for tk, text, minima in zip(b.column("tk").to_pylist(), b.column("text").to_pylist(), b.column("minima").to_pylist()):
            values = _WORDS.hashes(text.encode().split())
            alive = _surviving(values, size, window, minima)
            grams = _WORDS.grams(values, longer)
            low, start, stop = segments(grams, window - longer + 1)
            counts = np.concatenate([[0], np.cumsum(alive)])
            low = np.unique(low[counts[stop] > counts[start]])
            if len(low):
                order = np.sort(grams)
                found.append(low)
                keys.append(np.full(len(low), tk, np.int64))
                twice.append(np.isin(low, order[1:][order[1:] == order[:-1]]))
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64)), pa.array(np.concatenate(keys)), pa.array(np.concatenate(twice))], names=["a", "tk", "twice"])


def _windows(batches: Iterator[pa.RecordBatch], size: int, window: int) -> Iterator[pa.RecordBatch]:
    """Windows of the full length that survived runs of `size` words: (h1, h2, doc, pos, again); again: also earlier in this text."""
    for b in batches:
        out = []
        for doc, text, minima in zip(b.column("doc").to_pylist(), b.column("text").to_pylist(), b.column("minima").to_pylist()):
            values = _WORDS.hashes(text.encode().split())
            at = np.flatnonzero(_surviving(values, size, window, minima))
            if not len(at):
                continue
            h = [r.ranges(r.prefix(values), at, at + window) for r in _WORDS.rolling]
            again = np.ones(len(at), bool)
            again[np.unique(h[0] ^ mix64(h[1]), return_index=True)[1]] = False
            out.append((h[0].view(np.int64), h[1].view(np.int64), np.full(len(at), doc, np.int64), at.astype(np.int32), again))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], names=["h1", "h2", "doc", "pos", "again"])


def dedup(docs: DataFrame, window: int = WINDOW, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Remove each word covered by a window of `window` words that also starts earlier (smaller id, or earlier in the text).

    Levels: of all runs of at most five words, those least by hash among the runs of a full window are sampled,
    which each full window has in common with its repeats. Runs that occur in one place only end there, and
    with them the windows they stand for. Windows that are left send their least run of twice that length, and
    so on, until the run is the window itself or no window is left: full windows are compared by two 64-bit
    hashes; those that occur again, later than their first place, are the result.
    Returns doc_id, n_words, n_removed, kept (text: kept words joined by a space), kept_sha256.
    Defined cases: null and empty texts have no words, and texts under `window` words lose none; later copies
    of a text of `window` words or more lose all words; rows of equal id and text count as one document and get
    its result each; rows of equal id and other text are ordered by text; null ids come first; an empty table
    gives no rows; other columns are ignored.
    """
    tune(docs.sparkSession)
    d = keyed(docs, doc_id, text)
    first = written(firsts(d), "firsts")
    size, *longer = levels(window)
    minima = repeated(d, lambda t: _WORDS.grams(_WORDS.hashes(t.split()), size), window - size + 1)
    for n in longer[:-1]:
        if minima.isEmpty():
            break
        before = minima
        texts = candidates(d, first, minima, "tk")
        minima = twice_found(texts.mapInArrow(lambda it, size=size, n=n: _extended(it, size, n, window), "a long, tk long, twice boolean"))
        drop_written(before)
        size = n
    found = candidates(d, first, minima).mapInArrow(lambda it: _windows(it, size, window), "h1 long, h2 long, doc long, pos int, again boolean")
    found = written(found, "windows")
    drop_written(minima)
    # First places in each text alone are compared across texts, by the least document.
    places = found.where("NOT again")
    earliest = places.groupBy("h1", "h2").agg(F.min("doc").alias("least"), F.max("doc").alias("most"), F.count("*").alias("rows")).where("least <> most").select("h1", "h2", "least", "rows")
    earliest = written(earliest, "earliest")
    later = split_join(places, earliest, ["h1", "h2"], "rows").where("doc > least").select("doc", "pos").unionByName(found.where("again").select("doc", "pos"))
    later = written(later.groupBy("doc").agg(F.collect_list("pos").alias("later")), "later")
    drop_written(found, earliest)
    marks = first.select("doc", F.lit(True).alias("first")).join(later, "doc", "left")
    rows = d.join(marks, "doc", "left").select("doc_id", "times", "text", F.coalesce("first", F.lit(False)).alias("first"), "later")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, removed, kept_texts = [], [], []
            for text, is_first, later in zip(b.column("text").to_pylist(), b.column("first").to_pylist(), b.column("later").to_pylist()):
                words = text.encode().split()
                n.append(len(words))
                if not is_first and len(words) >= window:
                    kept = []
                elif later:
                    edge = np.zeros(len(words) + 1, np.int32)
                    np.add.at(edge, later, 1)
                    np.add.at(edge, np.array(later) + window, -1)
                    kept = [words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0)]
                else:
                    kept = words
                removed.append(len(words) - len(kept))
                kept_texts.append(b" ".join(kept))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("times"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array([k.decode() for k in kept_texts]), pa.array([hashlib.sha256(k).hexdigest() for k in kept_texts])], names=["doc_id", "times", "n_words", "n_removed", "kept", "kept_sha256"])

    out = rows.mapInArrow(cut, "doc_id long, times int, n_words long, n_removed long, kept string, kept_sha256 string")
    return out.withColumn("copy", F.explode(F.sequence(F.lit(1), "times"))).drop("times", "copy")
