"""Suffix-array dedup: difference-cover suffix arrays over the parts of texts that may repeat."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Rolling, drop_written, split_join, tune, written
from .difference_cover import LOCAL, suffix_array, suffix_ranks
from .windows import candidates, firsts, keyed, repeated, segments

#: Bytes of a string that must not occur twice; bytes of the grams that strings are sampled by.
LENGTH, GRAM = 400, 64
#: Bytes of one task's suffix array, about; a minimum with more bytes than this is sorted by all tasks together.
BLOCK = 1 << 20
#: Neighbours in the order of suffixes that one group of rows holds.
NEIGHBOURS = 1 << 16


_ROLL = Rolling(0xD6E8FEB86659FD93)
_BYTES = np.random.default_rng(11).integers(1, 1 << 63, 256).astype(np.uint64)


def _values(text: bytes) -> np.ndarray:
    return _BYTES[np.frombuffer(text, np.uint8)]


def _grams(size: int):
    def grams(text: bytes) -> np.ndarray:
        if len(text) < size:
            return np.zeros(0, np.uint64)
        at = np.arange(len(text) - size + 1)
        return _ROLL.ranges(_ROLL.prefix(_values(text)), at, at + size)

    return grams


def repeats(parts: list[bytes], length: int) -> list[np.ndarray]:
    """Of each part, the starts of its strings of `length` bytes that also start elsewhere, in any part.

    One suffix array over all parts, a symbol of its own behind each; strings of neighbours in it are compared.
    """
    size = np.array([len(p) for p in parts])
    start = np.concatenate([[0], np.cumsum(size + 1)[:-1]])
    raw = np.frombuffer(b"\0".join([*parts, b""]), np.uint8)
    s = raw.astype(np.int64) + 1 + len(parts)
    s[start + size] = np.arange(1, len(parts) + 1)
    sa = suffix_array(s)
    owner = np.searchsorted(start, sa, "right") - 1
    whole = sa + length <= start[owner] + size[owner]
    sa = sa[whole]  # equal strings stay neighbours, as all suffixes between them begin with that string
    hit = np.zeros(len(s), bool)
    if len(sa) > 1:
        prefix = _ROLL.prefix(_BYTES[raw])
        key = _ROLL.ranges(prefix, sa, sa + length)
        alike = np.flatnonzero(key[1:] == key[:-1])
        strings = np.lib.stride_tricks.sliding_window_view(raw, length)
        for at in range(0, len(alike), 2048):  # equal hashes are compared byte by byte
            some = alike[at : at + 2048]
            same = some[(strings[sa[some]] == strings[sa[some + 1]]).all(1)]
            hit[sa[same]] = True
            hit[sa[same + 1]] = True
    return [np.flatnonzero(hit[a : a + n]) for a, n in zip(start, size)]


def _ranges(starts: np.ndarray, length: int) -> list[int]:
    """Maximal runs [start, stop) of bytes that strings of `length` bytes from these starts cover, one after the other."""
    if not len(starts):
        return []
    gap = np.flatnonzero(starts[1:] > starts[:-1] + length)
    return np.stack([starts[np.append(0, gap + 1)], starts[np.append(gap, len(starts) - 1)] + length], 1).ravel().tolist()


def _as_symbols(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(part, symbols): bytes from 1 on, and behind them a symbol that no other part has."""
    for b in batches:
        ids = b.column("id").to_pylist()
        symbols = [np.append(np.frombuffer(raw.as_py(), np.uint8).astype(np.int64) + 1, 257 + i) for i, raw in zip(ids, b.column("part"))]
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(symbols, pa.list_(pa.int64()))], names=["part", "symbols"])


def _in_order(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """(bucket, rank, id, at, string): each string of `length` bytes by its suffix's rank, as a 128-bit digest; the first of a bucket also goes to the one before."""
    for b in batches:
        rows = []
        for i, raw, ranks in zip(b.column("id").to_pylist(), b.column("part").to_pylist(), b.column("ranks")):
            for at, rank in enumerate(ranks.values.to_numpy()[: len(raw) - length + 1].tolist()):
                row = (rank, i, at, hashlib.blake2b(raw[at : at + length], digest_size=16).digest())
                rows.append((rank // NEIGHBOURS, *row))
                if rank % NEIGHBOURS == 0:
                    rows.append((rank // NEIGHBOURS - 1, *row))
        types = pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 5, types)], names=["bucket", "rank", "id", "at", "string"])


def _equal_neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, at) of strings that equal the one before or behind them; rows are sorted by bucket and rank."""
    last = None
    for b in batches:
        rows = list(zip(*(b.column(c).to_pylist() for c in ("bucket", "rank", "string", "id", "at"))))
        rows = rows if last is None else [last, *rows]
        found = [place for x, y in zip(rows, rows[1:]) if x[2] == y[2] and x[0] == y[0] and x[1] + 1 == y[1] for place in (x[3:], y[3:])]
        last = rows[-1] if rows else last
        yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.int32())], names=["id", "at"])


def _by_all(hot: DataFrame, length: int, local: int) -> DataFrame:
    """(a, key, covered) of stretches (a, key, part, n) that all tasks sort together; suffixes that begin with one string are neighbours."""
    hot = written(hot.select("a", "key", "n", "part", F.monotonically_increasing_id().alias("id")), "hot")
    ranks = suffix_ranks(hot.select("id", "part").mapInArrow(_as_symbols, "part long, symbols array<long>"), local)
    strings = hot.select("id", "part").join(ranks.withColumnRenamed("part", "id"), "id").mapInArrow(lambda it: _in_order(it, length), "bucket long, rank long, id long, at int, string binary")
    places = strings.repartition("bucket").sortWithinPartitions("bucket", "rank").mapInArrow(_equal_neighbours, "id long, at int")
    places = written(places.groupBy("id").agg(F.collect_set("at").alias("at")), "places")

    def cover(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            starts = [range(size - length + 1) if n > 1 else sorted(at or []) for size, n, at in zip(*(b.column(c).to_pylist() for c in ("size", "n", "at")))]
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("key"), pa.array([_ranges(np.array(s, np.int64), length) for s in starts], pa.list_(pa.int32()))], names=["a", "key", "covered"])

    out = hot.select("a", "key", "n", "id", F.length("part").alias("size")).join(places, "id", "left").mapInArrow(cover, "a long, key string, covered array<int>")
    out = written(out, "covered")
    drop_written(hot, ranks, places)
    return out


def _cut_parts(batches: Iterator[pa.RecordBatch], length: int, gram: int) -> Iterator[pa.RecordBatch]:
    """The stretch of text under each run of windows whose minimum is repeated: (a, doc, lo, part)."""
    for b in batches:
        out = [], [], [], []
        for doc, text, minima in zip(b.column("doc").to_pylist(), b.column("text").to_pylist(), b.column("minima").to_pylist()):
            raw = text.encode()
            low, start, stop = segments(_grams(gram)(raw), length - gram + 1)
            for i in np.flatnonzero(np.isin(low, np.array(minima, np.int64).view(np.uint64))):
                for column, value in zip(out, (int(low[i].view(np.int64)), doc, int(start[i]), raw[start[i] : stop[i] - 1 + length])):
                    column.append(value)
        if out[0]:
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int32()), pa.array(out[3], pa.binary())], names=["a", "doc", "lo", "part"])


def dedup(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, block: int = BLOCK, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Remove each byte covered by a string of `length` bytes that also starts anywhere else in the table.

    1. Every string of `length` bytes has the least `gram`-byte gram (by hash) in common with its repeats; the
       strings of a text are grouped by it. Minima found in one place only end there.
    2. What remains is a small part of the texts. Its stretches go, by minimum, to blocks of about `block`
       bytes, distinct stretches once (how often each occurs is kept): repeats always share a block.
    3. In each block a suffix array is built by the difference-cover algorithm, and neighbours are compared.
       Minima with more than `block` bytes of distinct stretches are not gathered: their stretches are sorted by
       the same algorithm over all tasks (`difference_cover.suffix_ranks`), and neighbours in that order compared.
    4. The covered ranges return to their documents.
    Returns doc_id, n_bytes, n_removed, n_spans, kept (binary), kept_sha256, spans (start, stop after each other).
    Defined cases: null and empty texts have no bytes; texts under `length` bytes lose none; texts that occur
    twice and are that long lose all; rows of equal id and text count once each as another place, like any
    rows; null ids are kept; an empty table gives no rows; other columns are ignored.
    """
    if block >= 1 << 21 or gram > length:
        raise ValueError("a block must be under 2**21 bytes, and a gram no longer than a string")
    tune(docs.sparkSession)
    d = keyed(docs, doc_id, text)
    # Rows of equal id and text are one document here, `times` of them: copies all the same.
    each = d.select("doc", F.xxhash64("text").alias("tk"), F.sha2("text", 256).alias("sha"), "times")
    first = written(each.groupBy("sha").agg(F.min("doc").alias("doc"), F.min("tk").alias("tk"), F.sum("times").alias("copies")), "firsts")
    minima = repeated(d, _grams(gram), length - gram + 1)
    parts = candidates(d, first, minima).mapInArrow(lambda it: _cut_parts(it, length, gram), "a long, doc long, lo int, part binary")
    parts = written(parts.withColumn("key", F.md5("part")), "parts")
    distinct = parts.groupBy("a", "key").agg(F.first("part").alias("part"), F.count("*").alias("n"))
    distinct = written(distinct, "distinct")
    bytes_of = distinct.groupBy("a").agg(F.sum(F.length("part")).alias("bytes"))
    total = bytes_of.where(F.col("bytes") <= block).agg(F.sum("bytes")).first()[0] or 0
    blocks = max(1, -(-total // block))
    sized = distinct.join(bytes_of, "a")

    def by_array(one: pd.DataFrame) -> pd.DataFrame:
        # Blocks are even on average only: a large one is taken in runs of whole minima, `block` bytes each at most.
        one = one.sort_values("a", kind="stable").reset_index(drop=True)
        parts, a, covered = one["part"].tolist(), one["a"].to_numpy(), []
        size = np.array([len(p) for p in parts])
        edges = [*np.flatnonzero(np.diff(a, prepend=a[0] + 1)), len(a)]
        start = 0
        for left, right in zip(edges, edges[1:]):
            if left > start and size[start:right].sum() > block:
                covered += repeats(parts[start:left], length)
                start = left
        covered += repeats(parts[start:], length)
        # A stretch that occurs twice repeats wholly; it still takes part, for what it has in common with others.
        covered = [np.arange(len(p) - length + 1) if n > 1 else f for p, n, f in zip(parts, one["n"], covered)]
        return pd.DataFrame({"a": one["a"], "key": one["key"], "covered": [_ranges(f, length) for f in covered]})

    usual = sized.where(F.col("bytes") <= block).withColumn("block", F.pmod(F.xxhash64("a"), F.lit(blocks)))
    usual = usual.select("block", "a", "key", "part", "n").groupBy("block").applyInPandas(by_array, "a long, key string, covered array<int>")

    covered = usual
    hot = sized.where(F.col("bytes") > block)
    if not hot.isEmpty():
        covered = usual.unionByName(_by_all(hot, length, min(2 * block, LOCAL)))
    covered = written(covered.where(F.size("covered") > 0).join(distinct.select("a", "key", F.col("n").alias("rows")), ["a", "key"]), "ranges")
    parts_at = parts.select("a", "key", "doc", "lo")
    ranges = split_join(parts_at, covered, ["a", "key"], "rows").groupBy("doc").agg(F.flatten(F.collect_list(F.transform("covered", lambda x: x + F.col("lo")))).alias("covered"))
    ranges = written(ranges, "ranges")
    drop_written(distinct, parts, covered)
    whole = split_join(each, first.select("sha", "copies", F.col("copies").alias("rows")), ["sha"], "rows").select("doc", (F.col("copies") > 1).alias("copied"))
    marks = whole.join(ranges, "doc", "left").where("copied OR covered IS NOT NULL")
    rows = d.join(marks, "doc", "left").select("doc_id", "times", "text", F.coalesce("copied", F.lit(False)).alias("copied"), "covered")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [], [], [], [], [], []
            for text, copied, covered in zip(b.column("text").to_pylist(), b.column("copied").to_pylist(), b.column("covered").to_pylist()):
                raw = text.encode()
                spans: list[tuple[int, int]] = []
                if copied and len(raw) >= length:
                    spans = [(0, len(raw))]
                elif covered:
                    for s, e in sorted(zip(covered[::2], covered[1::2])):
                        if spans and s <= spans[-1][1]:
                            spans[-1] = spans[-1][0], max(e, spans[-1][1])
                        else:
                            spans.append((s, e))
                ends = [0, *(x for span in spans for x in span), len(raw)]
                kept = b"".join(raw[s:e] for s, e in zip(ends[::2], ends[1::2]))
                for column, value in zip(out, (len(raw), len(raw) - len(kept), len(spans), kept, hashlib.sha256(kept).hexdigest(), ends[1:-1])):
                    column.append(value)
            types = pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.string(), pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("times"), *(pa.array(c, t) for c, t in zip(out, types))], names=["doc_id", "times", "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256", "spans"])

    out = rows.mapInArrow(cut, "doc_id long, times int, n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string, spans array<int>")
    return out.withColumn("copy", F.explode(F.sequence(F.lit(1), "times"))).drop("times", "copy")
