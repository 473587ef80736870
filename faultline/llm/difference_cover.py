"""Distributed difference-cover suffix sorting: triples are sorted and named, names recursed on, the rest merged, as Spark stages."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_written, split_join, written

#: Symbols that one task sorts by itself: where the recursion ends.
LOCAL = 2_000_000


def _ranks(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Sorted order of keys, the rank of each (equal keys, equal rank, from 1), and the number of ranks."""
    order = np.argsort(keys)
    new = np.concatenate([[1], keys[order][1:] != keys[order][:-1]]).astype(np.int64)
    rank = np.empty(len(keys), np.int64)
    rank[order] = np.cumsum(new)
    return order, rank, int(new.sum())


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Suffix array of a sequence of positive integers, in one process: difference cover modulo 3; under 2**21 of them.

    The triples at places 1 and 2 modulo 3 are sorted and named; if names repeat, the sequence of names is
    sorted by recursion. The places 0 modulo 3 are sorted by (symbol, rank of the next place), and merged: the
    place of a suffix is its own place among its kind and the number of suffixes of the other kinds before it.
    """
    n = len(s)
    if n >= 1 << 21:
        raise ValueError(f"{n} symbols are too many for one process")
    if n < 8:
        return np.array(sorted(range(n), key=lambda i: s[i:].tolist()), np.int64)
    if s.max() >= 1 << 21:
        s = np.unique(s, return_inverse=True)[1] + 1
    t = np.concatenate([s, np.zeros(3, np.int64)]).astype(np.int64)
    one = np.arange(1, n + (n % 3 == 1), 3)  # if the last place is 0 modulo 3, one empty triple ends the first half
    two = np.arange(2, n, 3)
    sample = np.concatenate([one, two])
    order, names, count = _ranks((t[sample] << 42) | (t[sample + 1] << 21) | t[sample + 2])
    if count < len(sample):
        order = suffix_array(names)
    rank = np.zeros(n + 3, np.int64)
    rank[sample[order]] = np.arange(1, len(sample) + 1)
    sample = sample[order]
    sample = sample[sample < n]
    rank[n:] = 0

    zero = np.arange(0, n, 3)
    zero = zero[np.argsort((t[zero] << 42) | rank[zero + 1])]
    first, second = sample[sample % 3 == 1], sample[sample % 3 == 2]
    before = np.searchsorted((t[first] << 42) | rank[first + 1], (t[zero] << 42) | rank[zero + 1])
    pairs = lambda x: (t[x] << 42) | (t[x + 1] << 21) | rank[x + 2]
    before += np.searchsorted(pairs(second), pairs(zero))
    out = np.empty(n, np.int64)
    place = np.arange(len(zero)) + before
    out[place] = zero
    free = np.ones(n, bool)
    free[place] = False
    out[free] = sample
    return out


def _numbers(column: pa.ListArray, row: int) -> np.ndarray:
    value = column[row].values
    return np.zeros(0, np.int64) if value is None else value.to_numpy(zero_copy_only=False).astype(np.int64)


def _batch(names: list[str], found: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(np.int64)) for c in zip(*found)], names=names)


def _places(m: int) -> np.ndarray:
    """The sampled places of m symbols, those 1 modulo 3 first: the order of the sequence of names."""
    return np.concatenate([np.arange(1, m, 3), np.arange(2, m, 3)])


def _triples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found = []
        for row, part in enumerate(b.column("part").to_pylist()):
            s = _numbers(b.column("symbols"), row)
            t, at = np.concatenate([s, [0, 0]]), _places(len(s))
            found.append((np.full(len(at), part), np.arange(len(at)), t[at], t[at + 1], t[at + 2]))
        if found:
            yield _batch(["part", "at", "x", "y", "z"], found)


def _merge_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(kind, x, y, z, part, at, zero): what orders places 0 and 1 modulo 3 (kind 1), and 0 and 2 (kind 2)."""
    for b in batches:
        found = []
        for row, part in enumerate(b.column("part").to_pylist()):
            s, sampled = _numbers(b.column("symbols"), row), _numbers(b.column("sampled"), row)
            m = len(s)
            t, rank = np.concatenate([s, [0, 0]]), np.zeros(m + 3, np.int64)
            rank[_places(m)] = sampled
            zero, one, two = (np.arange(k, m, 3) for k in (0, 1, 2))
            for kind, other in ((1, one), (2, two)):
                at = np.concatenate([zero, other])
                y, z = (rank[at + 1], np.zeros(len(at))) if kind == 1 else (t[at + 1], rank[at + 2])
                found.append((np.full(len(at), kind), t[at], y, z, np.full(len(at), part), at, at % 3 == 0))
        if found:
            yield _batch(["kind", "x", "y", "z", "part", "at", "zero"], found)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(piece, kind, part, at, zero, zeros, others) of sorted rows: rows of each sort before this one, in this task."""
    piece, seen = TaskContext.get().partitionId(), {1: [0, 0], 2: [0, 0]}
    for b in batches:
        kind, part, at, zero = (b.column(c).to_numpy() for c in ("kind", "part", "at", "zero"))
        for k in (1, 2):
            rows = np.flatnonzero(kind == k)
            if len(rows):
                z = zero[rows]
                zeros, others = (np.cumsum(v) - v + s for v, s in zip((z, 1 - z), seen[k]))
                seen[k] = [seen[k][0] + z.sum(), seen[k][1] + len(z) - z.sum()]
                yield _batch(["piece", "kind", "part", "at", "zero", "zeros", "others"], [(np.full(len(rows), piece), kind[rows], part[rows], at[rows], z, zeros, others)])


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(part, ranks): ranks among the sampled places, and what the merge adds to each place."""
    for b in batches:
        ranks = []
        for row in range(b.num_rows):
            m = b.column("m")[row].as_py()
            out = np.zeros(m, np.int64)
            out[::3] = 1
            out[_places(m)] = _numbers(b.column("sampled"), row)
            np.add.at(out, _numbers(b.column("places"), row), _numbers(b.column("before"), row))
            ranks.append(out)
        yield pa.RecordBatch.from_arrays([b.column("part"), pa.array(ranks, pa.list_(pa.int64()))], names=["part", "ranks"])


def _by_one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The ranks of all parts, in one task; at most LOCAL symbols come here."""
    parts, texts = [], []
    for b in batches:
        parts += b.column("part").to_pylist()
        texts += [_numbers(b.column("symbols"), row) for row in range(b.num_rows)]
    if parts:
        s = np.concatenate(texts)
        rank = np.empty(len(s), np.int64)
        rank[suffix_array(np.unique(s, return_inverse=True)[1] + 1)] = np.arange(1, len(s) + 1)
        yield pa.RecordBatch.from_arrays([pa.array(parts), pa.array(np.split(rank, np.cumsum([len(t) for t in texts])[:-1]), pa.list_(pa.int64()))], names=["part", "ranks"])


def _numbered(df: DataFrame, by: list[str], name: str) -> DataFrame:
    """df with its place, from 1, in the order of `by`: a range-partitioned sort, and one offset for each of its partitions."""
    rows = written(df.orderBy(*by).withColumn("_id", F.monotonically_increasing_id()), "sorted")
    piece = F.shiftright("_id", 33)
    offsets, before = [], 0
    for r in rows.groupBy(piece.alias("piece")).count().orderBy("piece").collect():  # a row for each partition
        offsets.append((r["piece"], before))
        before += r["count"]
    offsets = df.sparkSession.createDataFrame(offsets, "piece long, start long")
    out = rows.join(F.broadcast(offsets), piece == F.col("piece")).withColumn(name, F.col("start") + F.col("_id").bitwiseAND(F.lit((1 << 33) - 1)) + 1).drop("_id", "piece", "start")
    out.written_to = rows.written_to
    return out


def suffix_ranks(parts: DataFrame, local: int = LOCAL) -> DataFrame:
    """(part, ranks), written: the place of each suffix, from 1, among the suffixes of all parts (part, symbols).

    Symbols are positive, and the last of a part occurs nowhere else; so no comparison passes the end of a part, and
    the sequence of names of a part (places 1 modulo 3, then 2 modulo 3) is a part of the same kind.
    1. Triples at places 1 and 2 modulo 3 are pre-aggregated, sorted by range partitions, and named by their place.
    2. If names repeat, the sequences of names are sorted by recursion; up to `local` symbols are sorted in one task.
    3. Places 0 modulo 3 are merged: two sorts, with places 1 and with places 2, tell how many come before each.
    A part's symbols are together in one row, as its text was; no task gets more than a share of all rows.
    """
    symbols = parts.agg(F.sum(F.size("symbols"))).first()[0] or 0
    if symbols <= local:
        return written(parts.coalesce(1).mapInArrow(_by_one, "part long, ranks array<long>"), "ranks")
    triples = written(parts.mapInArrow(_triples, "part long, at long, x long, y long, z long"), "triples")
    distinct = _numbered(triples.groupBy("x", "y", "z").agg(F.count("*").alias("rows")), ["x", "y", "z"], "name")
    names, most = distinct.agg(F.count("*"), F.max("rows")).first()
    named = split_join(triples, distinct, ["x", "y", "z"], "rows").groupBy("part").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "name"))), lambda s: s["name"]).alias("symbols"))
    named = written(named, "names")
    drop_written(triples, distinct)
    sampled = named.withColumnRenamed("symbols", "ranks") if most == 1 else suffix_ranks(named, local)
    joined = parts.join(sampled.withColumnRenamed("ranks", "sampled"), "part", "left")
    keys = joined.mapInArrow(_merge_keys, "kind long, x long, y long, z long, part long, at long, zero long")
    counted = keys.orderBy("kind", "x", "y", "z").mapInArrow(_counted, "piece long, kind long, part long, at long, zero long, zeros long, others long")
    counted = written(counted, "counted")
    offsets, before = [], {1: (0, 0), 2: (0, 0)}
    for r in counted.groupBy("piece", "kind").agg(F.sum("zero").alias("zeros"), F.count("*").alias("n")).orderBy("piece").collect():  # two rows for each partition
        z, o = before[r["kind"]]
        offsets.append((r["piece"], r["kind"], z, o))
        before[r["kind"]] = z + r["zeros"], o + r["n"] - r["zeros"]
    offsets = parts.sparkSession.createDataFrame(offsets, "piece long, kind long, z long, o long")
    zeros, others = F.col("zeros") + F.col("z"), F.col("others") + F.col("o")
    value = F.when(F.col("zero") == 0, zeros).when(F.col("kind") == 1, zeros + others).otherwise(others)
    adds = counted.join(F.broadcast(offsets), ["piece", "kind"]).select("part", F.struct("at", value.alias("before")).alias("add"))
    adds = adds.groupBy("part").agg(F.collect_list("add").alias("adds")).select("part", F.col("adds.at").alias("places"), F.col("adds.before").alias("before"))
    out = joined.select("part", F.size("symbols").alias("m"), "sampled").join(adds, "part")
    out = written(out.mapInArrow(_added, "part long, ranks array<long>"), "ranks")
    drop_written(named, counted, *[sampled for _ in range(most > 1)])
    return out
