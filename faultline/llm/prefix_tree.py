"""Prefix trees of globally ordered sets, walked by other sets with bounds on what overlap can still come."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import split_join, written

#: Tokens of the sets of one tree, and of the sets that walk it in one block, about (8 bytes each).
TREE_TOKENS = 1 << 18
#: Tokens of a node at most: bounds are tested at the end of each.
NODE_TOKENS = 32


def needed(n: np.ndarray | int, m: np.ndarray | int, similarity: int):
    """Overlap from which sets of n and m tokens are similar: 100 * both >= similarity * (n + m - both)."""
    return -(-similarity * (n + m) // (100 + similarity))


class PrefixTree:
    """The sets as paths of a tree; a node holds up to NODE_TOKENS tokens that all sets below it share.

    Nodes are numbered level by level. Of each: its parent, its tokens (numbers of the distinct tokens of the
    tree), the depth at its end, sizes of the smallest and the largest set below, the group if all sets below
    have one, and the sets that end there.
    """

    def __init__(self, sets: list[np.ndarray], groups: list[int]):
        order = sorted(range(len(sets)), key=lambda i: sets[i].tobytes())
        paths = [sets[i] for i in order]
        size = np.array([len(p) for p in paths], np.int64)
        group = np.array([groups[i] for i in order], np.int64)
        common = np.array([_shared(a, b) for a, b in zip(paths, paths[1:])], np.int64)
        self.tokens = np.unique(np.concatenate(paths))
        level = [(0, len(paths), 0, -1)]  # sets lo to hi share their first `depth` tokens, which nodes up to `parent` hold
        parents, pieces, ends, smallest, largest, low, high, owner, ended, self.levels = [], [], [], [], [], [], [], [], [], [0]
        while level:
            below = []
            for lo, hi, depth, parent in level:
                deep = int(size[lo]) if hi - lo == 1 else int(min(common[lo : hi - 1].min(), size[lo:hi].min()))
                stop = min(deep, depth + NODE_TOKENS)
                node = len(parents)
                parents.append(parent)
                pieces.append(paths[lo][depth:stop])
                ends.append(stop)
                smallest.append(size[lo:hi].min())
                largest.append(size[lo:hi].max())
                low.append(group[lo:hi].min())
                high.append(group[lo:hi].max())
                if stop < deep:
                    below.append((lo, hi, stop, node))
                    continue
                # Sets are in order: those that end here come first, the others part where neighbours share no more.
                while lo < hi and size[lo] == stop:
                    owner.append(node)
                    ended.append(order[lo])
                    lo += 1
                if lo < hi:
                    cuts = [lo, *(lo + 1 + np.flatnonzero(common[lo : hi - 1] == stop)).tolist(), hi]
                    below += [(a, b, stop, node) for a, b in zip(cuts, cuts[1:])]
            self.levels.append(len(parents))
            level = below
        self.parent, self.end = np.array(parents), np.array(ends, np.int64)
        self.smallest, self.largest = np.array(smallest, np.int64), np.array(largest, np.int64)
        self.low, self.high = np.array(low, np.int64), np.array(high, np.int64)
        self.owner, self.ended = np.array(owner), np.array(ended)
        self.size = np.array([len(s) for s in sets], np.int64)
        self.at = np.concatenate([[0], np.cumsum([len(p) for p in pieces])])
        self.ids = np.searchsorted(self.tokens, np.concatenate(pieces))
        self.mark = np.zeros(len(self.tokens) + 1, np.int32)

    def similar(self, probe: np.ndarray, group: int, similarity: int) -> np.ndarray:
        """Numbers of the sets that are similar to the probe, without subtrees that are wholly of its group.

        Overlaps counted along a shared path are counted once for all sets below. A subtree is left where its
        overlap so far, and the least of what remains of the probe and of its sets, reach no set's need.
        """
        n = len(probe)
        where = np.searchsorted(self.tokens, probe)
        mine = where[self.tokens[np.minimum(where, len(self.tokens) - 1)] == probe]
        self.mark[mine] = 1
        both = np.full(len(self.parent), -1, np.int64)
        fits = (100 * self.largest >= similarity * n) & (100 * n >= similarity * self.smallest) & ~((self.low == group) & (self.high == group))
        need = needed(np.maximum(self.smallest, -(-similarity * n // 100)), n, similarity)
        for first, last in zip(self.levels, self.levels[1:]):
            node = np.arange(first, last)
            up = self.parent[first:last]
            so_far = both[up] if first else np.zeros(1, np.int64)
            node, so_far = node[(so_far >= 0) & fits[first:last]], so_far[(so_far >= 0) & fits[first:last]]
            if not len(node):
                break
            length = self.at[node + 1] - self.at[node]
            edge = np.concatenate([[0], np.cumsum(length)])
            hits = np.concatenate([[0], np.cumsum(self.mark[self.ids[np.arange(edge[-1]) + np.repeat(self.at[node] - edge[:-1], length)]])])
            overlap = so_far + hits[edge[1:]] - hits[edge[:-1]]
            alive = overlap + np.minimum(self.largest[node] - self.end[node], n - overlap) >= need[node]
            both[node[alive]] = overlap[alive]
        self.mark[mine] = 0
        found = self.ended[both[self.owner] >= 0]
        overlap = both[self.owner[both[self.owner] >= 0]]
        return found[overlap >= needed(self.size[found], n, similarity)]


def _shared(a: np.ndarray, b: np.ndarray) -> int:
    k = min(len(a), len(b))
    differ = np.flatnonzero(a[:k] != b[:k])
    return int(differ[0]) if len(differ) else k


def links_in(tree: list[tuple[int, int, np.ndarray]], probes: list[tuple[int, int, np.ndarray]], similarity: int) -> list[tuple[int, int]]:
    """Links (a, b) between sets of different groups, enough to join all groups that links of probes and tree join.

    Members are (set's number, its group, tokens in global order). Pairs of one group tell nothing new.
    """
    if len(tree) == 1 or len(probes) == 1 and len(tree) < 4:  # no path to share
        pairs = ((t, p) for t in tree for p in probes if t[1] != p[1])
        return [(t[0], p[0]) for t, p in pairs if len(np.intersect1d(t[2], p[2], assume_unique=True)) >= needed(len(t[2]), len(p[2]), similarity)]
    paths = PrefixTree([s for _, _, s in tree], [g for _, g, _ in tree])
    label: dict[int, int] = {}

    def root(group: int) -> int:
        while (up := label.get(group, group)) != group:
            group = up
        return group

    out = []
    for number, group, tokens in probes:
        for i in paths.similar(tokens, group, similarity):
            a, b = root(tree[i][1]), root(group)
            if a != b:
                label[max(a, b)] = min(a, b)
                out.append((tree[i][0], number))
    return out


def walk(rows: DataFrame, sets: DataFrame, similarity: int) -> DataFrame:
    """(a, b): links found by walking the tree of each `host` with its probes; rows are (host, probe, rep, n, comp).

    A host's sets are dealt to trees of about TREE_TOKENS tokens, its probes to blocks of as many, and every block
    walks every tree: no host's sets meet in one task, and no pair is a row unless it is a link. `sets` has the
    tokens of each rep in global order (rep, set).
    """
    parts = [F.ceil(F.sum(F.when(F.col("probe") == p, F.col("n")).otherwise(0)) / TREE_TOKENS).alias(k) for k, p in (("trees", False), ("blocks", True))]
    # Without a row here: one tree and one block.
    large = written(rows.groupBy("host").agg(F.count("*").alias("rows"), *parts).where("trees > 1 OR blocks > 1"), "large")
    dealt = split_join(rows, large, ["host"], "rows", "left").withColumn("trees", F.greatest("trees", F.lit(1))).withColumn("blocks", F.greatest("blocks", F.lit(1)))
    own = F.pmod(F.xxhash64("rep"), F.when(F.col("probe"), F.col("blocks")).otherwise(F.col("trees")))
    others = F.sequence(F.lit(0).cast("long"), F.when(F.col("probe"), F.col("trees")).otherwise(F.col("blocks")) - 1)
    dealt = dealt.select("host", "probe", "rep", "comp", own.alias("mine"), others.alias("others"))
    dealt = dealt.join(sets.select("rep", "set"), "rep").select("host", "probe", "rep", "comp", "set", "mine", F.explode("others").alias("other"))
    dealt = dealt.select("host", F.when(F.col("probe"), F.col("other")).otherwise(F.col("mine")).alias("i"), F.when(F.col("probe"), F.col("mine")).otherwise(F.col("other")).alias("j"), "probe", "rep", "comp", "set")
    dealt = dealt.repartition("host", "i", "j").sortWithinPartitions("host", "i", "j", "probe")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, tree, probes = None, [], []
        found: list[tuple[int, int]] = []
        for b in batches:
            for *block, probe, rep, comp, tokens in zip(*(b.column(c).to_pylist() for c in ("host", "i", "j", "probe", "rep", "comp", "set"))):
                if block != key:
                    if tree and probes:
                        found += links_in(tree, probes, similarity)
                    key, tree, probes = block, [], []
                (probes if probe else tree).append((rep, comp, np.frombuffer(tokens, np.uint64)))
            if found:
                yield _pairs(found)
                found = []
        if tree and probes:
            yield _pairs(links_in(tree, probes, similarity))

    return dealt.mapInArrow(run, "a long, b long")


def _pairs(found: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([p[k] for p in found], pa.int64()) for k in (0, 1)], names=["a", "b"])
