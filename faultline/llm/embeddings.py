"""Embedding near-dedup: spherical k-means cells, blocked cosine products inside them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, tune, written

#: Cosine from which two vectors link; vectors that the cells are fitted on, at most (about); vectors a cell, about.
COSINE, SAMPLE, CELL = 0.95, 10_000, 1_000
#: What rounding may take from a distance to a border.
ROUNDING = 1e-6
#: Vectors of a block, and cells at most.
BLOCK, CELLS = 4_000, 4_096
#: Cells of vectors of other lengths than the most frequent one.
ODD_CELLS = 256


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one; scaled by their largest component first, so that squares neither overflow nor vanish."""
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _odd_cell(width: int) -> int:
    """The cell of vectors that are not as long as most: by length, without k-means; always negative."""
    return -1 - width % ODD_CELLS


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 9) -> np.ndarray:
    """k unit centroids of the unit rows of x; a cell that empties keeps its centroid."""
    rng = np.random.default_rng(seed)
    c = x[np.sort(rng.choice(len(x), k, replace=False))]
    for _ in range(rounds):
        at = (x @ c.T).argmax(1)
        sums = np.zeros_like(c)
        np.add.at(sums, at, x)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        c = np.where(size > 1e-12, sums / np.maximum(size, 1e-12), c)
    return c


def sure_margin(cosine: float) -> float:
    """Half the distance of unit vectors of this cosine: two that a border parts are not both further than this from it."""
    return float(np.sqrt(max(0.0, (1 - cosine) / 2))) + ROUNDING


def visits(x: np.ndarray, c: np.ndarray, margin: float) -> tuple[np.ndarray, list[np.ndarray]]:
    """The cell of each unit row of x, and the cells it visits (its own among them)."""
    near = x @ c.T
    home = near.argmax(1)
    gap = near[np.arange(len(x)), home][:, None] - near
    apart = np.sqrt(np.maximum(2 - 2 * (c @ c.T), 0))[home]  # |h - c|: gap / apart is the distance to the border
    inside = gap <= margin * apart + ROUNDING
    inside[np.arange(len(x)), home] = True
    return home, [np.flatnonzero(row) for row in inside]


def links_of(x: np.ndarray, y: np.ndarray, same: np.ndarray, weight: np.ndarray, cosine: float, back: np.ndarray, which: np.ndarray, unmet: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]:
    """For each row of x, the weight of the rows of y with this cosine at least, itself left out; for each row of y, that of the rows of x it does not visit; and edges that connect the linked.

    back[i] is the weight of row i of x, unmet[which[i], j] whether row j of y does not visit its home. `same[i]` is the row of y that is x's row i, or -1. Products are made for 512 rows at a time, and an edge
    (row of x, row of y) is kept only if it joins parts that were apart: at most rows - 1 of them.
    """
    count, returned, edges = np.zeros(len(x), np.int64), np.zeros(len(y), np.int64), []
    label = np.arange(len(y) + len(x))
    own = np.where(same >= 0, same, len(y) + np.arange(len(x)))
    for at in range(0, len(x), 512):
        hit = x[at : at + 512] @ y.T >= cosine
        rows = np.flatnonzero(same[at : at + 512] >= 0)
        hit[rows, same[at : at + 512][rows]] = False
        count[at : at + 512] = hit @ weight
        i, j = np.nonzero(hit)
        lone = unmet[which[at + i], j]
        np.add.at(returned, j[lone], back[at + i[lone]])
        for i in np.flatnonzero(hit.any(1)):
            others = np.flatnonzero(hit[i])
            labels, first = np.unique(label[others], return_index=True)
            mine = label[own[at + i]]
            for l, f in zip(labels, first):
                if l != mine:
                    edges.append((at + i, int(others[f])))
                    label[label == l] = mine
    return count, returned, edges


def near_dedup(vectors: DataFrame, cosine: float = COSINE, sample: int = SAMPLE, cell: int = CELL, margin: float | None = None, block: int = BLOCK, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """Links of cosine >= `cosine` between vectors, and one representative (the smallest id) of each linked group.

    Equal vectors are taken together first. Cells come from a spherical k-means fitted on about `sample` vectors
    (all, if fewer), one cell for about `cell` vectors; every vector goes to its own cell and visits those
    whose border it is within `margin` of, so that neighbours across a border meet. In each cell, visitors and
    members are compared with the members in blocks of `block` vectors by products in double precision. Blocks
    return sums of links and edges enough to connect, never all pairs. A hit counts for both vectors: for the
    member in this block if it does not visit the visitor's home, else in the block where it is the visitor.
    A pair is missed only if both are further than `margin` from the border between their cells, and those two
    distances sum up to the vectors' own distance at most. The margin of `sure_margin` (0.158 at a cosine of 0.95),
    taken if none is given, is half of that, so that no pair is missed.
    Returns vec_id, n_links, component_id, kept.
    Cells are fitted for the most frequent length; vectors of other lengths are compared with those of their own,
    in blocks, without cells. Beyond CELLS * cell vectors (some 4 million) cells grow with the table: still exact,
    still in blocks of bounded size, but their number then grows with the square of a cell.
    Defined cases: vectors that are null, empty, zero, or hold null or non-finite components link with nothing, and
    vectors of different length not with each other; each row counts as a vector of its own, also if rows or ids
    repeat (then ids share what their rows link with); null ids are kept, as ids before all others; an empty
    table gives no rows; other columns are ignored.
    """
    spark = vectors.sparkSession
    tune(spark)
    margin = sure_margin(cosine) if margin is None else margin
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("x"))
    usable = F.col("x").isNotNull() & F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("x", lambda v: v != 0)
    rows = rows.withColumn("usable", F.coalesce(usable, F.lit(False))).withColumn("own", F.coalesce("vec_id", F.lit(-(1 << 62))))
    classes = written(rows.where("usable").groupBy("x").agg(F.min("own").alias("v"), F.count("*").alias("m")), "classes")
    usual = classes.groupBy(F.size("x").alias("width")).count().orderBy(F.desc("count"), "width").first()
    if usual is None:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    width, total = usual
    share = min(1.0, sample / total)
    picked = classes.where((F.size("x") == width) & (F.pmod(F.xxhash64(F.lit(1), "x"), F.lit(1_000_000)) < max(1, int(1_000_000 * share))))
    # In an order of their own, so that the cells do not depend on the partitioning.
    fitted = np.array(picked.select(F.xxhash64("x").alias("h"), "x").orderBy("h", "x").toPandas()["x"].tolist())
    fitted = _unit(fitted) if len(fitted) else np.eye(1, width)
    k = int(min(CELLS, len(fitted), max(1, total // cell)))
    centroids = spark.sparkContext.broadcast(spherical_kmeans(fitted, k))

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            widths = b["x"].map(len).to_numpy()
            for w in np.unique(widths):
                some = b[widths == w]
                x = _unit(np.array(some["x"].tolist(), np.float64))
                home, cells = visits(x, centroids.value, margin) if w == width else (np.full(len(x), _odd_cell(w)), [[_odd_cell(w)]] * len(x))
                yield pd.DataFrame({"v": some["v"], "c": some["c"], "m": some["m"], "x": [r.tobytes() for r in x], "home": home, "cells": cells})

    # Rows of `c`: the class by a hash of its vector, for the products' bookkeeping.
    named = classes.withColumn("c", F.xxhash64("x"))
    assigned = written(named.select("v", "c", "m", "x").mapInPandas(assign, "v long, c long, m long, x binary, home int, cells array<int>"), "cells")
    members = {r["home"]: r["count"] for r in assigned.groupBy("home").count().collect()}  # a number a cell: CELLS + ODD_CELLS at most
    parts = F.element_at(F.create_map(*[F.lit(int(n)) for cell_, count in members.items() for n in (cell_, -(-count // block))]), F.col("cell"))
    spread = assigned.select("v", "c", "m", "x", "home", "cells", F.explode("cells").alias("cell")).withColumn("parts", F.coalesce(parts, F.lit(0))).where("parts > 0")
    spread = spread.withColumn("part", F.pmod(F.xxhash64(F.lit(2), "c"), F.col("parts")).cast("int")).withColumn("is_home", F.col("home") == F.col("cell"))
    # Block (i, j) of a cell compares part i of all with part j of the members.
    places = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda j: F.struct(F.col("part").alias("i"), j.alias("j"), F.lit(True).alias("left"), (F.col("is_home") & (j == F.col("part"))).alias("right")))
    across = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda i: F.struct(i.alias("i"), F.col("part").alias("j"), F.lit(False).alias("left"), F.lit(True).alias("right")))
    across = F.filter(across, lambda p: F.col("is_home") & (p["i"] != F.col("part")))
    spread = spread.select("v", "c", "m", "x", "home", "cells", "cell", F.explode(F.concat(places, across)).alias("p")).select("v", "c", "m", "x", "home", "cells", "cell", "p.*")

    def compare(one: pd.DataFrame) -> pd.DataFrame:
        return pd.concat([compared(some) for _, some in one.groupby(one["x"].map(len))])

    def compared(one: pd.DataFrame) -> pd.DataFrame:
        left, right = one[one["left"]], one[one["right"]]
        if not len(left) or not len(right):
            return pd.DataFrame({"a": [], "b": [], "n": []}).astype("int64")
        x, y = (np.frombuffer(b"".join(s["x"]), np.float64).reshape(len(s), -1) for s in (left, right))
        at = {c: i for i, c in enumerate(right["c"])}
        same = np.array([at.get(c, -1) for c in left["c"]])
        homes, which = np.unique(left["home"], return_inverse=True)
        unmet = np.array([~np.isin(homes, c) for c in right["cells"]]).T
        count, returned, edges = links_of(x, y, same, right["m"].to_numpy(), cosine, left["m"].to_numpy(), which, unmet)
        some, more = np.flatnonzero(count), np.flatnonzero(returned)
        lv, rv, lc, rc = left["v"].to_numpy(), right["v"].to_numpy(), left["c"].to_numpy(), right["c"].to_numpy()
        e = np.array(edges, np.int64).reshape(-1, 2)
        return pd.DataFrame({"a": np.concatenate([lc[some], rc[more], lv[e[:, 0]]]), "b": np.concatenate([np.zeros(len(some) + len(more), np.int64), rv[e[:, 1]]]), "n": np.concatenate([count[some], returned[more], np.zeros(len(e), np.int64)])})

    found = written(spread.groupBy("cell", "i", "j").applyInPandas(compare, "a long, b long, n long"), "links")
    counts = found.where("n > 0").groupBy(F.col("a").alias("c")).agg(F.sum("n").alias("n"))
    # Rows of one vector share a class; its ids are joined to its smallest one.
    ids = rows.where("usable").select("x", "own").join(classes, "x").select(F.col("own").alias("a"), F.col("v").alias("b"))
    groups = components(found.where("n = 0").select("a", "b").unionByName(ids.where("a <> b")))
    per_class = named.join(counts, "c", "left").select("x", (F.coalesce("n", F.lit(0)) + F.col("m") - 1).alias("n_links"))
    out = rows.join(per_class, "x", "left").join(groups, F.col("own") == F.col("id"), "left")
    component = F.coalesce("component", "own")
    component = F.when(component == -(1 << 62), F.lit(None).cast("long")).otherwise(component)
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), component.eqNullSafe(F.col("vec_id")).alias("kept"))
