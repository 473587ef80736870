"""A metric index: distances to pivots are stored, and the triangle inequality says which blocks of vectors need not meet. Exact."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.files import shared_folder
from .vectors import BLOCK, STRIP, Block, _near, nearest_in_blocks, packed

#: Most pivots, vectors that pivots are chosen from, and vectors for each pivot in small tables.
PIVOTS, SAMPLE, EACH = 64, 4_096, 256
#: Share of a distance that rounding may take from a bound.
_SLACK = 1e-9
_ROW = "vec_id long, g string, x array<double>, to_pivots array<double>, cell int"


@dataclass(frozen=True)
class Index:
    """Rows (vec_id, g, x, to_pivots, cell, part), a written table; least and greatest distance of each cell's vectors to each pivot."""

    rows: DataFrame
    pivots: np.ndarray
    low: np.ndarray
    high: np.ndarray


def _kept(df: DataFrame) -> DataFrame:
    spark = df.sparkSession
    path = shared_folder(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def farthest_first(x: np.ndarray, n: int) -> np.ndarray:
    """At most n rows of x, each the farthest from those before it; no two are equal."""
    if not len(x):
        return x
    picked, far = [0], ((x - x[0]) ** 2).sum(1)
    while len(picked) < n and far.max() > 0:
        picked.append(int(far.argmax()))
        far = np.minimum(far, ((x - x[picked[-1]]) ** 2).sum(1))
    return x[picked]


def build(items: DataFrame, group: str | None = "role", pivots: int = PIVOTS, block: int = BLOCK, sample: int = SAMPLE, unit: bool = False) -> Index:
    """The index of items (vec_id, embedding and group): each vector in the cell of its nearest pivot, cells in parts of about `block`.

    Pivots are chosen from at most `sample` vectors, the least by a hash of their id; all vectors are indexed, and results do not
    depend on the choice. A cell that many vectors share, copies of one included, is dealt over parts by a hash of the id. What goes to the
    driver is the sample and pivots * pivots bounds. unit: vectors are brought to length 1 (null vectors stay out).
    Rows without id or group, and vectors that are null, empty or hold null or non-finite components, stay out. Ids are unique; vectors have one length.
    """
    x = F.col("embedding").cast("array<double>")
    finite = F.forall("x", lambda v: F.coalesce(F.abs(v) < float("inf"), F.lit(False)))  # NaN is greater than all
    rows = items.select(F.col("vec_id").cast("long").alias("vec_id"), F.col(group).cast("string").alias("g") if group else F.lit("").alias("g"), x.alias("x"))
    rows = rows.where("vec_id IS NOT NULL AND g IS NOT NULL AND size(x) > 0").where(finite)
    if unit:
        norm = F.sqrt(F.aggregate("x", F.lit(0.0), lambda s, v: s + v * v))
        rows = rows.withColumn("norm", norm).where("norm > 0").withColumn("x", F.transform("x", lambda v: v / F.col("norm"))).drop("norm")
    some = [r.x for r in rows.orderBy(F.xxhash64("vec_id"), "vec_id").select("x").limit(sample).collect()]
    wanted = max(1, min(pivots, -(-rows.count() // EACH)))
    chosen = farthest_first(np.array(some), wanted)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                v = np.array(b["x"].tolist())
                d = np.sqrt(np.stack([((v - p) ** 2).sum(1) for p in chosen], axis=1))
                yield b.assign(to_pivots=list(d), cell=d.argmin(1).astype(np.int32))

    placed = _kept(rows.mapInPandas(place, _ROW))
    parts = placed.groupBy("g", "cell").agg(F.ceil(F.count("*") / block).cast("int").alias("parts"))
    dealt = placed.join(parts, ["g", "cell"]).withColumn("part", F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int")).drop("parts")
    edges = placed.select("cell", F.posexplode("to_pivots").alias("pivot", "d")).groupBy("cell", "pivot").agg(F.min("d").alias("low"), F.max("d").alias("high"))
    low, high = np.full((len(chosen), len(chosen)), np.inf), np.full((len(chosen), len(chosen)), -np.inf)
    for r in edges.collect():
        low[r.cell, r.pivot], high[r.cell, r.pivot] = r.low, r.high
    return Index(_kept(dealt), chosen, low, high)


def _visits(index: Index, rows: DataFrame, reach: Column) -> DataFrame:
    """rows with (to_cell, to_part) for each block that may hold a vector within `reach` (a distance; null: any) of theirs, their own included.

    A cell is left out if some pivot tells that all its vectors are farther away: by the least or the greatest distance between it and them.
    """
    low, high = index.low, index.high

    def bound(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for to_pivots, far in batches:
            out = []
            for at in range(0, len(far), STRIP):
                d = np.array(to_pivots.iloc[at : at + STRIP].tolist())
                least = np.zeros((len(d), len(low)))
                for p in range(d.shape[1]):
                    np.maximum(least, np.maximum(d[:, p : p + 1] - high[:, p], low[:, p] - d[:, p : p + 1]), out=least)
                limit = far.iloc[at : at + STRIP].fillna(np.inf).to_numpy()[:, None]
                out += [np.flatnonzero(r) for r in least <= limit + _SLACK * (1 + d.max(1, keepdims=True))]
            yield pd.Series(out)

    cells = F.pandas_udf(bound, "array<int>")
    parts = index.rows.groupBy(F.col("g"), F.col("cell").alias("to_cell")).agg((F.max("part") + 1).alias("parts"))
    seen = rows.withColumn("to_cell", F.explode(cells("to_pivots", reach))).join(parts, ["g", "to_cell"])
    return seen.withColumn("to_part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts", "to_pivots")


_PAIR = ["g", "cell", "part", "to_cell", "to_part"]


def _sides(index: Index, visits: DataFrame) -> DataFrame:
    """Visitors (left) and, for each pair of blocks with one, the vectors visited: no group has more than two blocks."""
    target = index.rows.select("g", F.col("cell").alias("to_cell"), F.col("part").alias("to_part"), "vec_id", "x")
    met = visits.select(*_PAIR).distinct().join(target, ["g", "to_cell", "to_part"])
    return visits.select(*_PAIR, "vec_id", "x", F.lit(True).alias("left")).unionByName(met.select(*_PAIR, "vec_id", "x", F.lit(False).alias("left")))


def _bounded(index: Index, k: int) -> DataFrame:
    """rows with `near`, the k nearest of their own block as (dist, neighbour), and `reach`, the distance of the last of them (null: fewer than k)."""
    def own(one: pd.DataFrame) -> pd.DataFrame:
        one = one.sort_values("vec_id", ignore_index=True)
        v, ids = np.array(one["x"].tolist()), one["vec_id"].to_numpy()
        row, col, d = _near(v, v, k)
        n = min(k, len(v))
        near = [[{"dist": a, "neighbour": b} for a, b in zip(x, y)] for x, y in zip(d.reshape(-1, n), ids[col].reshape(-1, n))]
        return one.assign(near=near, reach=np.sqrt(d.reshape(-1, n)[:, -1]) if n == k else np.nan)

    schema = f"{_ROW}, part int, near array<struct<dist: double, neighbour: long>>, reach double"
    found = index.rows.select("vec_id", "g", "x", "to_pivots", "cell", "part").groupBy("g", "cell", "part").applyInPandas(own, schema)
    return _kept(found.withColumn("reach", F.nanvl("reach", F.lit(None).cast("double"))))


def nearest(index: Index, k: int) -> DataFrame:
    """For each vector the k nearest of its group, itself included: (vec_id, own, neighbour, dist), squared distances, of equal ones the smaller id.

    Its own block gives k candidates; only blocks that may hold a nearer one than the k found so far, or an equally near one, are visited. Where
    bounds exclude nothing all blocks are, so results are always those of a scan of all with all. A block reads those that it visits (nearest_in_blocks).
    """
    low, high = index.low, index.high

    def visits(block: Block, limit: np.ndarray, cell: int) -> np.ndarray:
        least = np.maximum(block.more - high[cell], low[cell] - block.more).max(1)
        return np.flatnonzero(least <= np.sqrt(limit) + _SLACK * (1 + block.more.max(1)))

    return nearest_in_blocks(*packed(index.rows, ["g", "cell", "part"], "to_pivots"), k, visits)


def within(index: Index, radius: float) -> DataFrame:
    """(a, b, dist) of all pairs a < b of one group whose distance is at most radius; dist is squared. Each pair of blocks meets once."""
    ordered = F.struct("cell", "part") <= F.struct(F.col("to_cell").alias("cell"), F.col("to_part").alias("part"))
    visits = _visits(index, index.rows, F.lit(float(radius))).where(ordered)

    def compare(one: pd.DataFrame) -> pd.DataFrame:
        left, right = one[one["left"]], one[~one["left"]]
        same = (one["cell"].iloc[0], one["part"].iloc[0]) == (one["to_cell"].iloc[0], one["to_part"].iloc[0])
        x, y, a, b = np.array(left["x"].tolist()), np.array(right["x"].tolist()), left["vec_id"].to_numpy(), right["vec_id"].to_numpy()
        y2, out = (y * y).sum(1), [pd.DataFrame({"a": [], "b": [], "dist": []})]
        for at in range(0, len(x), STRIP):
            some = x[at : at + STRIP]
            x2 = (some * some).sum(1)[:, None]
            row, col = np.nonzero(x2 + y2 - 2 * (some @ y.T) <= radius**2 + _SLACK * (x2 + y2.max()))
            d, p, q = ((some[row] - y[col]) ** 2).sum(1), a[row + at], b[col]
            keep = (d <= radius**2) & ((p < q) if same else True)
            out.append(pd.DataFrame({"a": np.minimum(p, q)[keep], "b": np.maximum(p, q)[keep], "dist": d[keep]}))
        return pd.concat(out[1:])

    return _sides(index, visits).groupBy(*_PAIR).applyInPandas(compare, "a long, b long, dist double")


def pruning(index: Index, k: int | None = None, radius: float | None = None) -> DataFrame:
    """One row (block_pairs, compared, pairs_skipped, vectors_skipped) of a search by k or radius: pairs of blocks in both orders, and
    the shares of them, and of (vector, block) visits, that bounds spare."""
    if (k is None) == (radius is None):
        raise ValueError("name k or radius")
    rows = index.rows if k is None else _bounded(index, k).drop("near")
    seen = _visits(index, rows, F.lit(float(radius)) if k is None else F.col("reach"))
    met = seen.groupBy(*_PAIR).count().agg(F.count("*").alias("compared"), F.sum("count").alias("visits"))
    sizes = index.rows.groupBy("g", "cell", "part").count().groupBy("g").agg(F.count("*").alias("blocks"), F.sum("count").alias("n"))
    every = sizes.agg(F.sum(F.col("blocks") * F.col("blocks")).alias("block_pairs"), F.sum(F.col("n") * F.col("blocks")).alias("all_visits"))
    one = every.unionByName(met, allowMissingColumns=True).agg(*[F.coalesce(F.max(c), F.lit(0)).alias(c) for c in ("block_pairs", "all_visits", "compared", "visits")])
    share = lambda part, whole: F.round(1 - F.try_divide(part, whole), 6)
    return one.select("block_pairs", "compared", share("compared", "block_pairs").alias("pairs_skipped"), share("visits", "all_visits").alias("vectors_skipped"))


def cohesion(index: Index, k: int = 5, same: float = 1e-6) -> DataFrame:
    """(vec_id, role, avg_dist) as vectors.cohesion gives them: mean distance to the k + 1 nearest, those nearer than `same` left out."""
    near = nearest(index, k + 1).where(F.col("dist") > same)
    return near.groupBy("vec_id", F.col("own").alias("role")).agg(F.avg("dist").alias("avg_dist"))


def cosine_pairs(items: DataFrame, threshold: float, group: str | None = None, **how: int) -> DataFrame:
    """(a, b, similarity) of all pairs a < b of one group with this cosine or more: a range scan of unit vectors, then the cosine itself.

    |u - v|**2 = 2 - 2 cos, so the radius is a little more than sqrt(2 - 2 * threshold), and what it lets in beyond the threshold goes.
    """
    index = build(items, group, unit=True, **how)
    pairs = within(index, float(np.sqrt(max(0.0, 2 - 2 * threshold)) + _SLACK)).withColumn("similarity", 1 - F.col("dist") / 2)
    return pairs.where(F.col("similarity") >= threshold - 1e-12).select("a", "b", "similarity")
