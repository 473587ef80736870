"""Vector search and scans over (failure_id, role, vec_id, embedding): squared-L2 distances, exact."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyarrow import parquet as pq
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.files import shared_folder

#: Weight of a hit by the role it was found in.
ROLE_WEIGHTS = {"failure_mode": 0.5, "failure_element": 0.4, "failure_effect": 0.3}
#: Vectors of a block in scans that compare all with all; rows of a block that are multiplied at once.
BLOCK, STRIP = 4_000, 512
#: Vectors of a block at most, and blocks from which on they are filled so far, where each vector is sent to all blocks.
WIDE, SIDES = 32_000, 8
#: Candidates for each of k neighbours that are too many for single precision; pairs whose distances are summed up at once.
MANY, PAIRS = 16, 65_536
#: Blocks of one group that a block meets in one task; such tasks at most.
STRIPE, TASKS = 64, 20_000
#: Causes of one failure that are compared at once with as many of another one.
PAIRED = 2_000


def squared_l2(a: Column, b: Column) -> Column:
    """Sum of squared differences in double precision, from the first component on; JVM-side."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, v: s + v)


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def cosine(a: Column, b: Column) -> Column:
    return _dot(a, b) / (F.sqrt(_dot(a, a)) * F.sqrt(_dot(b, b)))


def literal(vector: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in vector])


def search_roles(vectors: DataFrame, queries: Mapping[str, Sequence[float] | None], k: int) -> DataFrame:
    """The k nearest vectors of each queried role: (failure_id, role, vec_id, dist). Roles without a query are skipped.

    Query vectors are literals, so this is one scan, a filter on role and a per-role limit before the shuffle.
    """
    asked = {r: v for r, v in queries.items() if v is not None}
    if not asked:
        return vectors.select("failure_id", "role", "vec_id", F.lit(0.0).alias("dist")).limit(0)
    dist = F.lit(None).cast("double")
    for role, vector in asked.items():
        dist = F.when(F.col("role") == role, squared_l2(F.col("embedding"), literal(vector))).otherwise(dist)
    near = Window.partitionBy("role").orderBy("dist", "vec_id")
    hits = vectors.where(F.col("role").isin(*asked)).select("failure_id", "role", "vec_id", dist.alias("dist"))
    return hits.withColumn("place", F.row_number().over(near)).where(F.col("place") <= k).drop("place")


def merge_hits(hits: DataFrame, weights: Mapping[str, float] = ROLE_WEIGHTS) -> DataFrame:
    """(failure_id, score, n_roles): weighted sum of 1 - distance over the hits, and how many roles hit."""
    w = F.lit(0.0)
    for role, weight in weights.items():
        w = F.when(F.col("role") == role, F.lit(weight)).otherwise(w)
    return hits.groupBy("failure_id").agg(F.sum(w * (1 - F.col("dist"))).alias("score"), F.countDistinct("role").alias("n_roles"))


def search_failures(vectors: DataFrame, queries: Mapping[str, Sequence[float] | None], k: int = 5) -> DataFrame:
    """The k best failures by merged score, then number of roles, then id."""
    return merge_hits(search_roles(vectors, queries, k)).orderBy(F.desc(F.round("score", 9)), F.desc("n_roles"), "failure_id").limit(k)


def search_failures_batch(vectors: DataFrame, k: int = 5) -> DataFrame:
    """search_failures() with every failure's own vectors as the query: (query_id, failure_id, score, n_roles, place), k rows a query.

    One scan of all with all in blocks instead of a search for each query.
    """
    near = nearest_of_own(vectors, k)
    of = vectors.select("vec_id", "failure_id")
    hits = near.join(of.withColumnRenamed("failure_id", "query_id"), "vec_id").select("query_id", F.col("own").alias("role"), F.col("neighbour").alias("vec_id"), "dist").join(of, "vec_id")
    w = F.lit(0.0)
    for role, weight in ROLE_WEIGHTS.items():
        w = F.when(F.col("role") == role, F.lit(weight)).otherwise(w)
    merged = hits.groupBy("query_id", "failure_id").agg(F.sum(w * (1 - F.col("dist"))).alias("score"), F.countDistinct("role").alias("n_roles"))
    best = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), F.desc("n_roles"), "failure_id")
    return merged.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k)


def search_causes(causes: DataFrame, query: Sequence[float], k: int = 5, failure_id: int | str | None = None) -> DataFrame:
    """The k nearest causes, of one failure if asked for: (failure_id, cause_id, dist)."""
    if failure_id is not None:
        causes = causes.where(F.col("failure_id") == failure_id)
    return causes.select("failure_id", "cause_id", squared_l2(F.col("embedding"), literal(query)).alias("dist")).orderBy("dist", "cause_id").limit(k)


def search_sentences(vectors: DataFrame, query: Sequence[float], k: int = 10, failure_id=None, cause_id=None, roles: Sequence[str] | None = None) -> DataFrame:
    """The k nearest sentences that meet all given conditions; an empty cause id is a condition, None is none."""
    if failure_id is not None:
        vectors = vectors.where(F.col("failure_id") == failure_id)
    if cause_id is not None:
        vectors = vectors.where(F.col("cause_id") == cause_id)
    if roles:
        vectors = vectors.where(F.col("role").isin(*roles))
    return vectors.withColumn("dist", squared_l2(F.col("embedding"), literal(query))).drop("embedding").orderBy("dist", "sentence_id").limit(k)


def evidence_chain(vectors: DataFrame, failures: DataFrame, causes: DataFrame, evidence: DataFrame, queries: Mapping[str, Sequence[float] | None], cause_query: Sequence[float], k_failure: int = 3, k_cause: int = 5) -> DataFrame:
    """Failure to cause to evidence as one plan: (failure_id, score, cause_id, dist, sentence_ids).

    `failures` has failure_id; `causes` failure_id, cause_id, embedding, sentence_ids; `evidence` sentence_id.
    Unknown failures and sentences drop out; failures without a cause do, by the inner join. The top failures are
    at most k_failure rows, so they are broadcast; evidence is joined after the top causes are known.
    """
    top = search_failures(vectors, queries, k_failure).join(failures.select("failure_id").distinct(), "failure_id", "left_semi")
    near = Window.partitionBy("failure_id").orderBy("dist", "cause_id")
    hits = causes.join(F.broadcast(top.select("failure_id", "score")), "failure_id").withColumn("dist", squared_l2(F.col("embedding"), literal(cause_query)))
    hits = hits.withColumn("place", F.row_number().over(near)).where(F.col("place") <= k_cause).select("failure_id", "score", "cause_id", "dist", F.posexplode_outer("sentence_ids").alias("ord", "sentence_id"))
    known = hits.join(evidence.select("sentence_id", F.lit(True).alias("known")).distinct(), "sentence_id", "left")
    ordered = F.array_sort(F.collect_list(F.when(F.col("known"), F.struct("ord", "sentence_id"))))
    return known.groupBy("failure_id", "score", "cause_id", "dist").agg(F.transform(ordered, lambda s: s["sentence_id"]).alias("sentence_ids"))


def _near(x: np.ndarray, y: np.ndarray, k: int, limit: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of x, row of y, squared distance) of the k nearest rows of y for each row of x, of equal ones the first.

    Products in single precision (where they can't overflow) tell which rows can be among them, to within a bound of their rounding; the distances
    of those are then summed up from differences. limit: squared distances beyond which a row needs no neighbours (infinite: none), so that it may get fewer.
    """
    rows, cols, dists = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
    x2, y2, k = (x * x).sum(1), (y * y).sum(1), min(k, len(y))
    kinds = [np.float32, np.float64] if max(np.abs(v).max(initial=0) for v in (x, y, y2)) < 1e15 else [np.float64]
    # Half a squared distance without the half square of x's row, as one product.
    left, right = np.column_stack([x, np.ones(len(x))]), np.column_stack([-y, y2 / 2])
    sides = {kind: (left.astype(kind), right.astype(kind)) for kind in kinds}
    largest = y2[np.isfinite(y2)].max(initial=0)
    slack = (2 * x.shape[1] + 10) * np.sqrt((x2 + 1) * (largest + largest**2 / 4))
    # Strips have STRIP * BLOCK products at most, however long y is.
    step = max(1, min(STRIP, STRIP * BLOCK // max(1, len(y))))
    for at in range(0, len(x), step):
        some = x[at : at + step]
        for kind in kinds:
            rough = sides[kind][0][at : at + step] @ sides[kind][1].T
            far = np.full(len(some), np.inf) if limit is None else (limit[at : at + step] - x2[at : at + step]) / 2
            if len(free := np.flatnonzero(np.isinf(far))):
                far[free] = np.partition(rough[free], k - 1, axis=1)[:, k - 1]
            far += slack[at : at + step] * np.finfo(kind).eps + 1e-34
            pairs = np.flatnonzero(rough <= np.nextafter(far.astype(kind), kind(np.inf))[:, None])
            if len(pairs) <= MANY * k * len(some):  # else nearer to each other than single precision can tell
                break
        row, col = np.divmod(pairs, len(y))
        d = np.empty(len(row))
        for i in range(0, len(row), PAIRS):
            d[i : i + PAIRS] = ((some[row[i : i + PAIRS]] - y[col[i : i + PAIRS]]) ** 2).sum(1)
        order = np.lexsort((col, d, row))
        row, col, d = row[order], col[order], d[order]
        keep = _first(row, k, len(some))
        rows.append(row[keep] + at)
        cols.append(col[keep])
        dists.append(d[keep])
    return np.concatenate(rows), np.concatenate(cols), np.concatenate(dists)


def _first(row: np.ndarray, k: int, n: int) -> np.ndarray:
    """Which of sorted row numbers below n are among the first k of their row."""
    return np.arange(len(row)) - np.searchsorted(row, np.arange(n))[row] < k


@dataclass(frozen=True)
class Block:
    """Vectors of a group, by id; more: what else is kept of each, a row of numbers."""

    ids: np.ndarray
    x: np.ndarray
    more: np.ndarray


def packed(rows: DataFrame, by: list[str], more: str | None = None) -> tuple[DataFrame, str]:
    """(by, file) of blocks and their folder: the vectors (vec_id, x) of each value of `by` in a file, written once for all blocks that meet them."""

    def pack(one: pa.Table) -> pa.Table:
        one = one.sort_by("vec_id").combine_chunks()
        flat = lambda c: one[c].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).tobytes() if c else b""
        return pa.table({**{c: one[c].slice(0, 1) for c in by}, "ids": [one["vec_id"].to_numpy().astype(np.int64).tobytes()], "x": pa.array([flat("x")], pa.binary()), "more": pa.array([flat(more)], pa.binary())})

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    folder = shared_folder(rows.sparkSession)
    blocks = rows.select(*by, "vec_id", "x", *([more] if more else [])).groupBy(*by).applyInArrow(pack, ", ".join([*(f"{c} {kinds[c]}" for c in by), "ids binary", "x binary", "more binary"]))
    blocks.write.option("maxRecordsPerFile", 1).parquet(folder)
    read = rows.sparkSession.read.schema(", ".join(f"{c} {kinds[c]}" for c in by)).parquet(folder)
    return read.select(*by, F.col("_metadata.file_name").alias("file")), folder


def _loader(folder: str) -> Callable[[str], Block]:
    system, root = fs.FileSystem.from_uri(folder)

    def load(file: str) -> Block:
        with system.open_input_file(f"{root}/{file}") as f:
            one = pq.read_table(f, columns=["ids", "x", "more"])
        ids, *flat = (np.frombuffer(one[c][0].as_buffer(), kind) for c, kind in (("ids", np.int64), ("x", np.float64), ("more", np.float64)))
        return Block(ids, *(v.reshape(len(ids), -1) for v in flat))

    return load


def nearest_in_blocks(blocks: DataFrame, folder: str, k: int, visits: Callable[[Block, np.ndarray, int], np.ndarray] | None = None) -> DataFrame:
    """(vec_id, own, neighbour, dist) of the k nearest of each vector of packed() blocks (g, file and, for visits, cell) in its group, of equal ones the smaller id.

    A task has one block and reads those of its group from their files, STRIPE of them at most, one after the other, with the k best so far: nothing is sent
    to the blocks it meets, so disk grows with the vectors alone, and time with their square. What leaves a task are k rows a vector.
    visits(block, limit, cell): rows of the block that may find vectors of the cell within a squared distance of limit.
    """
    cell = "cell" if "cell" in blocks.columns else F.lit(0).alias("cell")
    # Names of files alone: one row a block.
    listed = blocks.select("g", F.struct("file", cell).alias("b"))
    place = Window.partitionBy("g").orderBy("b.file")
    stripes = listed.withColumn("stripe", F.floor((F.row_number().over(place) - 1) / STRIPE)).groupBy("g", "stripe").agg(F.collect_list("b").alias("others"))
    tiles = blocks.select("g", "file").join(stripes, "g").select("g", "file", F.col("others.file").alias("files"), F.col("others.cell").alias("cells"))
    n = max(1, min(TASKS, tiles.count()))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        load = _loader(folder)
        for g, file, files, cells in (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns))):
            mine = load(file)
            size = len(mine.ids)
            row, col, d = _near(mine.x, mine.x, k)
            own, limit = (row, mine.ids[col], d), np.full(size, np.inf)
            row, ids, d = (v[:0] for v in own)

            def nearer(row: np.ndarray, d: np.ndarray) -> np.ndarray:
                full = np.bincount(row, minlength=size) >= k
                last = np.searchsorted(row, np.arange(size), side="right") - 1
                return np.where(full, np.minimum(limit, d[last] if len(d) else np.inf), limit)

            limit = nearer(own[0], own[2])
            for other, of in zip(files, cells):
                if other == file:
                    found = own
                else:
                    rows = np.arange(size) if visits is None else visits(mine, limit, of)
                    if not len(rows):
                        continue
                    block = load(other)
                    r, c, e = _near(mine.x[rows], block.x, k, limit[rows])
                    found = (rows[r], block.ids[c], e)
                row, ids, d = (np.concatenate(v) for v in zip((row, ids, d), found))
                order = np.lexsort((ids, d, row))
                order = order[_first(row[order], k, size)]
                row, ids, d = row[order], ids[order], d[order]
                limit = nearer(row, d)
            for at in range(0, len(row), 50_000):
                part = slice(at, at + 50_000)
                yield pa.RecordBatch.from_pydict({"vec_id": mine.ids[row[part]], "own": pa.repeat(g, len(row[part])), "neighbour": ids[part], "dist": d[part]})

    found = tiles.repartition(n).mapInArrow(compare, "vec_id long, own string, neighbour long, dist double")
    best = Window.partitionBy("vec_id", "own").orderBy("dist", "neighbour")
    return found.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k).drop("place")


def nearest(items: DataFrame, k: int, group: str | None = "role", block: int | None = None) -> DataFrame:
    """For each vector its k nearest of each value of `group` (of all, if None): (vec_id, own, other, neighbour, dist).

    Exact, so all are compared with all, in blocks: blocks hold `block` vectors (if None, BLOCK of them, and up to WIDE
    where there would be more than SIDES blocks, as each vector is sent to all of them), each pair of blocks is one group of bounded size, one matrix product and k rows a vector, and the k best of those are picked. `own` and `other`
    are the groups of both; the vector itself counts among its neighbours.
    """
    rows = items.select("vec_id", F.col(group).cast("string").alias("g") if group else F.lit("").alias("g"), F.col("embedding").alias("x"))
    count = rows.count()
    n = max(1, -(-count // block) if block else max(-(-count // WIDE), min(-(-count // BLOCK), SIDES)))
    rows = rows.withColumn("part", F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int"))
    every = F.sequence(F.lit(0), F.lit(n - 1))
    pairs = rows.withColumn("left", F.lit(True)).withColumn("i", F.col("part")).withColumn("j", F.explode(every))
    pairs = pairs.unionByName(rows.withColumn("left", F.lit(False)).withColumn("j", F.col("part")).withColumn("i", F.explode(every)))

    def compare(one: pd.DataFrame) -> pd.DataFrame:
        left, right = one[one["left"]], one[~one["left"]]
        out = [pd.DataFrame({"vec_id": [], "own": [], "other": [], "neighbour": [], "dist": []})]
        if len(left) and len(right):
            x, names, own = np.array(left["x"].tolist(), np.float64), left["vec_id"].to_numpy(), left["g"].to_numpy()
            for g, mine in right.groupby("g", sort=True):
                mine = mine.sort_values("vec_id")
                row, col, d = _near(x, np.array(mine["x"].tolist(), np.float64), k)
                out.append(pd.DataFrame({"vec_id": names[row], "own": own[row], "other": np.full(len(row), g, dtype=object), "neighbour": mine["vec_id"].to_numpy()[col], "dist": d}))
        return pd.concat(out[1:] or out)

    found = pairs.groupBy("i", "j").applyInPandas(compare, "vec_id long, own string, other string, neighbour long, dist double")
    best = Window.partitionBy("vec_id", "other").orderBy("dist", "neighbour")
    return found.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k).drop("place")


def nearest_of_own(items: DataFrame, k: int, group: str | None = "role", block: int = BLOCK) -> DataFrame:
    """nearest() among the vectors of one's own group only: blocks hold one group each, so groups never meet. Rows without id or group stay out."""
    rows = items.select("vec_id", F.col(group).cast("string").alias("g") if group else F.lit("").alias("g"), F.col("embedding").cast("array<double>").alias("x")).where("g IS NOT NULL AND vec_id IS NOT NULL")
    # One row a group, and one number: how many blocks its vectors fill.
    parts = rows.groupBy("g").agg(F.ceil(F.count("*") / block).cast("int").alias("parts"))
    rows = rows.join(parts, "g").withColumn("part", F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int"))
    return nearest_in_blocks(*packed(rows, ["g", "part"]), k)


def cohesion(items: DataFrame, k: int = 5, group: str | None = "role", same: float = 1e-6) -> DataFrame:
    """(vec_id, role, avg_dist): mean distance to the k + 1 nearest of one's own role, those nearer than `same` left out."""
    near = nearest_of_own(items, k + 1, group).where(F.col("dist") > same)
    return near.groupBy("vec_id", F.col("own").alias("role")).agg(F.avg("dist").alias("avg_dist"))


def cohesion_outliers(scan: DataFrame, sigmas: float = 2.0) -> DataFrame:
    """Rows of cohesion() beyond mean + sigmas * population deviation of their role; one row a role is joined back."""
    limits = scan.groupBy("role").agg((F.avg("avg_dist") + sigmas * F.stddev_pop("avg_dist")).alias("limit"))
    return scan.join(F.broadcast(limits), "role").where(F.col("avg_dist") > F.col("limit")).select("vec_id", "role", "avg_dist", "limit")


def isolated(scan: DataFrame, limit: float = 0.85) -> DataFrame:
    """Rows of cohesion() beyond a fixed distance; the scan is reused, not repeated."""
    return scan.where(F.col("avg_dist") > limit)


def role_confusion(items: DataFrame, k: int = 3, margin: float = 0.1, relative: bool = True) -> DataFrame:
    """Vectors nearer to another role than to their own: (vec_id, role, best_role, current, best).

    Relative: mean of the k nearest a role, the vector itself left out, and (current - best) / current beyond
    the margin. Absolute: the nearest one a role, itself included, and current - best beyond the margin.
    """
    # Of one's own role the vector itself is left out of a mean; the least distance needs one row.
    near = nearest(items, k + 1 if relative else 1)
    if relative:
        near = near.where(F.col("vec_id") != F.col("neighbour"))
        best_k = Window.partitionBy("vec_id", "other").orderBy("dist", "neighbour")
        near = near.withColumn("place", F.row_number().over(best_k)).where(F.col("place") <= k)
    by_role = near.groupBy("vec_id", "own", "other").agg((F.avg("dist") if relative else F.min("dist")).alias("d"))
    rank = F.when(F.col("other") == "failure_element", 0).when(F.col("other") == "failure_mode", 1).otherwise(2)
    per = by_role.groupBy("vec_id", F.col("own").alias("role")).agg(F.max(F.when(F.col("own") == F.col("other"), F.col("d"))).alias("current"), F.min(F.struct("d", rank.alias("rank"), F.col("other").alias("role"))).alias("b"))
    per = per.select("vec_id", "role", F.col("b.role").alias("best_role"), "current", F.col("b.d").alias("best"))
    gap = F.col("current") - F.col("best")
    return per.where((F.col("best_role") != F.col("role")) & ((F.col("current") > 0) & (gap / F.col("current") > margin) if relative else gap > margin))


def _in_blocks(rows: DataFrame, key: str, block: int) -> DataFrame:
    """rows twice, as `left` and not, with (i, j): group (i, j) meets part i with part j, i <= j, so each pair of parts once."""
    n = max(1, -(-rows.select(key).distinct().count() // block))
    rows = rows.withColumn("part", F.pmod(F.xxhash64(key), F.lit(n)).cast("int"))
    left = rows.withColumn("left", F.lit(True)).withColumn("i", F.col("part")).withColumn("j", F.explode(F.sequence(F.col("part"), F.lit(n - 1))))
    right = rows.withColumn("left", F.lit(False)).withColumn("j", F.col("part")).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("part"))))
    return left.unionByName(right)


def _unit(x: pd.Series) -> np.ndarray:
    v = np.array(x.tolist(), np.float64)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def near_duplicate_failures(items: DataFrame, threshold: float = 0.92, weights: Mapping[str, float] = ROLE_WEIGHTS, block: int = BLOCK) -> DataFrame:
    """Failure pairs whose weighted cosines over common roles sum to the threshold: (failure_a, failure_b, score, roles).

    All with all, exact: a pair of blocks holds all roles of its failures, so pairs are summed up inside, and
    only those from the threshold on leave it.
    """
    rows = items.select("failure_id", "role", F.col("embedding").alias("x")).where(F.col("role").isin(*weights))

    def compare(one: pd.DataFrame) -> pd.DataFrame:
        same = one["i"].iloc[0] == one["j"].iloc[0]
        sides = [one[one["left"]], one[~one["left"]]]
        ids = [np.unique(s["failure_id"]) for s in sides]
        roles = sorted(weights)
        sets = []
        for n, role in enumerate(roles):
            mine = [s[s["role"] == role] for s in sides]
            if len(mine[0]) and len(mine[1]):
                at = [np.searchsorted(i, m["failure_id"]) for i, m in zip(ids, mine)]
                order = np.argsort(at[0], kind="stable")
                sets.append((n, weights[role], at[0][order], at[1], _unit(mine[0]["x"])[order], _unit(mine[1]["x"])))
        out = [pd.DataFrame({"failure_a": [], "failure_b": [], "score": [], "roles": []})]
        # STRIP failures of the left at a time, with all of the right: no matrix of the whole block.
        for low in range(0, len(ids[0]), STRIP):
            size = min(STRIP, len(ids[0]) - low)
            score, shared = np.zeros([size, len(ids[1])]), np.zeros([size, len(ids[1])], np.int16)
            for n, weight, a, b, x, y in sets:
                first, last = np.searchsorted(a, [low, low + size])
                if first < last:
                    np.add.at(score, np.ix_(a[first:last] - low, b), weight * (x[first:last] @ y.T))
                    shared[np.ix_(np.unique(a[first:last]) - low, np.unique(b))] |= 1 << n
            row, col = np.nonzero((score >= threshold) & (shared > 0))
            a, b = ids[0][row + low], ids[1][col]
            keep = a < b if same else a != b
            named = [",".join(r for n, r in enumerate(roles) if s >> n & 1) for s in shared[row, col][keep]]
            out.append(pd.DataFrame({"failure_a": np.minimum(a, b)[keep], "failure_b": np.maximum(a, b)[keep], "score": score[row, col][keep], "roles": np.array(named, dtype=object)}))
        return pd.concat(out[1:] or out)

    pairs = _in_blocks(rows, "failure_id", block).groupBy("i", "j").applyInPandas(compare, "failure_a long, failure_b long, score double, roles string")
    return pairs.withColumn("score", F.round("score", 4))


def similar_causes(causes: DataFrame, threshold: float, block: int = BLOCK) -> DataFrame:
    """(failure_a, failure_b, cause_a, cause_b, similarity) of causes of different failures from this cosine on; failure_a is the smaller.

    All with all in blocks, as above; norms once a row and block.
    """
    rows = causes.select("failure_id", "cause_id", F.col("embedding").cast("array<double>").alias("x"))

    def compare(one: pd.DataFrame) -> pd.DataFrame:
        left, right = one[one["left"]], one[~one["left"]]
        f, g, c, d = (s[k].to_numpy() for k in ("failure_id", "cause_id") for s in (left, right))
        out = []
        if len(left) and len(right):
            x, y = _unit(left["x"]), _unit(right["x"])
            for at in range(0, len(x), STRIP):
                cos = x[at : at + STRIP] @ y.T
                row, col = np.nonzero(cos >= threshold)
                out.append((row + at, col, cos[row, col]))
        row, col, cos = (np.concatenate(v) for v in zip(*out)) if out else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))
        # On the diagonal both orders of a pair are there, elsewhere one of them.
        keep = f[row] < g[col] if one["i"].iloc[0] == one["j"].iloc[0] else f[row] != g[col]
        row, col, cos = row[keep], col[keep], cos[keep]
        turn = f[row] > g[col]
        pick = lambda p, q: np.where(turn, q, p)
        return pd.DataFrame({"failure_a": pick(f[row], g[col]), "failure_b": pick(g[col], f[row]), "cause_a": pick(c[row], d[col]), "cause_b": pick(d[col], c[row]), "similarity": cos})

    return _in_blocks(rows, "cause_id", block).groupBy("i", "j").applyInPandas(compare, "failure_a long, failure_b long, cause_a long, cause_b long, similarity double")


def near_duplicate_causes(failure_pairs: DataFrame | None, causes: DataFrame, threshold: float = 0.90) -> DataFrame:
    """Causes of paired failures (all pairs, if None) with a cosine of the threshold: (failure_a, failure_b, cause_a, cause_b, similarity).

    Only causes of given pairs are compared, in blocks as above: a pair of causes is a row only from the threshold on, and never carries vectors.
    """
    if failure_pairs is None:
        return similar_causes(causes, threshold).withColumn("similarity", F.round("similarity", 4))
    either = failure_pairs.select(F.least("failure_a", "failure_b").alias("failure_a"), F.greatest("failure_a", "failure_b").alias("failure_b")).where("failure_a <> failure_b").distinct()
    rows = causes.select("failure_id", "cause_id", F.col("embedding").alias("x"))
    # A failure's causes fill parts of PAIRED at most; a pair of failures meets part by part, and each of its parts is named once a part of the other.
    parts = rows.groupBy("failure_id").agg(F.ceil(F.count("*") / PAIRED).cast("int").alias("parts"))
    rows = rows.join(parts, "failure_id").withColumn("part", F.pmod(F.xxhash64("cause_id"), F.col("parts")).cast("int")).drop("parts")
    sizes = lambda s: parts.select(F.col("failure_id").alias(f"failure_{s}"), F.col("parts").alias(f"parts_{s}"))
    either = either.join(sizes("a"), "failure_a").join(sizes("b"), "failure_b")
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    meet = either.withColumn("i", every("parts_a")).withColumn("j", every("parts_b")).select("failure_a", "failure_b", "i", "j")
    side = lambda f, part, left: meet.join(rows.withColumnsRenamed({"failure_id": f, "part": part}), [f, part]).select("failure_a", "failure_b", "i", "j", F.lit(left).alias("left"), "cause_id", "x")

    def compare(one: pd.DataFrame) -> pd.DataFrame:
        left, right = one[one["left"]], one[~one["left"]]
        out = []
        if len(left) and len(right):
            x, y = _unit(left["x"]), _unit(right["x"])
            for at in range(0, len(x), STRIP):
                cos = x[at : at + STRIP] @ y.T
                row, col = np.nonzero(cos >= threshold)
                out.append((row + at, col, cos[row, col]))
        row, col, cos = (np.concatenate(v) for v in zip(*out)) if out else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))
        ids = [s["cause_id"].to_numpy() for s in (left, right)]
        return pd.DataFrame({"failure_a": one["failure_a"].iloc[0], "failure_b": one["failure_b"].iloc[0], "cause_a": ids[0][row], "cause_b": ids[1][col], "similarity": cos}, index=range(len(row)))

    kind = {c: causes.schema[c].dataType.simpleString() for c in ("failure_id", "cause_id")}
    met = side("failure_a", "i", True).unionByName(side("failure_b", "j", False)).groupBy("failure_a", "failure_b", "i", "j")
    found = met.applyInPandas(compare, f"failure_a {kind['failure_id']}, failure_b {kind['failure_id']}, cause_a {kind['cause_id']}, cause_b {kind['cause_id']}, similarity double")
    return found.withColumn("similarity", F.round("similarity", 4))


def by_ids(items: DataFrame, ids: Sequence[int | str], key: str = "vec_id") -> DataFrame:
    return items.where(F.col(key).isin(*ids))


def upsert(rows: DataFrame, key: str, order: str, first_wins: bool = False) -> DataFrame:
    """One row a key: the last by `order` (an upsert), or the first (an add that never replaces)."""
    o = F.col(order).asc() if first_wins else F.col(order).desc()
    return rows.withColumn("_place", F.row_number().over(Window.partitionBy(key).orderBy(o))).where("_place = 1").drop("_place")


def role_index(sentences: DataFrame, key: str = "file_name") -> DataFrame:
    """(key, failure_ids, cause_ids, effect_ids): the sentence ids of each role, sorted."""
    of = lambda role: F.array_sort(F.collect_list(F.when(F.col("role") == role, F.col("sentence_id"))))
    return sentences.groupBy(key).agg(*[of(r).alias(f"{r}_ids") for r in ("failure", "cause", "effect")])


#: Sentence ids that are joined to one text of role_digests.
RUN = 1_000


def role_digests(sentences: DataFrame, key: str = "file_name") -> DataFrame:
    """(key, failures, causes, effects, failures_md5): the lengths of role_index(), and the digest of its failures joined by commas; null without one.

    No list is made: ids are sorted by ranges over all tasks and joined in runs of RUN, and a file's runs pass through its digest one after the other.
    """
    of = sentences.select(F.col(key).alias("k"), "role", "sentence_id")
    sizes = of.groupBy("k").agg(*[F.count_if((F.col("role") == r) & F.col("sentence_id").isNotNull()).alias(f"{r}s") for r in ("failure", "cause", "effect")])
    ids = of.where((F.col("role") == "failure") & F.col("sentence_id").isNotNull() & F.col("k").isNotNull()).select("k", "sentence_id")
    ids = ids.repartitionByRange("k", "sentence_id").sortWithinPartitions("k", "sentence_id").withColumn("place", F.monotonically_increasing_id())
    # Ranges stay apart: a run is one of a partition and a file.
    runs = ids.groupBy("k", F.spark_partition_id().alias("part"), F.floor(F.col("place") / RUN).alias("run")).agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "sentence_id"))), lambda x: x["sentence_id"]).alias("ids"))
    runs = runs.select("k", "run", F.array_join("ids", ",").alias("text")).repartition("k").sortWithinPartitions("k", "run")

    def digests(batches):
        name, h = None, None
        for b in batches:
            for k, text in zip(b["k"], b["text"]):
                if h is None or k != name:
                    if h is not None:
                        yield pd.DataFrame({"k": [name], "failures_md5": [h.hexdigest()]})
                    name, h = k, hashlib.md5(text.encode())
                else:
                    h.update(b"," + text.encode())
        if h is not None:
            yield pd.DataFrame({"k": [name], "failures_md5": [h.hexdigest()]})

    made = runs.select("k", "text").mapInPandas(digests, "k string, failures_md5 string")
    return sizes.join(made, "k", "left").withColumnRenamed("k", key)


def role_rows(failures: DataFrame) -> DataFrame:
    """(failure_id, role, text) of each failure's mode, element and effect that is worth embedding."""
    from ..functions.text import is_embeddable

    long = failures.select("failure_id", "failure_mode", "failure_element", "failure_effect").unpivot("failure_id", ["failure_mode", "failure_element", "failure_effect"], "role", "text")
    return long.where(is_embeddable(F.col("text")))


def project(items: DataFrame, k: int = 2) -> DataFrame:
    """(vec_id, role, pc1 .. pck): centred principal components; only the d * d sums go to the driver. Signs are free."""
    d = items.select(F.size("embedding")).first()
    d = d[0] if d else 0
    if not d:
        return items.select("vec_id", "role", *[F.lit(0.0).alias(f"pc{i + 1}") for i in range(k)])

    def sums(batches):
        for b in batches:
            x = np.array(b["x"].tolist(), np.float64)
            yield pd.DataFrame({"n": [len(x)], "s": [x.sum(0)], "q": [(x.T @ x).ravel()]})

    parts = items.select(F.col("embedding").cast("array<double>").alias("x")).mapInPandas(sums, "n long, s array<double>, q array<double>")
    total = parts.agg(F.sum("n").alias("n"), *[F.array(*[F.sum(F.col(c)[i]) for i in range(m)]).alias(c) for c, m in (("s", d),)]).first()
    n, mean = total["n"], np.array(total["s"]) / total["n"]
    square = parts.select(F.posexplode("q").alias("i", "v")).groupBy("i").agg(F.sum("v").alias("v")).toPandas().sort_values("i")["v"].to_numpy().reshape(d, d)
    _, axes = np.linalg.eigh(square / n - np.outer(mean, mean))
    axes = axes[:, ::-1][:, :k]
    flip = np.sign(axes[np.abs(axes).argmax(0), np.arange(k)])
    axes = axes * np.where(flip == 0, 1, flip)
    at = [(_dot(F.col("embedding"), literal(axes[:, i])) - float(mean @ axes[:, i])).alias(f"pc{i + 1}") for i in range(k)]
    return items.select("vec_id", "role", *at)


def histogram(rows: DataFrame, value: str, by: str, bins: int = 50) -> DataFrame:
    """(by, bin from 0, low, high, n): each group's values in bins of equal width from its least to its greatest, empty bins too.

    Two passes, the range and the counts, each one partial aggregation. The last bin holds its upper end; equal values lie in the middle of a bin range of width one;
    null and non-finite values are left out.
    """
    x = F.col(value).cast("double")
    rows = rows.select(F.col(by).alias(by), x.alias("v")).where(F.col("v").isNotNull() & ~F.isnan("v") & (F.abs("v") < float("inf")))
    ends = rows.groupBy(by).agg(F.min("v").alias("least"), F.max("v").alias("most"))
    flat = F.col("least") == F.col("most")
    ends = ends.select(by, F.when(flat, F.col("least") - 0.5).otherwise(F.col("least")).alias("least"), F.when(flat, F.col("most") + 0.5).otherwise(F.col("most")).alias("most"))
    width = F.col("most") - F.col("least")
    place = F.least(F.floor((F.col("v") - F.col("least")) / width * bins), F.lit(bins - 1)).cast("int")
    counts = rows.join(ends, by).groupBy(by, place.alias("bin")).agg(F.count("*").alias("n"))
    every = ends.select(by, "least", "most", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    edge = lambda k: F.col("least") + width * k / bins
    return every.join(counts, [by, "bin"], "left").select(by, "bin", edge(F.col("bin")).alias("low"), edge(F.col("bin") + 1).alias("high"), F.coalesce("n", F.lit(0)).cast("long").alias("n"))
