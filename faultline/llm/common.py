"""What the training-data operators share: written tables, Arrow settings, hashes and components."""

from __future__ import annotations

import os
import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of a word split: U+0020 and U+0009 to U+000D. bytes.split() cuts at the same six.
WORD = r"[^\x20\x09-\x0D]+"
_SCRATCH: dict[str, str] = {}
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def tune(spark: SparkSession) -> None:
    """Small Arrow batches, so that a batch of very long texts stays within a worker's memory."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "400")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "16777216")
    spark.conf.set("spark.sql.execution.pythonUDF.arrow.enabled", "true")


def scratch(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; one of ours where that is unset and all runs in this process."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if base:
        return base
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _SCRATCH:
        _SCRATCH[app] = "file://" + os.path.join(tempfile.gettempdir(), f"faultline-{app}")
    return _SCRATCH[app]


def written(df: DataFrame, name: str) -> DataFrame:
    """df written once to the shared folder and read again: cuts lineage and survives lost executors.

    The shuffle files behind the table go as soon as it is written.
    """
    spark = df.sparkSession
    path = f"{scratch(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.mode("overwrite").parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def drop_written(*frames: DataFrame) -> None:
    """Delete tables that written() made (the frames it returned), once nothing reads them any more."""
    for df in frames:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.written_to)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def mix64(z: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (the public splitmix64 constants)."""
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def sliding_min(h: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each window of `width` values, in log2(width) passes."""
    m, k = h, 1
    while k * 2 <= width:
        m = np.minimum(m[:-k], m[k:])
        k *= 2
    if width > k:
        m = np.minimum(m[: -(width - k)], m[width - k :])
    return m


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n; base is odd."""
    inverse = pow(base, -1, 1 << 64)
    up, down = np.ones(n, np.uint64), np.ones(n, np.uint64)
    size = 1
    while size < n:
        step = min(size, n - size)
        up[size : size + step] = up[:step] * np.uint64(pow(base, size, 1 << 64))
        down[size : size + step] = down[:step] * np.uint64(pow(inverse, size, 1 << 64))
        size += step
    return up, down


class Rolling:
    """Polynomial hashes of any range of a sequence of 64-bit values: prefix sums, one lookup a range."""

    def __init__(self, base: int):
        self.base, self.up, self.down = base | 1, *powers(base | 1, 1 << 12)

    def prefix(self, values: np.ndarray) -> np.ndarray:
        if len(values) >= len(self.up):
            self.up, self.down = powers(self.base, 2 * len(values) + 1)
        out = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * self.up[: len(values)], out=out[1:])
        return out

    def ranges(self, prefix: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return mix64((prefix[stop] - prefix[start]) * self.down[start])


#: A key is hot if it has more than one in so many rows; so at most as many keys are. Fewer rows than this are never hot.
HOT, HOT_ROWS = 256, 200


def split_join(left: DataFrame, right: DataFrame, on: list[str], rows: str, how: str = "inner") -> DataFrame:
    """left joined ("inner" or "left") to right, which has one row a key; hot keys do not meet in one task.

    `rows` names the column of right with the key's number of rows in left (a bound will do); it is dropped. The at most HOT keys with more than
    one in HOT of them are joined by a broadcast of their rows of right, the others as usual. right is read up
    to four times, so it should be a written table.
    """
    total, most = right.agg(F.sum(rows), F.max(rows)).first()
    bound = max(HOT_ROWS, (total or 0) // HOT)
    if (most or 0) <= bound:
        return left.join(right.drop(rows), on, how)
    hot, rest = right.where(F.col(rows) > bound).drop(rows), right.where(F.col(rows) <= bound).drop(rows)
    usual = left.join(F.broadcast(hot.select(*on)), on, "left_anti").join(rest, on, how)
    return left.join(F.broadcast(hot), on).select(*usual.columns).unionByName(usual)


def components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """Connected components of edges (a, b): rows (id, component), a written table, component the least id reachable.

    Alternates large-star and small-star steps, each a plain join and a pre-aggregated minimum, and writes the
    edges after each pair of steps. No component is gathered in one task, and nodes with very many neighbours
    are joined apart (`split_join`). Null ends are ignored; ids without
    an edge have no row.
    """
    e = edges.select(F.col("a").cast("long").alias("u"), F.col("b").cast("long").alias("v")).where("u IS NOT NULL AND v IS NOT NULL AND u <> v")
    e = written(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    for _ in range(rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = written(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count("*").alias("rows")), "least")
        large = split_join(both.where("v > u"), least, ["u"], "rows").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = written(large, "large")
        small = written(large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("rows")), "small")
        nxt = split_join(large, small, ["u"], "rows").where("v <> m").select("v", "m").unionByName(small.select(F.col("u").alias("v"), "m"))
        nxt = written(nxt.select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")).where("u <> v").distinct(), "edges")
        drop_written(e, least, large, small)
        e = nxt
        # Done when all are stars: no node has two parents, no parent has one.
        edges, children = e.agg(F.count("*"), F.countDistinct("u")).first()
        if edges == children and not e.select(F.col("v").alias("u")).join(e.select("u"), "u", "left_semi").limit(1).count():
            break
    else:
        raise RuntimeError(f"components need more than {rounds} rounds")
    roots = e.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    out = written(e.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots), "groups")
    drop_written(e)
    return out
