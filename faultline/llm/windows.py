"""What both substring operators start from: sampled windows, and the texts in which one of them occurs again."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_written, sliding_min, split_join, written


def keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc, doc_id, text, times): `doc` a long that orders and names the documents.

    Usually doc is doc_id itself. If ids are null or repeat, rows of equal id and text become one document
    (`times` of them), and documents are numbered in order of (id, text), nulls first.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    odd = rows.groupBy("doc_id").count().where("doc_id IS NULL OR count > 1").limit(1).count()
    if not odd:
        return rows.select(F.col("doc_id").alias("doc"), "doc_id", "text", F.lit(1).alias("times"))
    rows = rows.groupBy("doc_id", "text").agg(F.count("*").cast("int").alias("times")).orderBy("doc_id", "text")
    return written(rows.withColumn("doc", F.monotonically_increasing_id()).select("doc", "doc_id", "text", "times"), "keyed")


def firsts(docs: DataFrame) -> DataFrame:
    """(doc, tk, copies) of the first document of each text; tk is a 64-bit hash of the text."""
    each = docs.select("doc", F.xxhash64("text").alias("tk"), F.sha2("text", 256).alias("sha"))
    return each.groupBy("sha").agg(F.min("doc").alias("doc"), F.min("tk").alias("tk"), F.count("*").alias("copies")).drop("sha")


def segments(grams: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows of `width` grams, grouped: (least gram, first window, one past the last) of each run of windows with one minimum.

    Equal windows have equal minima wherever they are, so they are looked for under one minimum only.
    """
    if len(grams) < width:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    m = sliding_min(grams, width)
    start = np.flatnonzero(np.concatenate([[True], m[1:] != m[:-1]]))
    return m[start], start, np.append(start[1:], len(m))


def repeated(docs: DataFrame, grams: Callable[[bytes], np.ndarray], width: int) -> DataFrame:
    """(tk, minima): of each text, the minima that also occur in another text or twice in this one.

    `docs` has doc and text. Each run of windows sends one row (minimum, text hash); a minimum is kept if rows
    of two texts have it, which partial sums of (least, greatest) text hash tell before the shuffle.
    """
    rows = docs.select(F.xxhash64("text").alias("tk"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found, twice, keys = [], [], []
            for tk, text in zip(b.column("tk").to_pylist(), b.column("text").to_pylist()):
                g = grams(text.encode())
                low = segments(g, width)[0]
                if not len(low):
                    continue
                low = np.unique(low)
                order = np.sort(g)
                again = order[1:][order[1:] == order[:-1]]
                found.append(low)
                twice.append(np.isin(low, again) if len(again) else np.zeros(len(low), bool))
                keys.append(np.full(len(low), tk, np.int64))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64)), pa.array(np.concatenate(keys)), pa.array(np.concatenate(twice))], names=["a", "tk", "twice"])

    return twice_found(rows.mapInArrow(run, "a long, tk long, twice boolean"))


def twice_found(rows: DataFrame) -> DataFrame:
    """(tk, minima), written: of rows (a, tk, twice), the minima of each text that another text has too or that are twice in it."""
    sampled = written(rows, "sampled")
    again = sampled.groupBy("a").agg(F.min("tk").alias("least"), F.max("tk").alias("most"), F.max("twice").alias("twice"), F.count("*").alias("rows")).where("least <> most OR twice").select("a", "rows")
    again = written(again, "again")
    minima = written(split_join(sampled.select("a", "tk"), again, ["a"], "rows").groupBy("tk").agg(F.collect_set("a").alias("minima")), "minima")
    drop_written(sampled, again)
    return minima


def candidates(docs: DataFrame, first: DataFrame, minima: DataFrame, *more: str) -> DataFrame:
    """(doc, text, minima, and more columns of first) of the first document of each text that has any repeated minimum."""
    return docs.select("doc", "text").join(first.join(minima, "tk").select("doc", "minima", *more), "doc")
