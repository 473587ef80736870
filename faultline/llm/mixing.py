"""Mixing sources to target weights: capped water-filling, then seeded whole and fractional repetitions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, written


def water_fill(sizes: DataFrame, max_epochs: float = 3.0) -> DataFrame:
    """Add `target` to rows (source, weight, source_size): min(max_epochs * size, level * weight), summing to all sizes.

    Sources are taken in the order in which they fill up (cap / weight). `level` is what is left per unit of
    weight at the first source that does not fill up: the fixed point of clamping and resharing by weight.
    Empty sources have target 0. One row a source, so the single-partition window holds only sources.
    """
    cap = F.col("source_size") * F.lit(float(max_epochs))
    order = Window.orderBy((cap / F.col("weight")).asc(), F.col("rank").asc())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    df = sizes.withColumn("cap", cap).withColumns({
        "total": F.sum("source_size").over(everything),
        "filled": F.coalesce(F.sum("cap").over(before), F.lit(0.0)),
        "rest": F.sum("weight").over(after),
    })
    df = df.withColumn("level_here", (F.col("total") - F.col("filled")) / F.col("rest"))
    fits = F.when(F.col("level_here") * F.col("weight") <= F.col("cap"), F.col("level_here"))
    df = df.withColumn("level", F.first(fits, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    return df.select("source", "rank", "weight", "source_size", F.least("cap", F.coalesce(F.col("level") * F.col("weight"), F.col("cap"))).alias("target"))


def _bucket(doc_id: str, seed: int) -> Column:
    return F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit("")))), 1, 3)


def source_plan(rows: DataFrame, weights: Sequence[float], max_epochs: float) -> DataFrame:
    """One row a source of `rows` (source, size, bucket): source_size, target, whole_epochs, border, border_share.

    The fraction beyond whole epochs takes the buckets before `border` and `border_share` of that one.
    """
    buckets = rows.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size"))
    sizes = buckets.groupBy("source").agg(F.sum("bucket_size").alias("source_size"))
    ranked = sizes.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    targets = water_fill(ranked.withColumn("weight", F.element_at(cycle, (F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1).cast("int"))), max_epochs)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    targets = targets.withColumn("whole_epochs", whole).withColumn("wanted", F.col("target") - F.col("whole_epochs") * F.col("source_size"))
    running = Window.partitionBy("s.source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    plan = buckets.alias("b").join(targets.alias("s"), F.col("b.source").eqNullSafe(F.col("s.source")))
    plan = plan.withColumn("before", F.coalesce(F.sum("bucket_size").over(running), F.lit(0)))
    beyond = F.when(F.col("before") + F.col("bucket_size") > F.col("wanted"), F.struct("bucket", F.greatest(F.lit(0.0), (F.col("wanted") - F.col("before")) / F.col("bucket_size")).alias("share")))
    plan = plan.groupBy(F.col("s.source").alias("source"), "source_size", "target", "whole_epochs").agg(F.min(beyond).alias("beyond"))
    return plan.select("source", "source_size", "target", "whole_epochs", F.coalesce("beyond.bucket", F.lit("~")).alias("border"), F.coalesce("beyond.share", F.lit(0.0)).alias("border_share"))


#: Sources up to which the plan (one row each) is broadcast.
BROADCAST_SOURCES = 100_000


def _with_plan(rows: DataFrame, weights: Sequence[float], max_epochs: float) -> DataFrame:
    plan = written(source_plan(rows.select("source", "size", "bucket"), weights, max_epochs), "mix")
    plan = F.broadcast(plan) if plan.count() <= BROADCAST_SOURCES else plan
    joined = rows.alias("r").join(plan.withColumnRenamed("source", "plan_source"), F.col("r.source").eqNullSafe(F.col("plan_source"))).drop("plan_source")
    return joined.withColumn("share", F.when(F.col("bucket") < F.col("border"), F.lit(1.0)).when(F.col("bucket") == F.col("border"), F.col("border_share")).otherwise(F.lit(0.0)))


def mix_sources(docs: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id", weights: Sequence[float] = (1, 2, 3), max_epochs: float = 3.0, seed: int = 42) -> DataFrame:
    """Each row of docs with how many words of it the mix takes.

    Returns doc_id, size, source_size, target, taken, then whole_epochs and share (of one more repetition).
    A source's epochs are target / source_size: all its documents are repeated floor(epochs) times. For the
    fraction, documents are dealt into 4,096 buckets by a seeded md5 of doc_id; buckets are taken in order
    while they fit, and the documents of the bucket on the border are taken in part.
    Defined cases: null or blank text has size 0 and takes 0; a null source is a source of its own, last in
    order; a null doc_id hashes as the empty string; repeated rows each count; an empty table gives no rows.
    Other columns are not looked at. Plan: pre-aggregated sums by source and bucket give one row a source,
    which is broadcast (up to BROADCAST_SOURCES); texts are read for their word counts and never shuffled.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), _size(text).alias("size"), _bucket(doc_id, seed).alias("bucket"))
    taken = F.col("whole_epochs") * F.col("size") + F.floor(F.col("size") * F.col("share")).cast("long")
    return _with_plan(rows, weights, max_epochs).select("doc_id", "size", "source_size", "target", taken.alias("taken"), "whole_epochs", "share")


def _size(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def repeat_documents(docs: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id", weights: Sequence[float] = (1, 2, 3), max_epochs: float = 3.0, seed: int = 42) -> DataFrame:
    """The mix itself: rows of docs, whole, as often as they are taken; all columns stay.

    Of the bucket on the border, a document is taken if another seeded hash of its id is below the share. Cases as in mix_sources.
    """
    names = docs.columns
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col(source).alias("source"), _size(text).alias("size"), _bucket(doc_id, seed).alias("bucket"), (F.pmod(F.xxhash64(F.lit(seed), F.col(doc_id)), F.lit(1 << 30)) / float(1 << 30)).alias("draw"))
    times = F.col("whole_epochs") + (F.col("draw") < F.col("share")).cast("long")
    mixed = _with_plan(rows, weights, max_epochs).select("row", F.explode(F.array_repeat(F.lit(1), times.cast("int"))))
    return mixed.select("row.*")


#: The same mix as DuckDB SQL; weights 1, 2, 3, at most 3 epochs, seed 42.
ORACLE = r"""
WITH r AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
  substr(md5(concat('42:', CAST(doc_id AS VARCHAR))), 1, 3) AS bucket FROM documents),
b AS (SELECT source, bucket, CAST(sum(size) AS BIGINT) AS bucket_size FROM r GROUP BY ALL),
s AS (SELECT source, CAST(sum(bucket_size) AS BIGINT) AS source_size FROM b GROUP BY source),
k AS (SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) AS rank FROM s),
w AS (SELECT *, CAST((rank - 1) % 3 + 1 AS DOUBLE) AS weight, source_size * CAST(3 AS DOUBLE) AS cap FROM k),
c AS (SELECT *, sum(source_size) OVER () AS total,
  coalesce(sum(cap) OVER (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS filled,
  sum(weight) OVER (ORDER BY cap / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM w),
l AS (SELECT *, (CAST(total AS DOUBLE) - filled) / rest AS level_here FROM c),
f AS (SELECT arg_min(level_here, cap / weight) AS level FROM l WHERE level_here * weight <= cap),
t AS (SELECT source, source_size, least(cap, coalesce(level * weight, cap)) AS target FROM l, f),
e AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole_epochs FROM t),
p AS (SELECT b.source, b.bucket, e.source_size, e.target, e.whole_epochs, b.bucket_size, target - whole_epochs * source_size AS wanted,
  coalesce(sum(bucket_size) OVER (PARTITION BY b.source ORDER BY b.bucket ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM b JOIN e ON b.source IS NOT DISTINCT FROM e.source),
q AS (SELECT *, CASE WHEN before + bucket_size <= wanted THEN 1.0::DOUBLE ELSE greatest(0.0::DOUBLE, (wanted - CAST(before AS DOUBLE)) / bucket_size) END AS share FROM p)
SELECT r.doc_id, r.size, q.source_size, q.target, q.whole_epochs * r.size + CAST(floor(r.size * share) AS BIGINT) AS taken, q.whole_epochs, q.share
FROM r JOIN q ON r.source IS NOT DISTINCT FROM q.source AND r.bucket = q.bucket
"""
