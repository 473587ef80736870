"""Numbers and forward fills in one order, or one a group, with no group in one task: ranges are sorted apart, and what crosses a border is carried."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.files import shared_folder

_PLACE = (1 << 33) - 1


def spread(rows: DataFrame, order: list[str], by: list[str] | None = None, parts: int | None = None) -> DataFrame:
    """rows with _part and _place: dealt by ranges of (by, order) over tasks, and sorted in each; a written table, so that places stay.

    Rows that are equal in by and order meet in one task: end `order` by a key, if many may be. Nulls come first.
    """
    spark = rows.sparkSession
    keys = [F.col(c) for c in (*(by or []), *order)]
    dealt = rows.repartitionByRange(parts, *keys) if parts else rows.repartitionByRange(*keys)
    placed = dealt.sortWithinPartitions(*keys).withColumns({"_part": F.spark_partition_id(), "_place": F.monotonically_increasing_id().bitwiseAND(F.lit(_PLACE))})
    path = shared_folder(spark)
    placed.write.parquet(path)
    return spark.read.schema(placed.schema).parquet(path)


def _beside(rows: DataFrame, few: DataFrame, by: list[str]) -> DataFrame:
    """rows with the columns that few, a row for each part and group, adds to them; no key has more rows than a part."""
    named = few.select(F.col("_part").alias("_p"), *[F.col(c).alias(f"_by_{n}") for n, c in enumerate(by)], *[c for c in few.columns if c not in ("_part", *by)])
    same = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"_by_{n}")) for n, c in enumerate(by)], F.col("_part") == F.col("_p"))
    return rows.join(named, same).drop("_p", *[f"_by_{n}" for n in range(len(by))])


def _earlier(by: list[str]) -> Window:
    """The parts before one's own; a group has one row for each part that it reaches, never more than there are tasks."""
    return Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)


def numbered(rows: DataFrame, order: list[str], by: list[str] | None = None, name: str = "number", parts: int | None = None) -> DataFrame:
    """rows with consecutive numbers from 0 in this order, anew for each group of `by` (nulls are a group); equal rows get different ones.

    A row's number is its place in its part, less that of its group's first row there, plus the group's rows in earlier parts. Other columns stay; one called `name` is replaced.
    """
    by = by or []
    placed = spread(rows.drop(name), order, by, parts)
    few = placed.groupBy("_part", *by).agg(F.min("_place").alias("_first"), F.count("*").alias("_rows"))
    few = few.withColumn("_before", F.coalesce(F.sum("_rows").over(_earlier(by)), F.lit(0))).drop("_rows")
    return _beside(placed, few, by).withColumn(name, F.col("_place") - F.col("_first") + F.col("_before")).drop("_part", "_place", "_first", "_before")


def filled(rows: DataFrame, value: str, order: list[str], by: list[str] | None = None, name: str | None = None, parts: int | None = None) -> DataFrame:
    """rows with `name` (value itself, if none is given): in this order the last value of the group so far that is not null; null before the first.

    Each part fills its own rows; for each group the last value of earlier parts is carried over their borders.
    """
    by, name = by or [], name or value
    placed = spread(rows.withColumn("_value", F.col(value)), order, by, parts)
    few = placed.groupBy("_part", *by).agg(F.max_by("_value", F.when(F.col("_value").isNotNull(), F.col("_place"))).alias("_last"))
    few = few.withColumn("_carried", F.last("_last", ignorenulls=True).over(_earlier(by))).drop("_last")
    so_far = F.last("_value", ignorenulls=True).over(Window.partitionBy("_part", *by).orderBy("_place").rowsBetween(Window.unboundedPreceding, 0))
    return _beside(placed.withColumn("_so_far", so_far), few, by).withColumn(name, F.coalesce("_so_far", "_carried")).drop("_part", "_place", "_value", "_so_far", "_carried")
