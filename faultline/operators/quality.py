"""Integrity checks of stores, and retrieval accuracy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import is_blank


def _missing(x: Column) -> Column:
    return x.isNull() | is_blank(x)


def _issues(df: DataFrame, key: str, rules: list[tuple[Column, str]]) -> DataFrame:
    """(id, message) of each broken rule of each row: one narrow pass."""
    found = F.array_compact(F.array(*[F.when(broken, F.lit(message)) for broken, message in rules]))
    return df.select(F.col(key).alias("id"), F.explode(found).alias("message"))


def failure_schema(failures: DataFrame) -> DataFrame:
    rules = [(_missing(F.col(c).cast("string")), f"missing {c}") for c in ("failure_id", "failure_element", "failure_mode", "failure_effect")]
    return _issues(failures, "failure_id", rules)


def cause_schema(causes: DataFrame, text: str = "failure_cause") -> DataFrame:
    rules = [(_missing(F.col("cause_id").cast("string")), "missing cause_id"), (_missing(F.col("failure_id").cast("string")), "missing failure_id (in cause)"), (_missing(F.col(text)), "missing root_cause")]
    return _issues(causes, "cause_id", rules)


def failure_nulls(failures: DataFrame, texts: tuple[str, ...] = ("failure_effect", "product"), lists: tuple[str, ...] = ("supporting_sentence_ids", "cause_ids")) -> DataFrame:
    """Optional texts should be null rather than blank, lists empty rather than null."""
    rules = [(is_blank(F.col(c)), f'{c} is "" (prefer null)') for c in texts if c in failures.columns]
    rules += [(F.col(c).isNull(), f"{c} is null (prefer [])") for c in lists if c in failures.columns]
    return _issues(failures, "failure_id", rules)


def cause_nulls(causes: DataFrame, text: str = "root_cause") -> DataFrame:
    return _issues(causes, "cause_id", [(is_blank(F.col(text)), f'{text} is "" (must be non-empty)')])


def with_nulls(df: DataFrame, texts: list[str], lists: list[str]) -> DataFrame:
    """A view for the checks: blank texts as null, missing lists as empty."""
    fixed = {c: F.when(~is_blank(F.col(c)), F.col(c)) for c in texts} | {c: F.coalesce(c, F.array().cast(df.schema[c].dataType)) for c in lists}
    return df.withColumns(fixed)


def id_mismatch(store: DataFrame, key: str, inner: str) -> DataFrame:
    """Entries whose own id differs from the key that they are stored under."""
    return store.where(F.col(inner).isNotNull() & (F.col(inner) != F.col(key))).select(F.col(key).alias("id"), F.col(inner).alias("inner_id"))


def orphan_causes(failures: DataFrame, causes: DataFrame) -> DataFrame:
    """(failure_id, cause_id) that a failure lists and no cause has."""
    listed = failures.select("failure_id", F.explode("cause_ids").alias("cause_id"))
    return listed.join(causes.select("cause_id"), "cause_id", "left_anti").select("failure_id", "cause_id")


def orphan_failures(failures: DataFrame, causes: DataFrame) -> DataFrame:
    """(cause_id, failure_id) of causes whose failure is null or unknown; an anti join keeps nulls."""
    return causes.select("cause_id", "failure_id").join(failures.select("failure_id"), "failure_id", "left_anti").select("cause_id", "failure_id")


def _messages(checks: dict[str, DataFrame]) -> DataFrame:
    """(check, message) of the findings of all checks."""
    out = None
    for name, found in checks.items():
        cells = [F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in found.columns]
        one = found.select(F.lit(name).alias("check"), F.concat_ws(": ", *cells).alias("message"))
        out = one if out is None else out.unionByName(one)
    return out


def _summed(messages: DataFrame, samples: int) -> DataFrame:
    ranked = messages.withColumn("place", F.row_number().over(Window.partitionBy("check").orderBy("message"))).where(F.col("place") <= samples)
    first = ranked.groupBy("check").agg(F.array_sort(F.collect_list("message")).alias("samples"))
    # Counts are partial before the shuffle, and ranks limited: no check's findings meet in one task.
    return messages.groupBy("check").agg(F.count("*").alias("n")).join(first, "check")


def summary(checks: dict[str, DataFrame], samples: int = 5) -> DataFrame:
    """(check, n, samples): how many findings a check has, and the first few messages by id."""
    return _summed(_messages(checks), samples)


def written_report(checks: dict[str, DataFrame], path: str, samples: int = 5) -> DataFrame:
    """(check, message) of all findings, written with their summary and read again; a check without findings has one row without message.

    Each check runs once: the summary is made from the details that were written.
    """
    spark = next(iter(checks.values())).sparkSession
    _messages(checks).write.mode("overwrite").json(f"{path}/details")
    details = spark.read.schema("check string, message string").json(f"{path}/details")
    _summed(details, samples).write.mode("overwrite").json(f"{path}/summary")
    names = spark.createDataFrame([(n,) for n in checks], "check string")
    return names.join(details, "check", "left")


def retrieval_pairs(original: DataFrame, rephrased: DataFrame, keys: tuple[str, ...] = ("failure_id", "cause_id"), order: str | None = None, check: bool = True) -> DataFrame:
    """Both kinds of query by key; of repeated keys the last one counts. No common key is an error.

    Without `check` nothing is run here: `retrieval_accuracy` then finds that there is no pair, in its own pass.
    """
    def last(d: DataFrame) -> DataFrame:
        return d if order is None else d.withColumn("_p", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order)))).where("_p = 1").drop("_p")

    pairs = last(original).alias("o").join(last(rephrased).alias("r"), list(keys))
    if check and pairs.isEmpty():
        raise ValueError("original and rephrased queries have no key in common")
    return pairs


def retrieval_accuracy(found: DataFrame) -> DataFrame:
    """One row of rates from (truth, original_ids, rephrased_ids), the ids in order of rank; no rows are an error when it runs."""
    top = lambda ids: F.coalesce(F.get(F.col(ids), F.lit(0)) == F.col("truth"), F.lit(False))
    among = lambda ids: F.coalesce(F.array_contains(ids, F.col("truth")), F.lit(False))
    rate = lambda c: F.round(F.avg(c.cast("int")), 6)
    return found.agg(
        F.when(F.count("*") > 0, F.count("*")).otherwise(F.raise_error(F.lit("original and rephrased queries have no key in common")).cast("long")).alias("n"), rate(top("original_ids")).alias("original_top1"), rate(among("original_ids")).alias("original_recall"),
        rate(top("rephrased_ids")).alias("rephrased_top1"), rate(among("rephrased_ids")).alias("rephrased_recall"),
        rate(top("original_ids") & ~top("rephrased_ids")).alias("regression_rate"))


def sample_by_hash(rows: DataFrame, n: int, key: str, seed: int = 42) -> DataFrame:
    """n rows without replacement, the same for the same seed: the least by a seeded md5 of the key."""
    return rows.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))), key).limit(n)
