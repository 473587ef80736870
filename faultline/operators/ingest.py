"""Set-based ingest of FMEA records: record-at-a-time deduplication as windows over normalised keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.classify import failure_type_parts
from ..functions.text import normalize_key, parse_number

FIELDS = (
    "file_ord", "file_name", "row_ord", "source_type", "system_name", "system_element", "function_name", "failure_type",
    "failure_mode", "failure_effect", "failure_cause", "cause_discipline", "severity", "occurrence", "detection", "rpn",
    "controls_prevention", "current_detection", "recommended_action",
)


def complete(rows: DataFrame) -> DataFrame:
    """rows with all FIELDS; those that are missing are null."""
    return rows.select(*[F.col(c) if c in rows.columns else F.lit(None).cast("string").alias(c) for c in FIELDS])


def clashing_files(rows: DataFrame) -> DataFrame:
    """File names that belong to more than one file: their failures would get the same ids."""
    return rows.groupBy("file_name").agg(F.countDistinct("file_ord").alias("files")).where("files > 1")


def distinct_records(rows: DataFrame) -> DataFrame:
    """complete(rows) with equal records of a file once: at the place of the first of them, severity and rpn the greatest numbers among them.

    Groups and causes go by first places and greatest numbers, so they are those of all records; but there are no more of these than a file says different things.
    One hash aggregation: it is summed up before the shuffle, and nothing is sorted.
    """
    same = [c for c in FIELDS if c not in ("row_ord", "severity", "rpn")]
    greatest = [F.max(parse_number(F.col(c))).alias(c) for c in ("severity", "rpn")]
    return complete(rows).groupBy(*same).agg(F.min("row_ord").alias("row_ord"), *greatest)


def _kept(rows: DataFrame) -> DataFrame:
    """rows written to a folder of the session and read again, for what is read more than once."""
    from ..sources.files import shared_folder

    path = shared_folder(rows.sparkSession)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


KEYED = ("system_name", "system_element", "function_name", "failure_type", "failure_mode", "failure_effect")


def keyed(rows: DataFrame) -> DataFrame:
    """rows with k_* keys, each text normalised once a row, and `sig`, a digest of file and keys; those of the other format's fields are empty.

    By it rows of one file are one failure: the new format goes by five fields, the old one by three. Keys hold
    letters, digits and spaces only, so the digest's separators are safe.
    """
    new = F.coalesce(F.col("source_type") == "new_fmea", F.lit(False))
    own = {"system_name": new, "system_element": new, "function_name": new, "failure_type": ~new}
    rows = rows.withColumns({f"k_{c}": F.when(own[c], normalize_key(F.col(c))) if c in own else normalize_key(F.col(c)) for c in KEYED})
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in ("file_ord", *(f"k_{c}" for c in KEYED))]
    return rows.withColumn("sig", F.md5(F.concat_ws("|", *parts)))


def groups_of(rows: DataFrame) -> DataFrame:
    """One row a signature of keyed(rows), from its first record; severity and rpn are the group's greatest numbers."""
    said = ["file_ord", *[f"k_{c}" for c in KEYED], "file_name", "source_type", *KEYED]
    number = lambda c: F.col(c) if rows.schema[c].dataType.typeName() == "double" else parse_number(F.col(c))
    # What is worded alike is summed up by hash first; only wordings are sorted for the first of a group.
    g = rows.groupBy("sig", *said).agg(F.min("row_ord").alias("row_ord"), F.max(number("severity")).alias("severity"), F.max(number("rpn")).alias("rpn"))
    g = g.groupBy("sig").agg(F.min("row_ord").alias("group_ord"), F.min_by(F.struct(*said), "row_ord").alias("r"), F.max("severity").alias("severity"), F.max("rpn").alias("rpn"))
    g = g.select("sig", "group_ord", "severity", "rpn", "r.*")
    new = F.coalesce(F.col("source_type") == "new_fmea", F.lit(False))
    # Types are few and rows many: each type is parsed once.
    kinds = g.where(~new).select(F.col("failure_type").alias("kind")).distinct().withColumn("parts", failure_type_parts(F.col("kind")))
    g = g.join(kinds, ~new & F.col("failure_type").eqNullSafe(F.col("kind")), "left")
    g = g.withColumns({"system": F.when(new, F.col("system_name")), "function": F.when(new, F.col("function_name")), "element": F.when(new, F.col("system_element")).otherwise(F.col("parts.element")), "discipline": F.col("parts.discipline")})
    g = g.withColumns({"k_element": F.when(new, F.col("k_system_element")).otherwise(normalize_key(F.col("element"))), "k_system": F.coalesce("k_system_name", F.lit(""))})
    return g.drop("parts", "kind", "system_name", "system_element", "function_name", "failure_type")


def identified(groups: DataFrame, by_ranges: bool = False) -> DataFrame:
    """groups with failure_id and `wins`: the first group of a key names the failure, numbered within its file.

    Groups whose key a store knows (`known_id`, if there is such a column) belong to that failure and win nothing.
    A file's groups are numbered in one task; `by_ranges` deals them over all tasks, for files of any size, at the price of two written tables and a join.
    """
    order = Window.partitionBy("k_failure_mode", "k_failure_effect", "k_element", "k_system").orderBy("file_ord", "group_ord")
    in_file = Window.partitionBy("file_ord").orderBy("group_ord")
    first = F.row_number().over(order) == 1
    known = F.col("known_id") if "known_id" in groups.columns else F.lit(None).cast("string")
    won = groups.withColumn("wins", first & known.isNull())
    if by_ranges:
        from .ordered import numbered

        won = _kept(won)
        place = numbered(won.where("wins").select("sig", "file_ord", "group_ord"), ["group_ord", "sig"], ["file_ord"]).select("sig", "number")
        won = won.join(place, "sig", "left").withColumn("own_id", F.concat("file_name", F.lit("__F"), (F.col("number") + 1).cast("string"))).drop("number")
    else:
        won = won.withColumn("own_id", F.when(F.col("wins"), F.concat("file_name", F.lit("__F"), F.sum(F.col("wins").cast("int")).over(in_file).cast("string"))))
    return won.withColumn("failure_id", F.coalesce(known, F.first("own_id", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))).drop("own_id")


def failures(groups: DataFrame) -> DataFrame:
    """The failures of identified(groups)."""
    return groups.where("wins").select("failure_id", "failure_mode", F.col("element").alias("failure_element"), "failure_effect", "system", F.col("function").alias("function_name"), "severity", "rpn", "source_type")


def causes(rows: DataFrame, groups: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Causes of keyed(rows) and identified(groups): one a failure and normalised text, numbered in order of appearance.

    The first record gives all fields; mode, element and effect are those of its own group's first record. Causes that a store
    has (`known`: failure_id, cause_key, n) are left out, and the numbers of new ones follow theirs.
    """
    named = rows.where(F.coalesce("failure_cause", F.lit("")) != "")
    g = groups.select("sig", "group_ord", "failure_id", F.col("failure_mode").alias("g_mode"), F.col("element").alias("g_element"), F.col("failure_effect").alias("g_effect"), F.col("discipline").alias("g_discipline"))
    named = named.join(g, "sig").withColumn("cause_key", normalize_key(F.col("failure_cause")))
    place = ("file_ord", "group_ord", "row_ord")
    named = named.withColumn("place", F.row_number().over(Window.partitionBy("failure_id", "cause_key").orderBy(*place))).where("place = 1")
    taken = F.lit(0)
    if known is not None:
        named = named.join(known.select("failure_id", "cause_key"), ["failure_id", "cause_key"], "left_anti")
        named = named.join(known.groupBy("failure_id").agg(F.max("n").alias("taken")), "failure_id", "left")
        taken = F.coalesce("taken", F.lit(0))
    named = named.withColumn("n", F.row_number().over(Window.partitionBy("failure_id").orderBy(*place)) + taken)
    new = F.col("source_type") == "new_fmea"
    given = lambda c: F.nullif(F.col(c), F.lit(""))
    return named.select(
        F.concat("failure_id", F.lit("_C"), F.col("n").cast("string")).alias("cause_id"), "failure_id", F.col("g_mode").alias("failure_mode"), F.col("g_element").alias("failure_element"), F.col("g_effect").alias("failure_effect"), "failure_cause",
        F.when(new, F.col("cause_discipline")).otherwise(F.col("g_discipline")).alias("discipline"),
        F.when(new, F.col("controls_prevention")).alias("prevention"),
        F.when(new, F.col("current_detection")).otherwise(F.coalesce(given("current_detection"), F.col("detection"))).alias("detection"),
        parse_number(F.col("detection")).alias("detection_value"), parse_number(F.col("occurrence")).alias("occurrence"), "recommended_action", "n", "cause_key")


def ingest(rows: DataFrame, by_ranges: bool = False) -> tuple[DataFrame, DataFrame]:
    """(failures with cause_ids, causes) of records with file_ord, row_ord and file_name. File names that clash are an error.

    The different records and the groups are written once, as both results read them; the rest is lazy. `by_ranges` numbers the failures of large files over all tasks.
    """
    rows = _kept(keyed(distinct_records(rows)))
    if (clash := clashing_files(rows).first()) is not None:
        raise ValueError(f"{clash['files']} files are named {clash['file_name']}: their failures would share ids")
    groups = _kept(identified(groups_of(rows), by_ranges))
    cause_rows = causes(rows, groups)
    return with_cause_ids(failures(groups), cause_rows), cause_rows.drop("n", "cause_key")


def with_cause_ids(failures_: DataFrame, causes_: DataFrame) -> DataFrame:
    """failures with cause_ids, those of their causes (failure_id, cause_id, n) in order; none are an empty list."""
    ids = causes_.groupBy("failure_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "cause_id"))), lambda s: s["cause_id"]).alias("cause_ids"))
    return failures_.join(ids, "failure_id", "left").withColumn("cause_ids", F.coalesce("cause_ids", F.array().cast("array<string>")))


def sentences_of(records: DataFrame) -> DataFrame:
    """(sentence_id, text, role, source_type, file_name): up to three template sentences a record, with ids that repeat runs keep."""
    new = F.col("source_type") == "new_fmea"
    cell = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    mode, cause, effect = cell("failure_mode"), cell("failure_cause"), cell("failure_effect")
    texts = F.array(
        F.when(mode != "", F.struct(F.lit("failure").alias("role"), F.when(new, F.concat(mode, F.lit(" in "), F.coalesce(F.col("function_name"), F.lit("system")), F.lit("."))).otherwise(F.concat(F.lit("Failure mode "), mode, F.lit("."))).alias("text"))),
        F.when(cause != "", F.struct(F.lit("cause").alias("role"), F.concat(cause, F.lit(" causes "), mode, F.lit(".")).alias("text"))),
        F.when(effect != "", F.struct(F.lit("effect").alias("role"), F.concat(mode, F.lit(" leads to "), effect, F.lit(".")).alias("text"))))
    rows = records.select("file_name", "row_ord", "source_type", F.inline(F.array_compact(texts)))
    return rows.select(F.concat_ws("_", "file_name", F.col("row_ord").cast("string"), "role").alias("sentence_id"), "text", "role", "source_type", "file_name")


def record_text(d: DataFrame) -> Column:
    """The one-line summary of an old-format record."""
    cell = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) if c in d.columns else F.lit("")
    return F.concat(F.lit("Failure mode "), cell("failure_mode"), F.lit(". Cause "), cell("failure_cause"), F.lit(" leads to effect "), cell("failure_effect"), F.lit(". Severity "), cell("severity"), F.lit(", Occurrence "), cell("occurrence"), F.lit(", Detection "), cell("detection"), F.lit(", RPN "), cell("rpn"), F.lit(". Action "), cell("recommended_action"), F.lit("."))


def effect_centred(rows: DataFrame) -> DataFrame:
    """(failure_effect, severity, failure_modes array<struct<failure_mode, causes>>): nested groups, sorted; null keys drop out."""
    inner = rows.where("failure_effect IS NOT NULL AND severity IS NOT NULL AND failure_mode IS NOT NULL").groupBy("failure_effect", "severity", "failure_mode").agg(F.sort_array(F.collect_set("failure_cause")).alias("causes"))
    return inner.groupBy("failure_effect", "severity").agg(F.sort_array(F.collect_list(F.struct("failure_mode", "causes"))).alias("failure_modes"))


def forward_fill(rows: DataFrame, columns: list[str], partition: list[str], order: str) -> DataFrame:
    w = Window.partitionBy(*partition).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumns({c: F.last(c, ignorenulls=True).over(w) for c in columns})


def last_before(rows: DataFrame, marker: Column, value: Column, partition: list[str], order: list[str]) -> Column:
    """The value of the last row strictly before this one where the marker holds: an as-of join with itself as one window."""
    w = Window.partitionBy(*partition).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return F.last(F.when(marker, value), ignorenulls=True).over(w)
