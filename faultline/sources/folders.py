"""From a folder of workbooks to a kept knowledge base: only files that are new or changed are read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.knowledge import KnowledgeBase
from .workbook import read_fmea


def workbooks(spark: SparkSession, folder: str) -> DataFrame:
    """(path, file_name, seen) of the workbooks below a folder: seen is length and time of change; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "length", "modificationTime")
    files = files.where(F.lower("path").rlike(r"\.(xlsx|xlsm)$") & ~F.col("path").rlike(r"/~\$[^/]*$"))
    name = F.regexp_replace(F.substring_index("path", "/", -1), r"\.[^.]*$", "")
    return files.select("path", name.alias("file_name"), F.concat_ws(":", F.col("length").cast("string"), F.unix_micros("modificationTime").cast("string")).alias("seen"))


def digests_of(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(file_name, sha): digests of the contents of these files."""
    rows = spark.read.format("binaryFile").load(paths)
    return rows.select(F.regexp_replace(F.substring_index("path", "/", -1), r"\.[^.]*$", "").alias("file_name"), F.sha2("content", 256).alias("sha"))


def update_base(spark: SparkSession, folder: str, base: str) -> dict:
    """Bring a knowledge base up to the workbooks of a folder; {version, new, changed, gone, broken}, the last four as lists of file names.

    Files are compared by length and time of change, then those that differ by the digest of their content. New files are merged
    into the base; where files have changed or gone, all tables are made anew from the kept records and those of the
    changed files, whose numbers stay. Nothing to do is no new version. What a crash leaves behind is no version either, so the next
    run begins from the one before. Files that can't be read are named in `broken`, and tried again when they change.

    The driver has one entry a file, as the listing of the folder does.
    """
    kb = KnowledgeBase(spark, base)
    here = {r["file_name"]: (r["path"], r["seen"]) for r in workbooks(spark, folder).collect()}
    kept = {r["file_name"]: (*r["digest"].split(" "), r["file_ord"]) for r in kb.files().where("digest IS NOT NULL").collect()} if kb.store.version() else {}
    gone = sorted(set(kept) - set(here))
    new = sorted(set(here) - set(kept))
    other = sorted(n for n in here if n in kept and here[n][1] != kept[n][0])
    touched = [here[n][0] for n in [*new, *other]]
    sha = {r["file_name"]: r["sha"] for r in digests_of(spark, touched).collect()} if touched else {}
    changed = [n for n in other if sha[n] != kept[n][1]]
    out = {"version": kb.store.version(), "new": new, "changed": changed, "gone": gone, "broken": []}
    if not (new or changed or gone):
        return out
    stamp = {n: f"{here[n][1]} {sha[n]}" for n in [*new, *changed]}
    if new or changed:
        records, bad = read_fmea(spark, [here[n][0] for n in [*new, *changed]])
        out["broken"] = sorted(r["path"].rsplit("/", 1)[-1].rsplit(".", 1)[0] for r in bad.select("path").collect())
    if not changed and not gone:
        marks = spark.createDataFrame(sorted(stamp.items()), "file_name string, digest string")
        return out | {"version": kb.add(records, marks)}
    stay = kb.store.read("records").where(~F.col("file_name").isin([*changed, *gone]))
    stamp = {n: f"{here[n][1] if n in here else seen} {s}" for n, (seen, s, _) in kept.items() if n not in gone} | stamp
    marks = spark.createDataFrame(sorted(stamp.items()), "file_name string, digest string")
    if not (new or changed):
        return out | {"version": kb.rebuild(stay, marks)}
    # Changed files keep their numbers, new ones come after all.
    after = int(kb.store.state()["notes"].get("next_file", 0))
    order = [(n, kept[n][2] if n in kept and kept[n][2] is not None else after + i) for i, n in enumerate([*new, *changed])]
    numbers = spark.createDataFrame(order, "file_name string, file_ord int")
    return out | {"version": kb.rebuild(stay.unionByName(records.drop("file_ord").join(numbers, "file_name"), allowMissingColumns=True), marks)}
