"""Record files, inventories and stores: scans with fixed schemas, and sinks that write once."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import eightd
from ..operators.ingest import FIELDS

RECORD_SCHEMA = ", ".join(f"{c} string" for c in (*(f for f in FIELDS if f not in ("file_ord", "row_ord", "function_name")), "function", "fmea_date", "project_description", "text"))


def _file_order(df: DataFrame, path: Column) -> DataFrame:
    """df with file_ord: place of its file among all by name. One row a file goes through the window; files are joined, not broadcast, where they are many."""
    df = df.withColumn("_path", path)
    files = df.select("_path").distinct().withColumn("file_ord", F.row_number().over(Window.orderBy(F.substring_index("_path", "/", -1), "_path")) - 1)
    return df.join(files, "_path")


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """FMEA records of JSON files (an array or one object each), with file_ord and row_ord; a file's first record names it, else its stem."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    rows = _file_order(whole, F.col("path"))
    array = F.when(F.ltrim("value").startswith("["), F.col("value")).otherwise(F.concat(F.lit("["), F.col("value"), F.lit("]")))
    rows = rows.select("file_ord", "path", F.from_json(array, f"array<struct<{RECORD_SCHEMA.replace(' string', ':string')}>>", {"mode": "FAILFAST"}).alias("records"))
    stem = F.regexp_replace(F.substring_index("path", "/", -1), r"\.[^.]*$", "")
    rows = rows.select("file_ord", F.coalesce(F.col("records")[0]["file_name"], stem).alias("file"), F.posexplode("records").alias("row_ord", "r"))
    return rows.select("file_ord", F.col("file").alias("file_name"), "row_ord", *[F.col(f"r.{c}").alias("function_name" if c == "function" else c) for c in (x.split()[0] for x in RECORD_SCHEMA.split(", ")) if c != "file_name"])


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    """8D case files in eightd.CASE_SCHEMA, with file_ord."""
    df = spark.read.schema(eightd.CASE_SCHEMA).option("multiLine", "true").json(path)
    return _file_order(df.withColumn("path", F.col("_metadata.file_path")), F.col("path")).drop("path", "_path")


def read_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; blank lines are skipped, broken ones end the job with their text."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_lines_checked(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(rows of schema, faults) of JSON lines: broken lines and those with a value of another type go to the faults (file, line, text), others on.

    Lines are numbered from 1 through the whole file, blank ones counted, though its blocks are read apart: a block has one row of counts,
    summed over the blocks before it, and only faults are joined to it. A field that is missing is null; text behind an object is not read.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start"), "value", F.monotonically_increasing_id().alias("_id"))
    blocks = lines.groupBy("_file", "_start").agg(F.min("_id").alias("_first"), F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("_file").orderBy("_start").rowsBetween(Window.unboundedPreceding, -1))
    blocks = blocks.withColumn("_before", F.coalesce(before, F.lit(0)))
    parsed = lines.where(F.trim("value") != "").withColumn("r", F.from_json("value", f"{schema}, _broken string", {"columnNameOfCorruptRecord": "_broken"}))
    bad = F.col("r").isNull() | F.col("r._broken").isNotNull()
    faults = parsed.where(bad).join(blocks, ["_file", "_start"])
    line = F.col("_id") - F.col("_first") + F.col("_before") + 1
    return parsed.where(~bad).select("r.*").drop("_broken"), faults.select(F.col("_file").alias("file"), line.alias("line"), F.col("value").alias("text"))


def read_store(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A store {id: object} as rows (id, fields of schema)."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.explode(F.from_json("value", f"map<string,struct<{schema}>>")).alias("id", "v")).select("id", "v.*")


def read_inventory(spark: SparkSession, path: str, last: int = 100) -> DataFrame:
    """(number, name, category, path, kind) of the last rows of a ;-separated inventory (columns B, C, D and F), routed to 8D or FMEA."""
    raw = spark.read.text(path, wholetext=True)
    lines = raw.select(F.posexplode(F.split(F.regexp_replace("value", "^﻿", ""), "\r?\n")).alias("n", "line")).where("n > 0 AND trim(line) <> ''")
    cells = F.from_csv("line", ", ".join(f"c{i} string" for i in range(8)), {"sep": ";"})
    return route(lines.select("n", cells.alias("c")).select("n", F.col("c.c1").alias("number"), F.col("c.c2").alias("name"), F.col("c.c3").alias("category"), F.col("c.c5").alias("path")), last)


def route(rows: DataFrame, last: int = 100, drive: str = "N:") -> DataFrame:
    """The last rows by n, without process FMEAs and files elsewhere, as 8D or FMEA by their category."""
    tail = rows.orderBy(F.desc("n")).limit(last)
    name, category = F.upper("name"), F.upper("category")
    kind = F.when(F.contains(category, F.lit("8D")), F.lit("8D")).when(F.contains(category, F.lit("FMEA")), F.lit("FMEA"))
    keep = ~F.contains(name, F.lit("PROCESS")) & ~F.contains(name, F.lit("PFMEA")) & F.upper("path").startswith(drive)
    return tail.where(keep & kind.isNotNull()).withColumn("kind", kind)


def match_8d(wanted: DataFrame, listing: DataFrame) -> DataFrame:
    """(number, file): for each series number the best file: strict prefix .doc, then .docx, else any 8D*.doc or .docx."""
    low = F.lower("file")
    docs = listing.where(low.rlike(r"^8d.*\.docx?$")).select("file", F.upper(F.substring("file", 1, 10)).alias("head"))
    keyed = wanted.select("number", F.upper(T.prefix_8d(F.col("number"))).alias("prefix"))
    strict = keyed.join(docs, F.col("head") == F.col("prefix"), "left")
    rank = F.when(F.col("file").isNull(), 9).when(F.lower("file").endswith(".doc"), 0).otherwise(1)
    best = strict.groupBy("number").agg(F.min_by("file", F.struct(rank, "file")).alias("file"))
    any_file = docs.agg(F.min("file").alias("other"))
    return best.crossJoin(F.broadcast(any_file)).select("number", F.coalesce("file", "other").alias("file"))


def fmea_files(listing: DataFrame) -> DataFrame:
    """File names (column file) that begin with FMEA, in any case, and end in .xlsm."""
    return listing.where(F.upper("file").startswith("FMEA") & F.lower("file").endswith(".xlsm"))


def write_records(records: DataFrame, path: str) -> None:
    """One folder of JSON a source file."""
    records.withColumn("file", F.col("file_name")).write.mode("overwrite").partitionBy("file").json(path)


def write_report(summary: DataFrame, details: DataFrame, path: str) -> None:
    """JSON lines in two folders: the summary, and the details in parallel."""
    summary.write.mode("overwrite").json(f"{path}/summary")
    details.write.mode("overwrite").json(f"{path}/details")


def shared_folder(spark: SparkSession) -> str:
    """A new folder that driver and executors share: below spark.checkpoint.dir, or a temporary one where all runs in this process."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + os.path.join(tempfile.gettempdir(), f"faultline-{spark.sparkContext.applicationId}")
    return f"{base}/{uuid.uuid4().hex}"


def stamped(rows: DataFrame, column: str = "loaded_at") -> DataFrame:
    """rows with the time of the load, one for all of them."""
    return rows.withColumn(column, F.current_timestamp())


def unprocessed(files: DataFrame, done: DataFrame, key: str = "file") -> DataFrame:
    return files.join(done.select(key).distinct(), key, "left_anti")
