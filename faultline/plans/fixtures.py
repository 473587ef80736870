"""Views of the test tables in the shape of failure knowledge, as DataFrames; `SQL` holds the same for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Order keys of one range of fmea_rows.
RANGE = 4_000


def fmea_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of five files, new and old, with duplicates, blanks and closing full stops.

    Files grow with the table, so a file's rows are numbered by ranges of its order keys: in each range by a window, after the number of rows of the ranges before.
    """
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size")
    rows = table(spark, sf_dir, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey")).withColumn("file_ord", (F.col("l_orderkey") % 5).cast("int"))
    rows = rows.withColumn("range", F.floor(F.col("l_orderkey") / RANGE))
    order = Window.partitionBy("file_ord", "range").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")
    # One row a range and file, so a broadcast.
    ranges = rows.groupBy(F.col("file_ord").alias("of_file"), F.col("range").alias("of_range")).agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("of_file").orderBy("of_range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select("of_file", "of_range", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    rows = rows.withColumn("place", F.row_number().over(order)).join(F.broadcast(ranges), F.col("file_ord").eqNullSafe(F.col("of_file")) & F.col("range").eqNullSafe(F.col("of_range")))
    new = F.col("file_ord") < 3
    kinds = ("Electronics / General", "Motor/ Connectors", "Mechanics", "Pump / Power board", "Software / Timing", "Pump / Impeller")
    kind = F.element_at(F.array(*map(F.lit, kinds)), (F.col("p_size") % 6 + 1).cast("int"))
    quantity = F.col("l_quantity").cast("int")
    return rows.select(
        "file_ord", F.concat(F.lit("FMEA_"), F.col("file_ord").cast("string")).alias("file_name"), (F.col("place") + F.col("before")).cast("int").alias("row_ord"),
        F.when(new, F.lit("new_fmea")).otherwise(F.lit("old_fmea")).alias("source_type"), F.when(new, F.col("p_brand")).alias("system_name"), F.when(new, F.col("p_type")).alias("system_element"),
        F.when(new, F.col("l_linestatus")).alias("function_name"), F.when(~new, kind).alias("failure_type"),
        F.when(F.col("l_linenumber") == 2, F.concat("p_name", F.lit("."))).otherwise(F.col("p_name")).alias("failure_mode"),
        F.when(F.col("l_linenumber") == 3, F.lit("")).otherwise(F.concat(F.lit("Effect "), "l_returnflag")).alias("failure_effect"),
        F.when(F.col("l_quantity") < 4, F.lit("")).otherwise(F.concat(F.lit("Cause "), (quantity % 12).cast("string"))).alias("failure_cause"),
        F.when(quantity % 7 == 0, F.lit("n/a")).when(quantity % 7 == 1, F.lit("-")).otherwise((quantity % 10).cast("string")).alias("severity"))


def kb_vec(spark: SparkSession, sf_dir: str) -> DataFrame:
    role = F.when(F.col("vec_id") % 3 == 0, "failure_mode").when(F.col("vec_id") % 3 == 1, "failure_element").otherwise("failure_effect")
    return table(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / 3).cast("long").alias("failure_id"), role.alias("role"), "vec_id", "embedding")


def kb_cause(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("cause_id"), F.col("label").cast("long").alias("failure_id"), "embedding")


def sent(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    level = F.element_at(F.array(*map(F.lit, ("observed", "confirmed", "ruled_out", "suspected"))), (F.col("doc_id") % 4 + 1).cast("int"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").join(labels, "doc_id", "left")
    return docs.select(F.col("doc_id").alias("sentence_id"), "text", F.concat(F.lit("D"), (2 + F.col("doc_id") % 3).cast("string")).alias("source_section"), level.alias("assertion_level"), F.when(F.col("quality") == 1, 96).otherwise(60).alias("faithful_score"))


def case_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten sentences a case file; the last of each has an id that some other files use, too."""
    s = sent(spark, sf_dir).withColumns({"file_ord": F.floor(F.col("sentence_id") / 10).cast("int"), "slot": (F.col("sentence_id") % 10).cast("int")})
    own = F.concat(F.lit("c"), F.col("file_ord").cast("string"), F.lit("_S"), F.col("slot").cast("string"))
    shared = F.concat(F.lit("shared_"), (F.col("file_ord") % 7).cast("string"))
    return s.withColumn("sentence_id", F.when(F.col("slot") == 9, shared).otherwise(own))


def cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Case files in eightd.CASE_SCHEMA, with file_ord: failures that later files repeat, one or two causes, gaps."""
    none = F.lit(None).cast("string")
    notes = F.struct(F.col("assertion_level").alias("status"), F.when(F.col("slot") % 2 == 1, "product").otherwise("").alias("subject"), "faithful_score", none.alias("faithful_type"), none.alias("entity_type"), "assertion_level")
    lines = case_lines(spark, sf_dir).select("file_ord", F.struct("slot", F.struct("sentence_id", "text", "source_section", notes.alias("annotations")).alias("s")).alias("line"))
    c = lines.groupBy("file_ord").agg(F.array_sort(F.collect_list("line")).alias("lines"))
    n = F.col("file_ord")
    at = lambda *slots: F.transform(F.filter("lines", lambda x: x["slot"].isin(*slots)), lambda x: x["s"])
    text = lambda slot: F.struct(F.get(F.transform(at(slot), lambda s: s["text"]), F.lit(0)).alias("raw_context"))
    tag = F.struct(none.alias("review_status"), none.alias("Version"), none.alias("last_updated"), none.alias("supersedes"))
    fid = F.concat(F.lit("F"), (n % 80).cast("string"))

    def cause(k: int, text_, level, discipline, confidence, *slots: int):
        fields = {"cause_ID": F.concat(fid, F.lit(f"_C{k}")), "cause_level": level, "failure_cause": text_, "cause_parent": none, "discipline_type": discipline, "supporting_entities": at(*slots), "inferred_insight": none, "confidence": confidence, "maintenance_tag": tag}
        return F.struct(*[v.alias(name) for name, v in fields.items()])

    one = cause(1, F.when(n % 10 != 0, F.concat(F.lit("cause "), (n % 6).cast("string"))), F.when(n % 4 != 0, F.lit("process")), F.when(n % 3 == 0, F.lit("HW")), F.lit("high"), 3, 4)
    two = cause(2, F.lit("second cause"), F.lit("design"), F.lit("MCH"), none, 5, 9)
    failure = {"failure_ID": fid, "failure_level": none, "failure_element": F.concat(F.lit("element "), (n % 5).cast("string")), "failure_mode": F.when(n % 11 != 0, F.concat(F.lit("mode "), (n % 9).cast("string"))), "failure_effect": F.when(n % 3 != 0, F.lit("effect")), "supporting_entities": at(0, 1, 2), "maintenance_tag": tag, "root_causes": F.when(n % 2 == 0, F.array(one, two)).otherwise(F.array(one))}
    doc = F.struct(F.concat(F.lit("report_"), n.cast("string")).alias("file_name"), F.concat(F.lit("P"), (n % 4).cast("string")).alias("product_name"), none.alias("date"))
    sections = F.struct(text(0).alias("D2"), text(1).alias("D3"), text(2).alias("D4"))
    return c.select("file_ord", F.array(doc).alias("documents"), tag.alias("maintenance_tag"), F.when(n % 2 == 0, F.lit("system")).alias("system_name"), F.struct(*[v.alias(k) for k, v in failure.items()]).alias("failure"), sections.alias("sections"), F.transform("lines", lambda x: x["s"]).alias("selected_sentences"))


def case_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file, source_section, text): three documents a case, as its sections D2, D3 and D4."""
    i = F.col("doc_id")
    return table(spark, sf_dir, "documents").select(F.floor(i / 3).cast("long").alias("file"), F.concat(F.lit("D"), (2 + i % 3).cast("string")).alias("source_section"), F.coalesce("text", F.lit("")).alias("text"))


def query_vector(spark: SparkSession, sf_dir: str, vec_id: int) -> list[float]:
    """One vector, 64 numbers, as the query of a search."""
    row = table(spark, sf_dir, "embeddings").where(F.col("vec_id") == vec_id).select("embedding").first()
    return list(row[0]) if row else [0.0] * 64


SQL = {
    "fmea_rows": """fmea_rows AS (SELECT file_ord, concat('FMEA_', CAST(file_ord AS VARCHAR)) AS file_name,
 row_number() OVER (PARTITION BY file_ord ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) AS row_ord,
 CASE WHEN file_ord < 3 THEN 'new_fmea' ELSE 'old_fmea' END AS source_type,
 CASE WHEN file_ord < 3 THEN p_brand END AS system_name, CASE WHEN file_ord < 3 THEN p_type END AS system_element,
 CASE WHEN file_ord < 3 THEN l_linestatus END AS function_name,
 CASE WHEN file_ord >= 3 THEN CASE p_size % 6 WHEN 0 THEN 'Electronics / General' WHEN 1 THEN 'Motor/ Connectors'
   WHEN 2 THEN 'Mechanics' WHEN 3 THEN 'Pump / Power board' WHEN 4 THEN 'Software / Timing' ELSE 'Pump / Impeller' END END AS failure_type,
 CASE WHEN l_linenumber = 2 THEN concat(p_name, '.') ELSE p_name END AS failure_mode,
 CASE WHEN l_linenumber = 3 THEN '' ELSE concat('Effect ', l_returnflag) END AS failure_effect,
 CASE WHEN l_quantity < 4 THEN '' ELSE concat('Cause ', CAST(CAST(l_quantity AS INT) % 12 AS VARCHAR)) END AS failure_cause,
 CASE CAST(l_quantity AS INT) % 7 WHEN 0 THEN 'n/a' WHEN 1 THEN '-' ELSE CAST(CAST(l_quantity AS INT) % 10 AS VARCHAR) END AS severity
FROM (SELECT *, CAST(l_orderkey % 5 AS INT) AS file_ord FROM lineitem) l JOIN part ON l_partkey = p_partkey)""",
    "kb_vec": """kb_vec AS (SELECT CAST(floor(vec_id / 3) AS BIGINT) AS failure_id,
 CASE vec_id % 3 WHEN 0 THEN 'failure_mode' WHEN 1 THEN 'failure_element' ELSE 'failure_effect' END AS role, vec_id, embedding FROM embeddings)""",
    "kb_cause": "kb_cause AS (SELECT vec_id AS cause_id, CAST(label AS BIGINT) AS failure_id, embedding FROM embeddings)",
    "sent": """sent AS (SELECT d.doc_id AS sentence_id, d.text, concat('D', CAST(2 + d.doc_id % 3 AS VARCHAR)) AS source_section,
 CASE d.doc_id % 4 WHEN 0 THEN 'observed' WHEN 1 THEN 'confirmed' WHEN 2 THEN 'ruled_out' ELSE 'suspected' END AS assertion_level,
 CASE WHEN l.quality = 1 THEN 96 ELSE 60 END AS faithful_score FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)""",
    "case_lines": """case_lines AS (SELECT CAST(s.sentence_id // 10 AS INT) AS file_ord, CAST(s.sentence_id % 10 AS INT) AS slot,
 CASE WHEN s.sentence_id % 10 = 9 THEN concat('shared_', (s.sentence_id // 10) % 7) ELSE concat('c', s.sentence_id // 10, '_S', s.sentence_id % 10) END AS sentence_id, text, source_section, assertion_level, faithful_score FROM sent s)""",
    "case_heads": """case_heads AS (SELECT DISTINCT file_ord, concat('F', file_ord % 80) AS failure_id, CASE WHEN file_ord % 11 = 0 THEN '' ELSE concat('mode ', file_ord % 9) END AS failure_mode,
 concat('element ', file_ord % 5) AS failure_element, CASE WHEN file_ord % 3 <> 0 THEN 'effect' END AS failure_effect, concat('P', file_ord % 4) AS product FROM case_lines)""",
    "case_sections": "case_sections AS (SELECT doc_id, doc_id // 3 AS file, concat('D', 2 + doc_id % 3) AS source_section, coalesce(text, '') AS text FROM documents)",
}


def with_views(names: str, body: str) -> str:
    """`WITH` the named views of SQL before a query, whose own WITH list may go on."""
    views = ",\n".join(SQL[n] for n in names.split())
    body = body.strip()
    return f"WITH {views},\n{body[5:]}" if body.upper().startswith("WITH ") else f"WITH {views}\n{body}"
