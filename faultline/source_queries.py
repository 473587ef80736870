"""Queries over files that Spark writes from the tables and reads again (workbooks, reports, JSON lines) and over kept answers, and lemmas; and their SQL twins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import queries as q
from .functions import hooks
from .operators import answers, eightd, ingest, lemmas
from .plans.fixtures import case_sections, fmea_rows, table
from .queries import query
from .sources import files, formats, workbook

#: Records of one workbook at most, of one file and brand.
BOOK = 5000


def _places(at: list[tuple]) -> Column:
    """Cells (row, col, value) as an array of structs: `at` lists them as Columns or constants."""
    column = lambda x: F.lit(x) if isinstance(x, int) else x
    return F.array(*[F.struct(column(r).cast("int").alias("row"), column(c).cast("int").alias("col"), v.cast("string").alias("value")) for r, c, v in at])


def _cells(rows: DataFrame, at: Column) -> DataFrame:
    """Cells (path, sheet, sheet_index, row, col, value, is_number) of rows with path and sheet, in the order of their arrays `at`."""
    out = rows.select("path", "sheet", "sheet_index", F.explode(at).alias("c")).select("path", "sheet", "sheet_index", "c.*")
    return out.where("value <> ''").withColumn("is_number", F.col("value").rlike(r"^\d+$"))


def books(spark: SparkSession, sf_dir: str) -> DataFrame:
    """fmea_rows as the cells of workbooks of both layouts, at most BOOK records each: with their markers, headers and cells of the project.

    Records, not their cells, are sorted by file; the first of a file brings its head. So the cells stand in the order of a workbook.
    """
    new = F.col("file_ord") < 3
    rows = fmea_rows(spark, sf_dir).where("file_ord IS NOT NULL").withColumn("book", F.floor(F.col("row_ord") / BOOK).cast("string"))
    new_path = F.concat_ws("~", "file_name", "book", F.concat(F.regexp_replace("system_name", "[^A-Za-z0-9]", "-"), F.lit(".xlsm")))
    rows = rows.withColumns({"path": F.when(new, new_path).otherwise(F.concat(F.concat_ws("~", "file_name", "book"), F.lit(".xlsx"))), "sheet": F.when(new, "DFMEA").otherwise("FMEA"), "sheet_index": F.when(new, 1).otherwise(0)})
    rows = rows.withColumn("first", F.row_number().over(Window.partitionBy("path").orderBy("row_ord")) == 1)
    project = F.concat(F.lit("project "), "file_name")
    named = {name: (3 + i, head) for i, (head, name) in enumerate(workbook.NEW_HEADERS.items())}
    new_head = [(0, 0, F.lit("System")), (0, 2, F.col("system_name")), (1, 8, project), (3, 19, F.lit("2024-01-31")), *[(workbook.NEW_HEADER_ROW, c, F.lit(h)) for c, h in named.values()]]
    row = (F.col("row_ord") % BOOK) * 3 + workbook.NEW_HEADER_ROW + 1
    said = {c: F.col(c) for c in ("failure_mode", "failure_effect", "severity")} | {"failure_cause": F.when(F.col("failure_cause") != "", F.concat(F.lit("[S01 - HW] "), "failure_cause"))}
    new_body = [(row, 0, F.lit("System element")), (row, 2, F.col("system_element")), (row + 1, 0, F.lit("Function")), (row + 1, 2, F.col("function_name")), *[(row + 2, named[c][0], v) for c, v in sorted(said.items(), key=lambda x: named[x[0]][0])]]
    places = {name: (c, heads[0]) for name, (heads, c) in workbook.OLD_HEADERS.items()}
    old_head = [(1, 4, project), (3, 9, F.lit("2023")), *[(5, c, F.initcap(F.lit(h))) for c, h in sorted(places.values())]]
    old_body = [(F.col("row_ord") % BOOK + 6, places[c][0], F.col(c)) for c in sorted(("failure_type", "failure_mode", "failure_effect", "failure_cause", "severity"), key=lambda c: places[c][0])]
    return _cells(rows, F.when(new & F.col("first"), _places(new_head + new_body)).when(new, _places(new_body)).when(F.col("first"), _places(old_head + old_body)).otherwise(_places(old_body)))


@query(f"""SELECT source_type, concat('project ', file_name) AS project_description, CASE WHEN file_ord < 3 THEN '2024-01-31' ELSE '2023' END AS fmea_date, coalesce(system_name, '') AS system_name,
 coalesce(system_element, '') AS system_element, coalesce(function_name, '') AS function_name, coalesce(failure_type, '') AS failure_type, failure_mode, failure_effect, failure_cause,
 CASE WHEN file_ord < 3 THEN 'HW' ELSE '' END AS cause_discipline, CASE WHEN file_ord < 3 OR regexp_full_match(severity, '[0-9]+') THEN severity ELSE '' END AS severity,
 concat(file_name, '~', CAST(row_ord // {BOOK} AS VARCHAR), CASE WHEN file_ord < 3 THEN concat('~', regexp_replace(system_name, '[^A-Za-z0-9]', '-', 'g')) ELSE '' END) AS file_name,
 CASE WHEN file_ord < 3 THEN row_ord % {BOOK} * 3 + {workbook.NEW_HEADER_ROW} + 3 ELSE row_ord % {BOOK} + 6 END AS row_ord
FROM fmea_rows WHERE failure_cause <> '' AND (file_ord >= 3 OR severity <> '-')""", "fmea_rows")
def workbooks_written_and_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All records as workbooks of both layouts, written by all tasks, and read again by their format."""
    path = files.shared_folder(spark)
    formats.write_workbooks(books(spark, sf_dir), path, in_order=True)
    records, _ = workbook.records_of(spark.read.format("workbook_cells").load(path))
    blank = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    return records.select("source_type", "project_description", "fmea_date", *map(blank, ("system_name", "system_element", "function_name", "failure_type", "failure_mode", "failure_effect", "failure_cause", "cause_discipline", "severity")), "file_name", "row_ord")


@query("""WITH p AS (SELECT conv_id, turn, role = 'user' AS head, text FROM conversations), s AS (SELECT *, sum(CAST(head AS INT)) OVER (PARTITION BY conv_id ORDER BY turn) AS section FROM p)
SELECT concat('case_', conv_id, '.docx') AS file, CAST(section AS BIGINT) AS section, max(CASE WHEN head THEN trim(text) END) AS title, coalesce(string_agg(trim(text), chr(10) ORDER BY turn) FILTER (NOT head AND trim(text) <> ''), '') AS content FROM s WHERE section > 0 GROUP BY conv_id, section""")
def reports_written_and_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation as a Word report, its user's turns as headings; written, read by its format, and cut into sections."""
    path = files.shared_folder(spark)
    turns = table(spark, sf_dir, "conversations").select(F.concat(F.lit("case_"), F.col("conv_id").cast("string"), F.lit(".docx")).alias("path"), F.lit("paragraph").alias("kind"), F.col("turn").alias("ord"), F.when(F.col("role") == "user", "Heading 2").otherwise("Normal").alias("style"), "text")
    formats.write_reports(turns, path)
    parts = spark.read.format("report_parts").load(path)
    return eightd.sections(parts.where("error IS NULL AND kind = 'paragraph'")).select("file", "section", "title", "content")


@query("SELECT click_id, CASE WHEN click_id % 7 = 3 THEN NULL ELSE client_id END AS client_id, kind, coalesce(click_id % 7 = 3, false) AS broken FROM clicks")
def lines_checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks as JSON lines, one in seven of which has a text where its client's number belongs: all rows and all faults. The faults' lines are tested apart."""
    path = files.shared_folder(spark)
    clicks = table(spark, sf_dir, "clicks").withColumn("number", F.when(F.col("click_id") % 7 == 3, F.lit('"none"')).otherwise(F.coalesce(F.col("client_id").cast("string"), F.lit("null"))))
    rest = F.to_json(F.struct("click_id", "kind"))
    clicks.select(F.concat(F.lit('{"client_id": '), "number", F.lit(", "), F.substr(rest, F.lit(2))).alias("value")).write.text(path)
    rows, faults = files.read_lines_checked(spark, path, "click_id long, client_id long, kind string")
    broken = faults.select(F.from_json("text", "click_id long, kind string").alias("r")).select("r.click_id", F.lit(None).cast("long").alias("client_id"), "r.kind", F.lit(True).alias("broken"))
    return rows.select("click_id", "client_id", "kind", F.lit(False).alias("broken")).unionByName(broken)


_CLEAN = r"trim(regexp_replace(x, '[ \t\n\r\f\x0b]+', ' ', 'g'))"


@query(f"""WITH s AS (SELECT file, source_section, list_filter(list_transform(regexp_split_to_array(text, '[.!?]'), lambda x: {_CLEAN}), lambda x: x <> '')[1:3] AS said FROM case_sections)
SELECT file, max(CASE WHEN source_section = 'D2' THEN said[1] END) AS failure_mode, max(CASE WHEN source_section = 'D3' THEN said[1] END) AS failure_effect,
coalesce(max(CASE WHEN source_section = 'D4' THEN array_to_string(list_transform(range(1, len(said) + 1), lambda i: concat('report_', file, '_F1_C', i, '|unknown|', CASE WHEN i % 2 = 0 THEN 'MCH' ELSE 'Other' END, '|medium|', said[i])), chr(10)) END), '') AS causes
FROM s GROUP BY file""", "case_sections")
def case_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences picked and cases made by model steps (deterministic stand-ins), whose answers are kept, over all sections."""
    kept = files.shared_folder(spark)
    s = case_sections(spark, sf_dir)
    picked = answers.selected(s, hooks.first_sentences, f"{kept}/pick")
    made = answers.consolidated(picked, s, hooks.signals_as_case, f"{kept}/case")
    line = lambda c: F.concat_ws("|", c["cause_ID"], c["cause_level"], c["discipline_type"], c["confidence"], c["failure_cause"])
    return made.select("file", "failure_mode", "failure_effect", F.array_join(F.transform("root_causes", line), "\n").alias("causes"))


_RULES = f"""d AS (SELECT doc_id, {q._content('text')} AS said FROM documents),
v AS (SELECT word FROM (SELECT unnest(list_distinct(said)) AS word FROM d) GROUP BY word HAVING count(*) >= {lemmas.DOCS}),
e AS (SELECT left(word, length(word) - n) AS stem, right(word, n) AS ending FROM v, (SELECT unnest(range(0, {lemmas.ENDING + 1})) AS n) WHERE length(word) - n >= {lemmas.STEM}),
f AS (SELECT a.ending, b.ending AS base, count(*) AS support FROM e a JOIN e b ON a.stem = b.stem AND length(b.ending) < length(a.ending) AND length(b.ending) <= {lemmas.BASE} WHERE a.ending <> '' GROUP BY ALL HAVING count(*) >= {lemmas.SUPPORT}),
o AS (SELECT *, row_number() OVER (PARTITION BY ending ORDER BY support DESC, length(base), base) AS p FROM f),
rules AS (SELECT ending, base, support, total FROM o JOIN (SELECT ending, count(*) AS total FROM e GROUP BY ending) USING (ending) WHERE p = 1 AND support >= {lemmas.SHARE} * total ORDER BY support DESC, ending LIMIT {lemmas.RULES})"""


@query(f"WITH {_RULES} SELECT * FROM rules")
def lemma_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Endings that the texts of all documents teach to rewrite."""
    return lemmas.rules(lemmas.vocabulary(table(spark, sf_dir, "documents")))


@query(f"""WITH {_RULES}, w AS (SELECT DISTINCT unnest(said) AS word FROM d),
h AS (SELECT word, max_by(concat(left(word, length(word) - length(ending)), base), length(ending)) AS lemma FROM w JOIN rules ON right(word, length(ending)) = ending AND length(word) - length(ending) >= {lemmas.STEM} GROUP BY word),
t AS (SELECT doc_id, unnest(said) AS word, generate_subscripts(said, 1) AS i FROM d),
j AS (SELECT doc_id, string_agg(coalesce(lemma, word), ' ' ORDER BY i) AS joined, count(*) AS n, count(DISTINCT coalesce(lemma, word)) AS n_lemmas FROM t LEFT JOIN h USING (word) GROUP BY doc_id)
SELECT doc_id, CASE WHEN said IS NOT NULL THEN md5(coalesce(joined, '')) END AS lemmas_md5, coalesce(n, 0) AS n_words, coalesce(n_lemmas, 0) AS n_lemmas FROM d LEFT JOIN j USING (doc_id)""")
def lemma_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The joined lemmas of each document (their digest), its words and distinct lemmas, by the rules that all documents teach."""
    docs = table(spark, sf_dir, "documents")
    said = docs.select("doc_id", lemmas.lemma_tokens(F.col("text"), lemmas.learnt(docs)).alias("said"))
    size = lambda x: F.coalesce(F.size(x), F.lit(0)).cast("long")
    return said.select("doc_id", F.md5(F.array_join("said", " ")).alias("lemmas_md5"), size(F.col("said")).alias("n_words"), size(F.array_distinct("said")).alias("n_lemmas"))


@query(f"""WITH one_file AS (SELECT * REPLACE (CAST(0 AS INTEGER) AS file_ord, 'FMEA_all' AS file_name, row_ord * 5 + file_ord AS row_ord) FROM fmea_rows), {q._INGEST.replace('fmea_rows', 'one_file')},
i AS (SELECT failure_id, string_agg(cause_id, ',' ORDER BY n) AS cause_ids FROM causes GROUP BY failure_id)
SELECT g5.failure_id, failure_mode, element AS failure_element, failure_effect, sys AS system, severity, coalesce(cause_ids, '') AS cause_ids FROM g5 LEFT JOIN i ON i.failure_id = g5.failure_id WHERE wins""", "fmea_rows")
def ingest_of_one_large_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All records as one file, whose failures are numbered over all tasks."""
    rows = fmea_rows(spark, sf_dir)
    one = rows.withColumns({"row_ord": F.col("row_ord") * 5 + F.col("file_ord"), "file_ord": F.lit(0), "file_name": F.lit("FMEA_all")})
    found, _ = ingest.ingest(one, by_ranges=True)
    return found.select("failure_id", "failure_mode", "failure_element", "failure_effect", "system", "severity", F.array_join("cause_ids", ",").alias("cause_ids"))


@query("""SELECT concat('maker_', s_suppkey) AS file_name, trim(s_name) AS system_name, concat('nation: ', s_nationkey) AS system_element, '' AS function_name FROM supplier""")
def workbook_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A workbook for each supplier, written and read: what stands behind the colon in the first cells of its header rows."""
    path = files.shared_folder(spark)
    makers = table(spark, sf_dir, "supplier").select("s_name", "s_nationkey", F.concat(F.lit("maker_"), F.col("s_suppkey").cast("string"), F.lit(".xlsx")).alias("path"), F.lit("DFMEA").alias("sheet"), F.lit(1).alias("sheet_index"))
    formats.write_workbooks(_cells(makers, _places([(5, 0, F.concat(F.lit("System: "), "s_name")), (5, 1, F.lit("other: cell")), (7, 0, F.concat(F.lit("Element: nation: "), F.col("s_nationkey").cast("string"))), (8, 0, F.lit("no colon"))])), path)
    return workbook.header_values(spark.read.format("workbook_cells").load(path).where("error IS NULL"))
