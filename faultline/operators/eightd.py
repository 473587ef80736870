"""8D cases: sections, sentence ids, evidence, ingest."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import classify
from . import texteval

_TAG = "struct<review_status:string,Version:string,last_updated:string,supersedes:string>"
_SENT = "struct<sentence_id:string,text:string,source_section:string,annotations:struct<status:string,subject:string,faithful_score:int,faithful_type:string,entity_type:string,assertion_level:string>>"
#: Schema of a case file.
CASE_SCHEMA = f"""
  documents array<struct<file_name:string,product_name:string,date:string>>, maintenance_tag {_TAG}, system_name string,
  failure struct<failure_ID:string,failure_level:string,failure_element:string,failure_mode:string,failure_effect:string,
    supporting_entities:array<{_SENT}>,maintenance_tag:{_TAG},
    root_causes:array<struct<cause_ID:string,cause_level:string,failure_cause:string,cause_parent:string,discipline_type:string,
      supporting_entities:array<{_SENT}>,inferred_insight:string,confidence:string,maintenance_tag:{_TAG}>>>,
  sections struct<D2:struct<raw_context:string>,D3:struct<raw_context:string>,D4:struct<raw_context:string>,D5:struct<raw_context:string>,D6:struct<raw_context:string>>,
  selected_sentences array<{_SENT}>"""
# Fixed values.
DISCIPLINES = ("HW", "ESW", "MCH", "Other")


def maintenance(tag: Column) -> Column:
    """A tag with its defaults: pending, V0, no date."""
    return F.struct(F.coalesce(tag["review_status"], F.lit("pending")).alias("review_status"), F.coalesce(tag["Version"], F.lit("V0")).alias("version"), F.coalesce(tag["last_updated"], F.lit("")).alias("last_updated"), tag["supersedes"].alias("supersedes"))


def sections(paragraphs: DataFrame) -> DataFrame:
    """(file, section, title, content) of paragraphs (file, ord, style, text): a "Heading 2" opens a section; what stands before the first one drops out."""
    head = F.col("style") == "Heading 2"
    w = Window.partitionBy("file").orderBy("ord")
    rows = paragraphs.withColumn("section", F.sum(head.cast("int")).over(w)).where("section > 0")
    body = F.array_sort(F.collect_list(F.when(~head & (F.trim("text") != ""), F.struct("ord", F.trim("text").alias("text")))))
    return rows.groupBy("file", "section").agg(F.max(F.when(head, F.trim("text"))).alias("title"), F.array_join(F.transform(body, lambda b: b["text"]), "\n").alias("content"))


def with_prefixes(sections_: DataFrame, prefixes: tuple[str, ...]) -> DataFrame:
    keep = F.lit(False)
    for p in prefixes:
        keep = keep | F.col("title").startswith(p)
    return sections_.where(keep)


def pick_sections(sections_: DataFrame, names: tuple[str, ...] = ("D2", "D3", "D4", "D5", "D6")) -> DataFrame:
    """One row a file: of each name the last section whose title begins with it; null if there is none."""
    return sections_.groupBy("file").agg(*[F.max_by("content", F.when(F.col("title").startswith(n), F.col("section"))).alias(n) for n in names])


def _sentence_id(doc: str, section: str, n: Column) -> Column:
    return F.concat(F.col(doc).cast("string"), F.lit("_"), F.col(section), F.lit("_S"), F.when(n < 1000, F.lpad(n.cast("string"), 3, "0")).otherwise(n.cast("string")))


def sentence_ids(sentences: DataFrame, doc: str = "doc", section: str = "source_section", order: str = "ord") -> DataFrame:
    """sentences with sentence_id `doc_section_S001`, counted in order within document and section."""
    return sentences.withColumn("sentence_id", _sentence_id(doc, section, F.row_number().over(Window.partitionBy(doc, section).orderBy(order))))


def unused(selected: DataFrame, used: DataFrame, key: str = "sentence_id") -> DataFrame:
    return selected.join(used.select(key).distinct(), key, "left_anti")


def support_status(failures: DataFrame, evidence: DataFrame, min_score: int = 95) -> DataFrame:
    """(failure_id, status): supported if any D2 sentence is observed or confirmed with the score at least; else hypothesis."""
    good = (F.col("source_section") == "D2") & F.col("assertion_level").isin("observed", "confirmed") & (F.col("faithful_score") >= min_score)
    ok = evidence.groupBy("failure_id").agg(F.bool_or(F.coalesce(good, F.lit(False))).alias("ok"))
    return failures.select("failure_id").distinct().join(ok, "failure_id", "left").select("failure_id", F.when(F.col("ok"), F.lit("supported")).otherwise(F.lit("hypothesis")).alias("status"))


def root_cause_defaults(base: Column, causes: Column) -> Column:
    """Root causes of a model's answer made whole: ids, defaults, and disciplines that are known."""
    def one(c: Column, i: Column) -> Column:
        text = F.nullif(F.trim(F.coalesce(c["failure_cause"], F.lit(""))), F.lit(""))
        return F.struct(
            F.concat(base, F.lit("_F1_C"), (i + 1).cast("string")).alias("cause_ID"), F.coalesce(c["cause_level"], F.lit("unknown")).alias("cause_level"), F.coalesce(text, F.lit("Unknown cause (LLM incomplete)")).alias("failure_cause"),
            F.when(c["discipline_type"].isin(*DISCIPLINES), c["discipline_type"]).otherwise(F.lit("Other")).alias("discipline_type"), F.coalesce(c["confidence"], F.lit("medium")).alias("confidence"))

    fields = ("failure_cause", "cause_level", "discipline_type", "confidence")
    causes = F.transform(causes, lambda c: F.struct(*[c[f].cast("string").alias(f) for f in fields]))
    return F.transform(F.coalesce(causes, F.array().cast("array<struct<failure_cause:string,cause_level:string,discipline_type:string,confidence:string>>")), one)


def resolve(ids: DataFrame, index: DataFrame, key: str = "case_id") -> DataFrame:
    """(key, sentences): listed sentence ids (array `ids`) resolved in their order; unknown ones drop out."""
    listed = ids.select(key, F.posexplode("ids").alias("ord", "sentence_id")).join(index, [key, "sentence_id"])
    return listed.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "sentence_id", "text"))), lambda s: F.struct(s["sentence_id"].alias("sentence_id"), s["text"].alias("text"))).alias("sentences"))


def second_input(sentences: DataFrame) -> DataFrame:
    """The signals that a second extraction sees: id, text and annotations of selected sentences; blank subjects are null."""
    return sentences.select("case_id", "ord", "sentence_id", "text", "source_section", F.col("annotations.status").alias("status"), F.col("annotations.faithful_score").alias("faithful_score"), F.col("annotations.faithful_type").alias("faithful_type"), F.nullif(F.col("annotations.subject"), F.lit("")).alias("subject"))


def signals(signals_: DataFrame, by: str = "case_id", sections_: tuple[str, ...] = ("D2", "D3", "D4"), subject_in: str = "D4") -> DataFrame:
    """(by, D2, D3, D4): the lines of each section's signals in order, `- (none)` where there are none; subjects in one section only."""
    known = lambda c, other: F.coalesce(F.col(c).cast("string"), F.lit(other))
    subject = F.when((F.col("source_section") == subject_in) & (F.coalesce("subject", F.lit("")) != ""), F.concat(F.lit("[subject:"), "subject", F.lit("]")))
    line = F.concat_ws(" ", F.concat(F.lit("- [id:"), known("sentence_id", ""), F.lit("]")), subject, known("text", ""), F.concat(F.lit("(status="), known("status", "?"), F.lit(", faithful_score="), known("faithful_score", "?"), F.lit(", type="), known("faithful_type", "?"), F.lit(")")))
    rows = signals_.select(by, "ord", "source_section", line.alias("line"))
    block = lambda name: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("source_section") == name, F.struct("ord", "line")))), lambda x: x["line"]), "\n")
    return rows.groupBy(by).agg(*[F.coalesce(F.nullif(block(n), F.lit("")), F.lit("- (none)")).alias(n) for n in sections_])


def context_block(system_name: Column, symptoms: Column, failures: Column) -> Column:
    """What a later step is told of D2: system, symptoms and the failures (array of structs) one after the other."""
    said = lambda c: F.coalesce(c.cast("string"), F.lit("None"))
    one = lambda f: F.concat(F.lit("\n  - Element: "), said(f["system_element"]), F.lit("\n  - Mode: "), said(f["failure_mode"]), F.lit("\n  - Effect: "), said(f["failure_effect"]), F.lit("\n"))
    return F.concat(F.lit("\nSystem Name: "), said(system_name), F.lit("\nProblem Symptoms: "), said(symptoms), F.lit("\n\nFailures:\n"), F.array_join(F.transform(failures, one), "\n"), F.lit("\n"))


def _has_null(x: Column) -> Column:
    """Is any element null; sorted, as nulls come first then."""
    return F.coalesce((F.size(x) > 0) & F.get(F.sort_array(x), F.lit(0)).isNull(), F.lit(False))


def invalid_cases(cases: DataFrame) -> DataFrame:
    """(file_ord, message) of cases that miss what a case must have."""
    failure = F.col("failure")
    rules = (
        (F.coalesce(F.size("documents"), F.lit(0)) < 1, "missing documents"),
        (failure.isNull(), "missing failure"),
        (failure.isNotNull() & failure["failure_ID"].isNull(), "missing failure_ID"),
        (_has_null(F.col("failure.root_causes.cause_ID")), "missing cause_ID"),
        (_has_null(F.col("selected_sentences.text")), "missing sentence text"),
    )
    # A filter a rule: exploding an array of all messages loses rows where the case's arrays come from lambdas (Spark 4.1).
    found = [cases.where(broken).select("file_ord", F.lit(message).alias("message")) for broken, message in rules]
    return reduce(DataFrame.unionByName, found)


def require_valid(cases: DataFrame) -> DataFrame:
    """cases, or an error that names the first case in which something is missing."""
    first = invalid_cases(cases).orderBy("file_ord", "message").first()
    if first is not None:
        raise ValueError(f"case {first['file_ord']}: {first['message']}")
    return cases


def source_texts(cases: DataFrame, names: tuple[str, ...] = ("D2", "D3", "D4")) -> DataFrame:
    """(file_ord, text): the raw text of these sections, one after the other; missing ones are left out."""
    return cases.select("file_ord", F.concat_ws("\n", *[F.col(f"sections.{n}.raw_context") for n in names]).alias("text"))


# From sections (file, source_section, text) to cases. Selection and consolidation go by rules where no model is at hand.


def selected(sections_: DataFrame, k: int = 10) -> DataFrame:
    """(file, source_section, place, sentence, sentence_id): the k most valuable sentences of each section."""
    rows = texteval.valuable_sentences(sections_, k, ("file", "source_section"), "text", "file")
    return rows.select("file", "source_section", "place", "sentence", _sentence_id("file", "source_section", F.col("place")).alias("sentence_id"))


def sources(sections_: DataFrame) -> DataFrame:
    """(file, source): all sections of each case, in order. Dealt by file as in selected(), so that one shuffle of the texts does for both."""
    ordered = F.array_sort(F.collect_list(F.struct("source_section", "text")))
    dealt = sections_.select("file", "source_section", "text").repartition("file")
    return dealt.groupBy("file").agg(F.array_join(F.transform(ordered, lambda s: s["text"]), "\n").alias("source"))


def with_sources(sentences: DataFrame, sections_: DataFrame) -> DataFrame:
    """sentences with `source`: all sections of their own case, in order."""
    return sentences.join(sources(sections_), "file")


def annotated(sentences: DataFrame, sections_: DataFrame) -> DataFrame:
    """sentences with faithful_type and faithful_score against the text of their own case."""
    return texteval.faithfulness_by(sentences, sources(sections_), "file")


def consolidated(sentences: DataFrame, sections_: DataFrame) -> DataFrame:
    """(file, failure_mode, failure_effect, root_causes) of each case: the first sentence of D2 and of D3, and the sentences of D4 as causes, by rules."""
    first = lambda name: F.min(F.when((F.col("source_section") == name) & (F.col("place") == 1), F.col("sentence")))
    cause = F.struct("place", F.struct(F.col("sentence").alias("failure_cause"), classify.fmea_level(F.col("sentence")).alias("cause_level"), classify.discipline(F.col("sentence")).alias("discipline_type"), F.lit(None).cast("string").alias("confidence")).alias("c"))
    of = sentences.groupBy("file").agg(first("D2").alias("failure_mode"), first("D3").alias("failure_effect"), F.array_sort(F.collect_list(F.when(F.col("source_section") == "D4", cause))).alias("causes"))
    every = sections_.select("file").distinct().join(of, "file", "left")
    made = root_cause_defaults(F.concat(F.lit("report_"), F.col("file").cast("string")), F.transform("causes", lambda c: c["c"]))
    return every.select("file", "failure_mode", "failure_effect", made.alias("root_causes"))


def ingest(cases: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(failures, causes, sentences) of cases in CASE_SCHEMA with file_ord; cases without documents must be none.

    Sentences that support the failure come first, then those that nothing uses, then those of causes; the first
    place of an id in that order, by file, keeps it. Failures and causes of one id: the last file wins.
    """
    d = cases.select("file_ord", F.col("documents")[0].alias("doc"), "failure", "selected_sentences").withColumn("case_id", F.col("doc.file_name"))
    cause = d.select("file_ord", "case_id", F.col("failure.failure_ID").alias("failure_id"), "failure", F.posexplode("failure.root_causes").alias("n", "c"))

    def rows(frame: DataFrame, entities: str, role: str, step: int, cause_id: Column) -> DataFrame:
        e = frame.select("file_ord", "case_id", F.lit(step).alias("step"), F.lit(role).alias("sentence_role"), F.col("failure.failure_ID").alias("failure_id"), cause_id.alias("cause_id"), F.posexplode(entities).alias("ord", "s"))
        return e.select("file_ord", "case_id", "step", "sentence_role", "failure_id", "cause_id", "ord", F.col("s.sentence_id").alias("sentence_id"), F.col("s.text").alias("text"), F.coalesce("s.source_section", F.lit("")).alias("source_section"), F.col("s.annotations").alias("annotations"))

    of_failure = rows(d, "failure.supporting_entities", "failure_sentence", 0, F.lit(""))
    of_causes = rows(cause.withColumn("e", F.col("c.supporting_entities")), "e", "cause_sentence", 2, F.col("c.cause_ID"))
    used = of_failure.select("file_ord", "sentence_id").unionByName(of_causes.select("file_ord", "sentence_id")).distinct()
    other = rows(d, "selected_sentences", "other", 1, F.lit("")).join(used, ["file_ord", "sentence_id"], "left_anti").select(of_failure.columns)
    every = of_failure.unionByName(other).unionByName(of_causes)
    first = Window.partitionBy("sentence_id").orderBy("file_ord", "step", "cause_id", "ord")
    sentences = every.withColumn("p", F.row_number().over(first)).where("p = 1").drop("p", "step", "ord")

    ids = F.transform("failure.supporting_entities", lambda s: s["sentence_id"])
    evidence = of_failure.select("file_ord", "failure_id", "source_section", F.col("annotations.assertion_level").alias("assertion_level"), F.col("annotations.faithful_score").alias("faithful_score"))
    last = lambda key: Window.partitionBy(key).orderBy(F.desc("file_ord"))
    f = d.select("file_ord", F.col("failure.failure_ID").alias("failure_id"), F.coalesce("failure.failure_mode", F.lit("")).alias("failure_mode"), F.coalesce("failure.failure_element", F.lit("")).alias("failure_element"), F.col("failure.failure_effect").alias("failure_effect"), F.col("doc.product_name").alias("product"), ids.alias("supporting_sentence_ids"), F.transform("failure.root_causes", lambda c: c["cause_ID"]).alias("cause_ids"), maintenance(F.col("failure.maintenance_tag")).alias("maintenance"))
    f = f.withColumn("p", F.row_number().over(last("failure_id"))).where("p = 1").drop("p")
    failures = f.join(support_status(f, evidence.join(f.select("file_ord", "failure_id"), ["file_ord", "failure_id"], "left_semi")), "failure_id").drop("file_ord")
    empty = lambda c: F.coalesce(F.col(c), F.lit(""))
    causes = cause.select("file_ord", F.col("c.cause_ID").alias("cause_id"), "failure_id", empty("failure.failure_mode").alias("failure_mode"), empty("failure.failure_element").alias("failure_element"), F.col("failure.failure_effect").alias("failure_effect"), empty("c.failure_cause").alias("root_cause"), empty("c.cause_level").alias("cause_level"), empty("c.discipline_type").alias("discipline"), empty("c.confidence").alias("confidence"), F.transform("c.supporting_entities", lambda s: s["sentence_id"]).alias("supporting_sentence_ids"), maintenance(F.col("c.maintenance_tag")).alias("maintenance"))
    causes = causes.withColumn("p", F.row_number().over(last("cause_id"))).where("p = 1").drop("p", "file_ord")
    return failures, causes, sentences
