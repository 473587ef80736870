"""Faithfulness, coverage and compression of extracted sentences against their sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import classify
from ..functions import text as T


def _spread(rows: DataFrame, *keys: str) -> DataFrame:
    """rows over all cores before a costly ratio: few large files would keep it in few tasks."""
    n = max(rows.sparkSession.sparkContext.defaultParallelism, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return rows.repartition(n, *keys)


def faithfulness(pairs: DataFrame, fuzzy: int = 85, coverage: float = 0.75, sentence: str = "sentence", source: str = "source") -> DataFrame:
    """pairs with faithful_type, faithful_score and faithful.

    Exact copies are told first and only the rest goes through the Python ratio: the rows are split, as a UDF
    under a condition would run for all of them.
    """
    s, src = T.normalize_spaces(F.coalesce(sentence, F.lit(""))), T.normalize_spaces(F.coalesce(source, F.lit("")))
    rows = pairs.withColumns({"_s": s, "_src": src})
    easy = (F.col("_s") == "") | F.contains("_src", F.col("_s"))
    done = rows.where(easy).withColumns({"faithful_type": F.when(F.col("_s") == "", F.lit("hallucinated")).otherwise(F.lit("exact")), "faithful_score": F.when(F.col("_s") == "", 0).otherwise(100)})
    share = T.set_coverage(T.content_words(F.col(sentence)), T.content_words(F.col(source)))
    # A ratio under the coverage's own score can't count, so it need not be exact.
    rest = _spread(rows.where(~easy)).withColumn("_c", share)
    rest = rest.withColumn("_f", T.token_set_ratio("_s", "_src", F.floor(F.col("_c") * 100).cast("double")).cast("int"))
    score = F.greatest("_f", F.floor(F.col("_c") * 100).cast("int"))
    kind = F.when(score >= fuzzy, F.lit("fuzzy")).when(F.col("_c") >= coverage, F.lit("partial")).otherwise(F.lit("hallucinated"))
    rest = rest.withColumns({"faithful_type": kind, "faithful_score": score}).drop("_f", "_c")
    return done.unionByName(rest).drop("_s", "_src").withColumn("faithful", F.col("faithful_type") != "hallucinated")


def exact_or_covered(pairs: DataFrame, sentence: str = "sentence", source: str = "source") -> DataFrame:
    """pairs with is_exact and coverage: the part of faithfulness() that needs no Python."""
    exact = F.contains(T.normalize_spaces(F.col(source)), T.normalize_spaces(F.col(sentence)))
    return pairs.withColumns({"is_exact": exact, "coverage": F.round(T.set_coverage(T.content_words(F.col(sentence)), T.content_words(F.col(source))), 6)})


def exact_or_covered_by(sentences: DataFrame, sources: DataFrame, key: str, sentence: str = "sentence", source: str = "source") -> DataFrame:
    """exact_or_covered() of sentences against the source of their key (key, source): a source is brought to its plain text and its words once, not once a sentence."""
    of = sources.select(key, T.normalize_spaces(F.col(source)).alias("_src"), T.content_words(F.col(source)).alias("_words"))
    rows = sentences.join(of, key).withColumn("is_exact", F.contains("_src", T.normalize_spaces(F.col(sentence))))
    return rows.withColumn("coverage", F.round(T.set_coverage(T.content_words(F.col(sentence)), F.col("_words")), 6)).drop("_src", "_words")


def faithfulness_by(sentences: DataFrame, sources: DataFrame, key: str, fuzzy: int = 85, coverage: float = 0.75, sentence: str = "sentence", source: str = "source") -> DataFrame:
    """faithfulness() of sentences against the source of their key (key, source).

    What is made of a source is made once a source, not once a sentence, and only if a sentence is no copy of a part of it, letter by letter. A key's sentences
    lie in one row, which meets its source once: sources are shuffled once and carried no further. The ratio's words come from there too.
    """
    rows, let = F.col("_rows"), lambda value, f: F.get(F.transform(F.array(value), f), F.lit(0))
    plain = lambda c: T.normalize_spaces(F.coalesce(c, F.lit("")))
    columns = [c for c in sentences.columns if c != key]
    many = sentences.withColumn("_s", plain(F.col(sentence))).groupBy(key).agg(F.collect_list(F.struct(*columns, "_s")).alias("_rows"))
    held = many.join(sources.select(key, F.coalesce(source, F.lit("")).alias("_source")), key)
    marked = lambda easy: F.transform(rows, lambda r: F.struct(*[r[c].alias(c) for c in (*columns, "_s")], easy(r).alias("_easy")))
    # A copy stays one in plain text, but for a capital sigma, whose small letter depends on what follows.
    copied = lambda r: (r["_s"] == "") | F.coalesce(F.contains("_source", r[sentence]) & ~F.contains(r[sentence], F.lit("\u03a3")), F.lit(False))
    held = held.withColumn("_rows", marked(copied))
    plainly = let(plain(F.col("_source")), lambda src: marked(lambda r: r["_easy"] | F.contains(src, r["_s"])))
    held = held.withColumn("_rows", F.when(F.exists(rows, lambda r: ~r["_easy"]), plainly).otherwise(rows))
    held = held.select(key, F.filter(rows, lambda r: r["_easy"]).alias("_done"), F.filter(rows, lambda r: ~r["_easy"]).alias("_rows"), "_source")
    share = let(T.content_words(F.col("_source")), lambda words: F.transform(rows, lambda r: T.set_coverage(T.content_words(r[sentence]), words)))
    some = F.size("_rows") > 0
    held = held.select(key, "_done", "_rows", F.when(some, share).otherwise(F.array().cast("array<double>")).alias("_c"), F.when(some, plain(F.col("_source"))).otherwise(F.lit("")).alias("_src"))
    # A ratio under the coverage's own score can't count, so it need not be exact.
    low = F.transform("_c", lambda c: F.floor(c * 100).cast("double"))
    held = held.withColumn("_f", T.token_set_ratios(F.col("_rows._s"), F.col("_src"), low)).drop("_src")

    def rated(r: Column, kind: Column, score: Column) -> Column:
        return F.struct(*[r[c].alias(c) for c in columns], kind.alias("faithful_type"), score.alias("faithful_score"))

    done = F.transform("_done", lambda r: rated(r, F.when(r["_s"] == "", F.lit("hallucinated")).otherwise(F.lit("exact")), F.when(r["_s"] == "", F.lit(0)).otherwise(F.lit(100))))
    score = lambda x: F.greatest(x["_f"].cast("int"), F.floor(x["_c"] * 100).cast("int"))
    kind = lambda x: F.when(score(x) >= fuzzy, F.lit("fuzzy")).when(x["_c"] >= coverage, F.lit("partial")).otherwise(F.lit("hallucinated"))
    rest = F.transform(F.arrays_zip("_rows", "_c", "_f"), lambda x: rated(x["_rows"], kind(x), score(x)))
    out = held.select(key, F.explode(F.concat(done, rest)).alias("r")).select(key, "r.*")
    return out.select(*sentences.columns, "faithful_type", "faithful_score").withColumn("faithful", F.col("faithful_type") != "hallucinated")


def similarity(a: Column, b: Column) -> Column:
    """0 to 1: the greater of the token-set ratio of a and b and the share of a's tokens that b has; 0 if either is null."""
    return F.coalesce(T.best_likeness(T.normalize_plain(a), T.normalize_plain(b)), F.lit(0.0))


def iteration_rates(rated: DataFrame) -> DataFrame:
    """One row of rates over sentences (text, entity_type, assertion_level, faithful_type); no sentences give zeros."""
    n = F.greatest(F.lit(1), F.count("*"))
    rate = lambda c: F.round(F.count_if(c) / n, 6)
    kind = lambda *names: F.col("faithful_type").isin(*names)
    return rated.agg(
        F.count("*").alias("total"), rate(kind("exact", "fuzzy")).alias("strong_faithfulness_rate"), rate(kind("partial")).alias("weak_faithfulness_rate"),
        rate(kind("hallucinated")).alias("hallucination_rate"), rate(classify.is_atomic(F.col("text"))).alias("atomicity_rate"),
        rate(classify.entity_rule(F.col("entity_type"), F.col("text"))).alias("entity_rule_pass_rate"), rate(classify.assertion_rule(F.col("assertion_level"), F.col("text"))).alias("assertion_rule_pass_rate"),
        rate(F.coalesce(F.col("assertion_level") == "confirmed", F.lit(False))).alias("confirmed_ratio"), rate(kind("exact")).alias("exact_ratio"), rate(kind("fuzzy")).alias("fuzzy_ratio"), rate(kind("partial")).alias("partial_ratio"))


def rates_text(rates: DataFrame) -> DataFrame:
    """(summary): iteration_rates() in a few lines to read."""
    part = lambda label, c: F.concat(F.lit(f"{label}: "), F.round(F.col(c) * F.col("total")).cast("long").cast("string"))
    lines = [F.concat(F.lit("Total: "), F.col("total").cast("string")), part("Faithful", "strong_faithfulness_rate"), part("Hallucinated", "hallucination_rate"), part("Atomic", "atomicity_rate"), part("Entity rule pass", "entity_rule_pass_rate"), part("Assertion rule pass", "assertion_rule_pass_rate"), part("Confirmed", "confirmed_ratio")]
    return rates.select(F.concat_ws("\n", *lines).alias("summary"))


def type_coverage(sentences: DataFrame, by: str) -> DataFrame:
    """By case: has_symptom, has_root_or_investigation, sentence_count, type_counts (as `type:n`, sorted)."""
    counts = sentences.groupBy(by, "entity_type").agg(F.count("*").alias("n"))
    known = F.coalesce(F.col("entity_type"), F.lit("")) != ""
    pairs = F.collect_list(F.when(known, F.concat_ws(":", "entity_type", F.col("n").cast("string"))))
    return counts.groupBy(by).agg(
        F.coalesce(F.bool_or(F.col("entity_type") == "symptom"), F.lit(False)).alias("has_symptom"),
        F.coalesce(F.bool_or(F.col("entity_type").isin("root_cause_evidence", "investigation")), F.lit(False)).alias("has_root_or_investigation"),
        F.sum("n").alias("sentence_count"), F.array_join(F.array_sort(pairs), ",").alias("type_counts"))


def compression(docs: DataFrame, source: str = "source", summary: str = "summary") -> DataFrame:
    """docs with source_tokens, summary_tokens and compression_ratio."""
    a, b = F.size(T.tokens(F.col(source))), F.size(T.tokens(F.col(summary)))
    return docs.withColumns({"source_tokens": a, "summary_tokens": b, "compression_ratio": F.round(b / F.greatest(a, F.lit(1)), 6)})


def density(coverage: Column, ratio: Column) -> Column:
    return coverage / F.greatest(ratio, F.lit(1e-9))


def compression_report(docs: DataFrame, key: str = "doc_id", source: str = "source", summary: str = "summary_sentences") -> DataFrame:
    """By document: unit_count, mean_coverage, sentence_count, mean_faithfulness, compression_ratio, information_density.

    Each unit of the source takes its best likeness over the summary's sentences; each sentence its likeness to
    the whole source. Units and sentences meet inside their document only.
    """
    joined = F.array_join(F.col(summary), " ")
    base = compression(docs.select(key, F.col(source).alias("source"), F.col(summary).alias("parts"), joined.alias("summary")))
    units = base.select(key, F.posexplode_outer(T.sentences(F.col("source"))).alias("u", "unit"), "parts").select(key, "u", "unit", F.explode_outer("parts").alias("sentence"))
    best = _spread(units, key, "u").withColumn("near", similarity(F.col("unit"), F.col("sentence"))).groupBy(key, "u").agg(F.max("near").alias("best"))
    covered = best.groupBy(key).agg(F.count("u").alias("unit_count"), F.coalesce(F.avg(F.when(F.col("u").isNotNull(), F.col("best"))), F.lit(0.0)).alias("mean_coverage"))
    sents = _spread(base.select(key, "source", F.explode("parts").alias("sentence")), key).withColumn("near", similarity(F.col("sentence"), F.col("source")))
    faith = sents.groupBy(key).agg(F.count("*").alias("sentence_count"), F.avg("near").alias("mean_faithfulness"))
    out = base.select(key, "compression_ratio").join(covered, key).join(faith, key, "left")
    return out.select(key, "unit_count", F.round("mean_coverage", 6).alias("mean_coverage"), F.coalesce("sentence_count", F.lit(0)).alias("sentence_count"), F.round(F.coalesce("mean_faithfulness", F.lit(0.0)), 6).alias("mean_faithfulness"), "compression_ratio", F.round(density(F.col("mean_coverage"), F.col("compression_ratio")), 4).alias("information_density"))


def valuable_sentences(docs: DataFrame, k: int = 10, key: str | tuple[str, ...] = "doc_id", text: str = "text", by: str | None = None) -> DataFrame:
    """(key, place, sentence, value) of the k most valuable sentences of more than six words; ties keep their order. `by`: the column of the key that rows are dealt by, if not all."""
    keys = [key] if isinstance(key, str) else list(key)
    # Dealt by key before the sentences are made: the ranking within a key then needs no shuffle of its own.
    docs = docs.select(*keys, text).repartition(*([by] if by else keys))
    rows = docs.select(*keys, F.posexplode(T.valuable_sentences(F.col(text))).alias("ord", "sentence"))
    rows = rows.where(T.has_words(F.col("sentence"), 7)).withColumn("value", F.round(T.sentence_value(F.col("sentence")), 6))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("value"), "ord"))
    return rows.withColumn("place", place).where(F.col("place") <= k).select(*keys, "place", "sentence", "value")
