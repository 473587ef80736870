"""Corpus pipeline: quality, near-duplicates, PII, mixing, tokens; each stage works on all that the one before kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.llm import bpe, mixing, ngram_join, pii, quality
from faultline.llm.common import tune, written


#: The setting that holds the key of the pseudonyms, and the key of the synthetic tables, where it is unset.
PII_KEY, TEST_KEY = "faultline.pii.key", "synthetic tables only"


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality ranker does not reject (score from quality.CUT on); columns of docs keep their names and values.

    Null texts and empty ones are scored as empty; null ids stay; an empty table gives an empty one.
    """
    tune(spark)
    ranker = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    free = lambda name: next(n for n in (f"{name}{'_' * k}" for k in range(len(docs.columns) + 1)) if n not in docs.columns)
    score, good = free("_score"), free("_good")
    scored = quality.score(docs, ranker, score=score, predicted=good)
    return scored.where(F.col(good) == 1).select(*[F.col(f"`{c}`") for c in docs.columns])


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five-word shingles, Jaccard similarity from 0.8 on."""
    tune(spark)
    return ngram_join.keep_one(docs)


def hide_personal_values(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with pseudonyms; n_chars follows the new text."""
    hidden = pii.pseudonymize(docs, key=spark.conf.get(PII_KEY, TEST_KEY))
    return hidden.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else hidden


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated, or left out, to bring the sources to their weights."""
    return mixing.repeat_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and the digest of the decoded bytes of every row of the mix; other columns end here."""
    tune(spark)
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    decoded = bpe.decode(bpe.encode(docs, path, public_tokenizers.PATTERN), path)
    return decoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality classifier", keep_good),
    ("n-gram Jaccard join", keep_one_of_each_group),
    ("PII", hide_personal_values),
    ("mixing sources to target weights", mix),
    ("byte-level BPE", tokens),
]

#: A learnt ranker, whole groups of near-duplicates and keyed permutations are not expressible in SQL; tests/llm/test_pipeline.py holds the rows against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir, each written before the next one reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.split()[0])
    return STAGES[-1][1](spark, docs, sf_dir)
