"""The queries of the training-data operators: each applies its operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, bands, bpe, embeddings, langid, merkle, mixing, ngram_join, pieces, pii, quality, substring, suffix
from .common import tune
from .oracles import ORACLES


#: The setting that holds the key of the pseudonyms, and the key of the synthetic tables, where it is unset.
PII_KEY, TEST_KEY = "faultline.pii.key", "synthetic tables only"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_feistel_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text with pseudonyms, n_replaced, for every document."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.pseudonymize(docs, key=spark.conf.get(PII_KEY, TEST_KEY), counted="n_replaced")


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """n_tokens and the digests of ids and decoded bytes, for every document."""
    tune(spark)
    import public_tokenizers

    docs = _table(spark, sf_dir, "documents")
    return bpe.digests(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op3_bradley_terry_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every document by a ranker learnt from the labels that are not held out."""
    tune(spark)
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    ranker = quality.fit(docs, _table(spark, sf_dir, "labels"))
    return quality.score(docs, ranker).select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op4_cell_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links, components and representatives of all vectors."""
    return embeddings.near_dedup(_table(spark, sf_dir, "embeddings"))


def op5_prefix_tree_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shingle counts and groups of all documents."""
    return ngram_join.groups(_table(spark, sf_dir, "documents"))


def op6_difference_cover_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What remains of each document without strings of 400 bytes that are elsewhere, too."""
    out = suffix.dedup(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op7_viterbi_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language and score of every document."""
    tune(spark)
    return langid.identify(_table(spark, sf_dir, "documents"))


def op8_doubling_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What remains of each document without windows of 20 words that were there before."""
    out = substring.dedup(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", "kept_sha256")


def op9_water_filling_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes, targets and words taken of every document."""
    return mixing.mix_sources(_table(spark, sf_dir, "documents"))


def op10_merkle_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and its edited text, and their likeness."""
    return merkle.fingerprint_edits(_table(spark, sf_dir, "documents"))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups and links of the two tokenizers' tokens in every document, and how common its links are."""
    tune(spark)
    import public_tokenizers

    docs = _table(spark, sf_dir, "documents")
    return alignment.align(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op12_piece_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number of pieces and the digests of ids and decoded text, for every document."""
    tune(spark)
    import public_tokenizers

    return pieces.digests(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op13_band_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First pairs and sums of all items with all lines of near unit prices."""
    return bands.near_prices(_table(spark, sf_dir, "sale_lines"), _table(spark, sf_dir, "items"))


_ALL = (
    op1_feistel_pseudonyms,
    op2_byte_bpe,
    op3_bradley_terry_quality,
    op4_cell_near_dedup,
    op5_prefix_tree_join,
    op6_difference_cover_dedup,
    op7_viterbi_language,
    op8_doubling_windows,
    op9_water_filling_mix,
    op10_merkle_fingerprints,
    op11_token_alignment,
    op12_piece_table,
    op13_band_join,
)
QUERIES = {f.__name__: f for f in _ALL}

__all__ = ["ORACLES", "QUERIES"]
